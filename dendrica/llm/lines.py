"""Line dedup by a segment-partition edit join.

A line goes if an equal line stands before it, or if it is the first of its kind
and a line within `edits` edits stands before it. Before: by doc_id (nulls last),
then place in the text; only lines with a word take part, and lines of fewer than
`least` characters only by equality. White space at a line's ends does not count.

Every line is cut into edits + 1 segments; two lines within so many edits share
one, at a place that their lengths bound. Lines are indexed by (length, segment,
its characters) and probe the indexes of all lengths that can match at only those
places that a match can have. Candidates are verified by a banded bit-parallel
automaton, a word of 2 * edits + 1 diagonals for each number of edits.

A line may differ from another by one edit for each `least` characters that the
shorter one has, and by `edits` at most; a line too short for one goes by
equality only.

Long lists (a segment shared by many lines) are not joined pair by pair: for one
edit, the part outside the shared segment is halved again and again, each half
giving a longer shared part, until lists are short; when but one character is
left out, equality of keys proves the distance and a list is settled by its
first line alone. With more edits allowed, long lists are joined in pairs that
skew-splitting deals out. Sizes of lists are counted by key and joined back, so
that no task holds a list whole.

Lines and documents are told apart by 128 bits of their texts. Everything here
is DataFrame expressions. Rows equal in id and text are one document and cleaned
alike; null texts stay null, empty ones empty; blank lines stay; all other
columns stay as they are, whatever their names, but for one of the name of the
count that dedup adds, which gives way to it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, ascii_lower, free, let, table

#: Edits at most, and characters for each.
EDITS, LEAST = 1, 32
BLANK = " \t\n\x0b\x0c\r"
#: Entries of a list that are still joined pair by pair.
LIST = 48
#: Least hashes of a shingle set that stand for it before it is fetched.
SKETCH = 32


def segment(length: Column, i: int, edits: int) -> tuple[Column, Column]:
    """Place from 1 and size of segment i (from 0) of a line; the longer segments come last."""
    n = edits + 1
    size, longer = F.floor(length / n).cast("int"), F.pmod(length, F.lit(n))
    extra = F.greatest(longer - (n - i), F.lit(0))
    return (1 + size * i + extra).cast("int"), (size + F.when(longer >= n - i, 1).otherwise(0)).cast("int")


def allowed(length: Column, edits: int, least: int) -> Column:
    """Edits by which a line of a length may differ from longer ones."""
    return F.least(F.lit(edits), F.floor(length / max(least, 1)).cast("int"))


def segment_keys(line: Column, length: Column, edits: int, least: int) -> tuple[list[Column], list[bool], list[int]]:
    """Keys of a line, which of them index it by its own segments, and the segment of each; the others only probe, at the places that a match can have. Null where none can."""
    keys, own, nth = [], [], []
    for e in range(1, edits + 1):  # of lines to which e edits are allowed
        for delta in range(e + 1):
            of = length - delta
            fits = (allowed(of, edits, least) == e) & (of > e)
            for i in range(e + 1):
                at, size = segment(of, i, e)
                low, high = max(-i, delta - (e - i)), min(i, delta + (e - i))
                for shift in range(low, high + 1):
                    inside = fits & (at + shift >= 1) & (at + shift + size - 1 <= length)
                    keys.append(F.when(inside, F.xxhash64(of, F.lit(i), line.substr(at + shift, size))))
                    own.append(delta == shift == 0)
                    nth.append(i)
    return keys, own, nth


def within(a: Column, b: Column, edits: int) -> Column:
    """Least number of edits from a to b if at most `edits`, else null; |length difference| beyond `edits` is null too.

    Bit d of word e is set if a[:i] becomes b[:j] by e edits at diagonal i - j = d - edits.
    """
    mask, words = (1 << (2 * edits + 1)) - 1, range(edits + 1)

    def spread(rows: list[Column]) -> Column:
        return F.struct(*(r.alias(f"r{e}") for e, r in enumerate(rows)))

    start = [F.lit(1 << edits).cast("long")]
    for _ in range(edits):
        start.append(start[-1].bitwiseOR(F.shiftleft(start[-1], 1)).bitwiseAND(F.lit(mask)))

    def run(p: Column, t: Column) -> Column:
        def step(acc: Column, j: Column) -> Column:
            same = lambda d: F.when(F.get(p, j + (d - edits)) == F.get(t, j), F.lit(1 << d).cast("long")).otherwise(F.lit(0).cast("long"))
            match = reduce(Column.bitwiseOR, [same(d) for d in range(2 * edits + 1)])

            def next_word(m: Column) -> Column:
                rows: list[Column] = []
                for e in words:
                    r = acc[f"r{e}"].bitwiseAND(m)
                    if e:
                        before = acc[f"r{e - 1}"]
                        r = r.bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(rows[-1], 1)).bitwiseAND(F.lit(mask))
                    rows.append(r)
                return spread(rows)

            return let(match, next_word)

        return F.aggregate(F.sequence(F.lit(0), F.size(t) - 1), spread(start), step)

    near = F.abs(F.length(a) - F.length(b)) <= edits
    end = F.length(a) - F.length(b) + edits
    last = let(F.split(a, ""), lambda p: let(F.slice(F.split(b, ""), F.lit(1), F.length(b)), lambda t: run(p, t)))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), end)
    found = let(last, lambda r: F.coalesce(*(F.when(r[f"r{e}"].bitwiseAND(bit) != 0, F.lit(e)) for e in words)))
    return F.when(near & (F.length(b) > 0), found).when(near, F.length(a))


def document(key: str, text: str) -> Column:
    """128 bits that stand for a document; null for a null text."""
    said = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))
    return F.unhex(F.md5(F.concat(said, F.lit("\0"), F.col(text))))


def _trimmed(line: str) -> Column:
    """The line without white space at its ends, which is looked for only where an end has some."""
    v = F.col(line)
    ends = reduce(Column.__or__, [end for b in BLANK for end in (v.startswith(b), v.endswith(b))])
    return F.when(ends, F.trim(v, F.lit(BLANK))).otherwise(v)


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """__k, __d, no, v, h: lines with a word, trimmed; __k stands for the document, h for the line."""
    # Below the explode, or the whole text would be hashed for each of its lines; outer, or it would be split again to filter out null ones.
    x = docs.select(document(key, text).alias("__k"), F.col(key).alias("__d"), F.split(F.col(text), "\n").alias("x")).select("__k", "__d", F.posexplode_outer("x").alias("no", "v"))
    # Never null, or joins would hash each line once more to see that it is not.
    h = F.coalesce(F.unhex(F.md5("v")), F.lit(bytearray()))
    return x.withColumn("v", _trimmed("v")).where("v <> ''").withColumn("h", h)


def _sized(entries: DataFrame) -> DataFrame:
    """Entries of lists of two or more that hold an indexed line, with n, the entries of the list."""
    sizes = entries.groupBy("key").agg(F.count("*").alias("n"), F.count_if("own").alias("owns")).where("n > 1 AND owns > 0").drop("owns")
    return entries.join(sizes, "key")


def _gap_key(of: str = "l", p: str = "p", s: str = "s") -> Column:
    """Key of what a line shares when only the characters between p and the last s are left out."""
    return F.expr(f"xxhash64({of}, {p}, {s}, left(v, {p}), right(v, {s}))")


def _pairs(entries: DataFrame) -> DataFrame:
    """a, b: lines of a list, of which the first is indexed and no longer than the second."""
    left = entries.where("own").select("key", F.col("h").alias("a"), F.col("len").alias("n"))
    right = entries.select("key", F.col("h").alias("b"), F.col("len").alias("m"))
    return left.join(right, "key").where("a <> b AND (n < m OR n = m AND a < b)").select("a", "b")


def _near(found: DataFrame, docs: DataFrame, key: str, text: str, firsts: DataFrame, edits: int, least: int) -> DataFrame:
    """h of lines of which another one, within `edits` edits, stands first. found: key, h, len, own, nth (segment), n (entries of the list)."""
    some = table(found.select("h").distinct())
    # The texts of only those lines that share a segment with another.
    # One text for each line before they are joined, so that a common one does not meet in one task (a semi join would be pushed below that); nothing bounds the number of `some`, so they are not broadcast at any size.
    texts = _lines(docs, key, text).groupBy("h").agg(F.first("v").alias("v")).join(some.hint("merge"), "h")
    texts = table(texts.join(firsts.select("h", "first"), "h"))
    short = found.where(F.col("n") <= LIST) if edits == 1 else found
    pairs, settled = [_pairs(short)], []
    if edits == 1:
        l = F.when(F.col("own"), F.col("len")).otherwise(F.col("len") - 1)
        half = F.floor(l / 2).cast("int")
        long = found.where(F.col("n") > LIST).select("h", "len", "own", l.alias("l"), F.when(F.col("nth") == 0, half).otherwise(0).alias("p"), F.when(F.col("nth") == 0, 0).otherwise(l - half).alias("s"))
        long = table(long)
        while not long.isEmpty():
            gap = "(l - p - s)"
            held = long.join(texts, "h")
            keyed = held.withColumn("key", _gap_key())
            # One character left out: lines of the same length with equal keys are one replacement apart.
            one = keyed.where(f"{gap} = 1 AND own").select("key", "h", "first")
            one = one.join(one.groupBy("key").agg(F.min("first").alias("least")), "key").where("least < first").select("h")
            # None left out of the shorter: an insertion apart.
            none = held.where(f"{gap} = 1").select("*", F.explode(F.expr("array(named_struct('p2', p + 1, 's2', s), named_struct('p2', p, 's2', s + 1))")).alias("c"))
            none = none.select("h", "first", "own", "l", F.col("c.p2").alias("p"), F.col("c.s2").alias("s"), "v").withColumn("key", F.expr("xxhash64(l, concat(left(v, p), right(v, s)))"))
            none = none.select("key", "h", "first", "own")
            none = none.join(none.groupBy("key").agg(F.expr("min(first) FILTER (WHERE own)").alias("mine"), F.expr("min(first) FILTER (WHERE NOT own)").alias("other")), "key")
            none = none.where("CASE WHEN own THEN other < first ELSE mine < first END").select("h")
            settled += [one, none]
            halves = held.where(f"{gap} > 1").select("h", "len", "own", "l", "v", F.explode(F.expr(f"array(named_struct('p', CAST(p + {gap} DIV 2 AS INT), 's', s), named_struct('p', p, 's', CAST(s + {gap} - {gap} DIV 2 AS INT)))")).alias("c"))
            halves = halves.select("h", "len", "own", "l", "v", "c.p", "c.s").withColumn("key", _gap_key()).drop("v")
            halves = table(_sized(table(halves)))
            pairs.append(_pairs(halves.where(F.col("n") <= LIST)))
            long = halves.where(F.col("n") > LIST).drop("key", "n")
    apart = table(reduce(DataFrame.unionByName, pairs).distinct())
    a = texts.select(F.col("h").alias("a"), F.col("v").alias("av"), F.col("first").alias("af"))
    b = texts.select(F.col("h").alias("b"), F.col("v").alias("bv"), F.col("first").alias("bf"))
    met = apart.join(a, "a").join(b, "b").where(within(F.col("av"), F.col("bv"), edits) <= allowed(F.least(F.length("av"), F.length("bv")), edits, least))
    later = met.select(F.when(F.col("af") < F.col("bf"), F.col("b")).otherwise(F.col("a")).alias("h"))
    return reduce(DataFrame.unionByName, [later, *settled]).distinct()


def _keyed(docs: DataFrame, edits: int, least: int, key: str, text: str) -> DataFrame:
    """__k, __d, no, h, len, keys of all lines, written out; keys of lines too short for an edit are null."""
    # Length is a column of its own, and keys stand under no condition, or what they share would be computed for each.
    lines = _lines(docs, key, text).withColumn("len", F.length("v").cast("int"))
    keys = F.array(*segment_keys(F.col("v"), F.col("len"), edits, least)[0])
    return table(lines.select("__k", "__d", "no", "h", "len", keys.alias("keys")))


def _order() -> Column:
    return F.struct(F.col("__d").isNull().alias("z"), F.col("__d").alias("d"), F.col("__k").alias("k"), F.col("no").alias("no"))


def _repeated(lines: DataFrame, docs: DataFrame, edits: int, least: int, key: str, text: str) -> DataFrame:
    firsts = table(lines.groupBy("h").agg(F.min(_order()).alias("first"), F.count("*").alias("times")))
    _, own, nth = segment_keys(F.lit(""), F.lit(0), edits, least)
    entries = lines.where(F.col("len") >= least).select("h", "len", F.posexplode("keys").alias("at", "key")).where("key IS NOT NULL")
    entries = entries.select("h", "len", "key", F.get(F.array(*map(F.lit, own)), F.col("at")).alias("own"), F.get(F.array(*map(F.lit, nth)), F.col("at")).alias("nth"))
    # A key of a line may be an index key, and one that probes.
    entries = entries.groupBy("key", "h", "len").agg(F.max("own").alias("own"), F.min("nth").alias("nth"))
    lists = table(_sized(table(entries)))
    near = _near(lists, docs, key, text, firsts, edits, least).withColumn("near", F.lit(True))
    flagged = table(firsts.join(near, "h", "left").where("times > 1 OR near").select("h", "first", F.coalesce("near", F.lit(False)).alias("near")))
    gone = lines.select("__k", "__d", "no", "h").join(flagged, "h").withColumn("order", _order())
    return gone.where("order > first OR near").select("__k", "__d", "no", "h", F.expr("near AND order = first").alias("near"))


def repeated_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """__k, __d, no, h, near: every line that goes, of every document; near: no equal line stands before it."""
    return _repeated(_keyed(docs, edits, least, key, text), docs, edits, least, key, text)


def without(docs: DataFrame, gone: DataFrame, key: str = "doc_id", text: str = "text", count: str = "__gone") -> DataFrame:
    """docs with the lines of gone(__k, no) taken out of their texts, and `count`, how many."""
    places = gone.groupBy("__k").agg(F.collect_set("no").alias("no"))
    # All columns of docs in one, so that none can clash with what is joined.
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), document(key, text).alias("__k")).join(places, "__k", "left")
    old = F.col("doc").getField(text)
    held = let(F.split(old, "\n"), lambda x: let(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("no")), lambda at: F.array_join(F.transform(at, lambda i: F.get(x, i)), "\n")))
    new = F.when(F.col("no").isNull(), old).otherwise(held)
    cols = [(new if c == text else F.col("doc").getField(c)).alias(c) for c in docs.columns if c != count]
    return keyed.select(*cols, F.coalesce(F.size("no"), F.lit(0)).cast("long").alias(count))


def dedup(docs: DataFrame, edits: int = EDITS, least: int = LEAST, key: str = "doc_id", text: str = "text", count: str = "__gone") -> DataFrame:
    """docs with each line kept where it, or one within the edits allowed, stands first, and `count`, the lines that went."""
    return without(docs, repeated_lines(docs, edits, least, key, text), key, text, count)


def shingle_set(text: Column, size: int) -> Column:
    """Distinct hashes of runs of `size` words; of all words, if fewer."""
    words = F.filter(F.split(ascii_lower(text), f"[{WS}]+"), lambda w: w != "")
    runs = lambda h: F.when(F.size(h) <= size, F.filter(F.array(F.xxhash64(h)), lambda _: F.size(h) > 0)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(h) - (size - 1)), lambda i: F.xxhash64(F.slice(h, i, size)))))
    return let(F.transform(words, lambda w: F.xxhash64(w)), runs)


def near_copies(lines: DataFrame, docs: DataFrame, size: int, percent: int, key: str, text: str) -> DataFrame:
    """__k of documents that are near copies of one that stands before them and has a line of theirs first: shingle sets of `percent` hundredths of Jaccard similarity or more.

    Pairs are held against each other's sizes and least SKETCH hashes first, of
    which alike sets share all but a few (fewer than a third of what is expected
    with a chance below 1e-12), so that whole sets travel only where they may be alike.
    """
    firsts = lines.groupBy("h").agg(F.min(_order()).alias("first"), F.count("*").alias("times")).where("times > 1").select("h", F.col("first.k").alias("a"))
    pairs = table(lines.select("h", F.col("__k").alias("b")).join(firsts, "h").where("a <> b").select("a", "b").distinct())
    known = docs.where(F.col(text).isNotNull()).select(document(key, text).alias("k"), shingle_set(F.col(text), size).alias("s"))
    # Rows equal in id and text are one document.
    known = table(known.select("k", F.size("s").alias("n"), F.slice(F.sort_array("s"), 1, SKETCH).alias("s")).dropDuplicates(["k"]))
    of = lambda df, x: df.select(*(F.col(c).alias(x if c == "k" else x + c) for c in df.columns))
    fit = pairs.join(of(known, "a"), "a").where("an > 0").join(of(known, "b"), "b").where(f"100 * least(an, bn) >= {percent} * greatest(an, bn)")
    fit = table(fit.where(f"size(array_intersect(as, bs)) >= least({SKETCH * percent // 400}, {percent} * an DIV 100)").select("a", "b"))
    some = fit.select(F.col("a").alias("k")).unionByName(fit.select(F.col("b").alias("k"))).distinct()
    sets = docs.select(document(key, text).alias("k"), F.col(text).alias("t")).join(some, "k", "left_semi").dropDuplicates(["k"])
    sets = table(sets.select("k", shingle_set(F.col("t"), size).alias("s")).withColumn("n", F.size("s")))
    met = fit.join(of(sets, "a"), "a").join(of(sets, "b"), "b").withColumn("both", F.size(F.array_intersect("as", "bs")))
    return met.where(f"100 * both >= {percent} * (an + bn - both)").select(F.col("b").alias("__k")).distinct()


def dedup_originals(docs: DataFrame, edits: int = EDITS, least: int = LEAST, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without near copies, and with each line kept where it, or one within the edits allowed, stands first among those that are left; columns as in docs.

    A near copy of a document before it would lose nearly all its lines to that one
    and leave a torso that no later step could tell for a copy. So it goes whole
    (near_copies), before lines are counted: no line is spared for its sake, and
    none is lost because it stands first in a document that goes.
    """
    lines = _keyed(docs, edits, least, key, text)
    copies = table(near_copies(lines, docs, size, percent, key, text))
    left = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), document(key, text).alias("__k")).join(copies, "__k", "left_anti").select("doc.*")
    gone = _repeated(lines.join(copies, "__k", "left_anti"), docs, edits, least, key, text)
    count = free("__gone", docs.columns)
    return without(left, gone, key, text, count).drop(count)
