"""Exact n-gram Jaccard join with set-relation skipping.

Equal sets meet first and stand as one. Each set's rarest shingles (its prefix;
any two sets that link share one there) form inverted lists. Two relations
between sets are used to skip work:

- Lists are cut into blocks by set size, such that sets link within a block or
  with a neighbouring one only, and are joined by shingle and block; an entry's
  position bounds what it can share from there on.
- In a block every entry is first held against the block's leader only, and how
  much they share is kept. The answers of the other sets come from those of the
  leader: what u and v share is at least what both share with the leader less
  the leader's size, and at most what v shares with it and what of u lies
  outside of it. Pairs that these bounds decide either way are not looked at;
  sets linked already are one class, and pairs in a class, and lists of one
  class, are skipped. Only what is left is verified.

So no link between different classes is lost, and copies and near copies of one
document cost a pair each and not a pair with every other.

The order of shingles is: those that repeat within some task's documents last,
by how often; others by hash. Any fixed order gives exact results; this one
keeps common passages out of prefixes.

Ids may be of any type that has an order. Null texts, and texts without a word,
have empty sets and link with nothing; texts with fewer words than a shingle
have the whole sequence as one; repeated rows and copies link with each other;
rows that share an id count as one document that links by any of its texts. Rows
with a null id take no part and have a null component. Other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, table
from .tokens import slices, split_words

#: Shingles whose order is by frequency, at most; they go to every worker.
COMMON = 1 << 17
#: Shingles a task holds while it counts.
HELD = 1_500_000
#: Followers of a leader that meet it in one task.
FOLLOWERS = 64


def shingles(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The shingle set of each text, as a sorted array of 64-bit hashes."""
    words, codes, at = split_words(texts)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words))
    h = hashes[codes]

    def mixed(width: int, start: int, stop: int) -> np.ndarray:
        out = np.full(stop - start - width + 1, width, np.uint64)
        for i in range(width):
            out ^= h[start + i : start + i + len(out)]
            out *= np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
            out *= np.uint64(0xBF58476D1CE4E5B9)
            out ^= out >> np.uint64(32)
        return out

    whole = mixed(size, 0, len(h)) if len(h) >= size else None
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(whole[a : b - size + 1]))
        else:
            out.append(mixed(b - a, a, b) if b > a else np.zeros(0, np.uint64))
    return out


def least_overlap(n, percent: int):
    """Shared shingles that a set of size n has with any set that it links with."""
    return -(-percent * n // 100)


def _common(docs: DataFrame, text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that repeat in some task, the most frequent COMMON of them, sorted, and their frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def out() -> pa.RecordBatch:
            value, n = np.unique(np.concatenate(held), return_counts=True)
            some = n > 1
            return pa.RecordBatch.from_arrays([pa.array(value[some].view(np.int64)), pa.array(n[some].astype(np.int64))], ["s", "n"])

        for whole in batches:
            for b in slices(whole, 0):
                some = shingles(b.column(0), size)
                held += some
                count += sum(map(len, some))
                if count > HELD:
                    yield out()
                    held, count = [], 0
        if held:
            yield out()

    found = docs.select(text).mapInArrow(run, "s bigint, n bigint").groupBy("s").agg(F.sum("n").alias("n"))
    found = table(found)
    level = F.floor(F.log2("n") * 8).cast("int")
    least, total = None, 0
    for r in sorted(found.groupBy(level.alias("l")).count().collect(), reverse=True):  # 8 rows a power of two
        if (total := total + r["count"]) > COMMON:
            break
        least = r["l"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    got = found.where(level >= least).toArrow()
    s, n = got["s"].to_numpy().view(np.uint64), got["n"].to_numpy()
    order = np.argsort(s)
    return s[order], n[order]


def _prefixed(docs: DataFrame, text: str, size: int, percent: int, common) -> DataFrame:
    """docs(__id) with n, two hashes of the whole set, and its prefix in the order of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, freq = common.value
        for b in (x for whole in batches for x in slices(whole, 1)):
            n, one, two, prefix = [], [], [], []
            for s in shingles(b.column(1), size):
                n.append(len(s))
                one.append(int(np.bitwise_xor.reduce(s).view(np.int64)) if len(s) else 0)
                two.append(int((s * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(7)).sum().view(np.int64)) if len(s) else 0)
                keep = len(s) - least_overlap(len(s), percent) + 1 if len(s) else 0
                if len(often) and len(s):
                    at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                    rank = np.where(often[at] == s, freq[at], 0)
                    s = s[np.argsort(rank, kind="stable")]
                prefix.append(s[:keep].view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(prefix, pa.list_(pa.int64()))], ["__id", "n", "one", "two", "prefix"])

    return docs.select("__id", text).mapInArrow(run, "__id bigint, n bigint, one bigint, two bigint, prefix array<bigint>")


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """pairs(a, b) with how many shingles they share, and whether they link. Each leader's text meets those of its followers; large followings are dealt out with a copy of the leader each."""
    parts = F.ceil(F.count("*") / FOLLOWERS).cast("int").alias("parts")
    leaders = table(pairs.groupBy("a").agg(parts))
    first = leaders.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(texts.select(F.col("__id").alias("a"), "__t"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "__t")
    others = pairs.join(leaders, "a").select("a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), "b").join(texts.select(F.col("__id").alias("b"), "__t"), "b").select("a", "part", "b", "__t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, leads = None, []
        for batch in (x for whole in batches for x in slices(whole, 3)):
            out = [[], [], [], []]
            rows = zip(*(batch.column(i).to_pylist() for i in range(3)), shingles(batch.column(3), size), strict=True)
            for a, part, b, s in rows:
                if b is None:  # nulls sort first; an id given to several texts has as many
                    leads = [*leads, s] if of == (a, part) else [s]
                    of = a, part
                elif of == (a, part):
                    shared = [len(np.intersect1d(x, s, assume_unique=True)) for x in leads]
                    linked = any(100 * n >= percent * (len(x) + len(s) - n) for x, n in zip(leads, shared, strict=True))
                    for to, value in zip(out, (a, b, max(shared), linked), strict=True):
                        to.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["a", "b", "shared", "linked"])

    met = first.unionByName(others).repartition("a", "part").sortWithinPartitions("a", "part", "b")
    return table(met.mapInArrow(run, "a bigint, b bigint, shared bigint, linked boolean"))


def components(links: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """id, c: the least id reachable from each id that links(a, b) name; previous: classes already known.

    Each round every id takes the least label about it and then its label's label,
    so a chain halves and a star ends in two rounds.
    """
    if previous is not None:
        links = links.unionByName(previous.select(F.col("id").alias("a"), F.col("c").alias("b")))
    edges = table(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        # Large star, then small star (Kiveris and others, 2014): labels fall, links never part a component.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written out, so that the edges of a hub can be split in the join.
        least = table(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = table(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = table(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a")
        new = small.select("b", "m").where("b <> m").unionByName(least.select(F.col("a").alias("b"), "m")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        new = table(new)
        # Done when every id has one label and no label has one itself.
        n, ids = new.agg(F.count("*"), F.countDistinct("a")).first()
        inner = new.select(F.col("b").alias("a")).join(new, "a", "left_semi").limit(1).count()
        edges = new
        if n == ids and not inner:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("c"))


def _numbered(docs: DataFrame, size: int, percent: int, key: str, text: str) -> DataFrame:
    """classes() by whole numbers that stand in the order of the ids."""
    ids = docs.select(F.col(key).alias("id")).where("id IS NOT NULL").distinct().orderBy("id")
    ids = table(ids.select("id", F.monotonically_increasing_id().alias("number")))
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(ids, "id", "left").select("number", "text")
    out = classes(rows, size, percent, "number", "text")
    first = ids.select(F.col("id").alias("component_id"), F.col("number").alias("c"))
    out = out.withColumnRenamed("component_id", "c").join(ids, "number", "left").join(first, "c", "left")
    return out.select(F.col("id").alias(key), "n_shingles", "component_id")


def classes(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id of every row: documents link from `percent` hundredths of Jaccard similarity on."""
    if docs.schema[key].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        return _numbered(docs, size, percent, key, text)
    spark = docs.sparkSession
    own = lean(docs).select(F.col(key).cast("long").alias("__id"), F.col(text).alias("__t"))
    common = spark.sparkContext.broadcast(_common(own, "__t", size))
    sets = table(_prefixed(own, "__t", size, percent, common))
    # Equal sets: one stands for all.
    alike = table(sets.where("n > 0 AND __id IS NOT NULL").groupBy("one", "two", "n").agg(F.min("__id").alias("rep"), F.min_by("prefix", "__id").alias("prefix")))
    entries = alike.select(F.col("rep").alias("__id"), F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "s"))
    lists = entries.join(entries.groupBy("s").count().where("count > 1").select("s"), "s")
    # Shingles of a prefix in no list: a set with few of them is like others. (Other sets may hold them beyond their prefixes, so they bound nothing.)
    lists = lists.withColumn("alone", F.expr(f"CAST(n - (n * {percent} + 99) DIV 100 + 1 - count(*) OVER (PARTITION BY __id, n) AS INT)"))
    # What may still match from an entry on. At the first shingle that two sets share it bounds all that they share, so
    # a pair that links is met there at the latest, and later lists need not bring it up again.
    # A little wider than the ratio of sizes that may link, so that rounding parts no two.
    block = F.floor(F.log("n") / (max(math.log(100 / percent), 1e-6) * (1 + 1e-9))).cast("int")
    lists = table(lists.select("s", "__id", "n", F.expr("n - pos").alias("rest"), block.alias("block"), "alone"))
    # The leader of a block is the set that is likest to others. Its entry joins the others', so that long blocks are dealt out.
    leaders = lists.groupBy("s", "block").agg(F.min(F.struct("alone", "__id", "n", "rest")).alias("l")).select("s", "block", F.col("l.__id").alias("lead"), F.col("l.n").alias("ln"), F.col("l.rest").alias("lr"))
    lists = table(lists.drop("alone").join(leaders, ["s", "block"]))
    least = lambda n, m: f"({percent} * ({n} + {m}) + {99 + percent}) DIV {100 + percent}"
    fits = lambda n, x, m, y: F.expr(f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m}) AND least({x}, {y}) >= {least(n, m)}")
    led = table(lists.where("lead <> __id").where(fits("n", "rest", "ln", "lr")).select(F.col("lead").alias("a"), F.col("__id").alias("b")).distinct())
    # Texts of sets in lists alone; both sides grow with the corpus, so neither is broadcast at any size.
    some = lists.select("__id").distinct().hint("merge")
    texts = table(own.where("__id IS NOT NULL").hint("merge").join(some, "__id", "left_semi").distinct())
    answers = _verified(led, texts, size, percent)
    found = components(answers.where("linked"))
    # Answers known so far. Ids of several sets have no single number to go by.
    several = alike.groupBy("rep").count().where("count > 1").select("rep")
    shared = answers.join(several, F.col("a") == F.col("rep"), "left_anti").join(several, F.col("b") == F.col("rep"), "left_anti")
    shared = shared.select(F.col("a").alias("lead"), F.col("b").alias("__id"), F.col("shared").alias("k"))
    label = lists.join(found.withColumnRenamed("id", "__id"), "__id", "left").withColumn("c", F.coalesce("c", "__id")).join(shared, ["lead", "__id"], "left")
    label = label.join(several.withColumn("many", F.lit(True)), F.col("__id") == F.col("rep"), "left")
    label = table(label.select("s", "block", "__id", "n", "rest", "c", "lead", "ln", F.when(F.col("lead") != F.col("__id"), F.col("k")).when(F.col("many").isNull(), F.col("ln").cast("long")).alias("k")))
    # Lists within one class are skipped.
    mixed = label.groupBy("s").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("s")
    label = table(label.join(mixed, "s"))
    side = lambda x, *of: label.select("s", *of, *(F.col(c).alias(x + c) for c in ("block", "__id", "n", "rest", "c", "lead", "ln", "k")))
    met = side("a", F.explode(F.array("block", F.col("block") + 1)).alias("at")).join(side("b", F.col("block").alias("at")), ["s", "at"])
    met = met.where("ac < bc OR ac > bc AND ablock < bblock").where(fits("an", "arest", "bn", "brest"))
    need = least("an", "bn")
    surely = f"coalesce(ak + bk - aln >= {need}, false)"
    never = f"coalesce(least(an - ak + bk, bn - bk + ak) < {need}, false)"
    met = met.withColumns({"same": F.expr("alead = blead"), "a": F.col("a__id"), "b": F.col("b__id")})
    met = met.select("a", "b", F.expr(f"CASE WHEN same AND {surely} THEN 1 WHEN same AND {never} THEN -1 ELSE 0 END").alias("known"))
    # A pair may be met in several lists; one that decides it is enough.
    met = table(met.groupBy("a", "b").agg(F.max("known").alias("high"), F.min("known").alias("low")))
    derived = met.where("high = 1").select("a", "b")
    open_ = met.where("high = 0 AND low = 0").select("a", "b")
    cross = _verified(table(open_.join(led, ["a", "b"], "left_anti").join(led.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti")), texts, size, percent)
    # An id's texts are one document.
    whole = F.struct("one", "two", "n")
    mixed = sets.where("n > 0 AND __id IS NOT NULL").groupBy("__id").agg(F.min(whole).alias("low"), F.max(whole).alias("high")).where("low <> high").select("__id")
    owned = sets.select("__id", "one", "two", "n").join(mixed, "__id").join(alike.select("one", "two", "n", "rep"), ["one", "two", "n"]).where("__id <> rep").select(F.col("__id").alias("a"), F.col("rep").alias("b"))
    found = components(cross.where("linked").select("a", "b").unionByName(derived).unionByName(owned), found)
    of = alike.drop("prefix").join(found, F.col("rep") == F.col("id"), "left").select("one", "two", "n", F.coalesce("c", "rep").alias("c"))
    out = sets.join(of, ["one", "two", "n"], "left")
    return out.select(F.col("__id").cast(docs.schema[key].dataType).alias(key), F.col("n").alias("n_shingles"), F.when(F.col("__id").isNotNull(), F.coalesce("c", "__id")).cast(docs.schema[key].dataType).alias("component_id"))
