"""Quality rules as a bitmask ledger.

Every rule is evaluated once a document; its failure is one bit, its
measurements are columns. Policies are versioned sets of rules applied to the
stored bits afterwards, and ablations are bit arithmetic over groups of equal
masks, so neither reads a text again.

Null and empty texts have no words and fail `few_words`; a null doc_id stays as
it is; repeated rows are judged each on its own; an empty table gives an empty
ledger. All other columns come along, whatever their names: one that is named
like a measurement (MEASURED) or `fail_bits` has its name lengthened by `_`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, apart, let, text_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: (name, failure as SQL over the measurements); the place in the list is the bit.
RULES = [
    ("few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "n_lines > 3 AND 2 * n_dup_lines > n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
]
MEASURED = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: Versions are never changed, only added.
POLICIES = {
    "base": ["few_words", "repeated_words"],
    "v1": ["few_words", "repeated_words", "symbols", "repeated_lines"],
    "v2": [name for name, _ in RULES],
}
PRODUCTION = "v2"


def mask_of(policy: str) -> int:
    return sum(BITS[name] for name in POLICIES[policy])


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of WINDOW words found twice or more in the text."""

    def marked(grams: Column) -> Column:
        ordered = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def twins(s: Column) -> Column:
            near = lambda x, j: F.coalesce(F.get(s, j)["g"] == x["g"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda x, k: near(x, k - 1) | near(x, k + 1)), lambda x: x["i"]))

        def covered(at: Column) -> Column:
            gaps = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(let(let(ordered, twins), covered))

    def grams(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))

    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(let(let(F.transform(words, lambda w: F.xxhash64(w)), grams), marked))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without its text, with the measurements and `fail_bits`."""
    t = text_of(text)
    words = F.filter(F.split(t, f"[{WS}]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, " \t\n\x0b\x0c\r", "") != "")
    measured = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    doc = F.struct(*apart(docs, (*MEASURED, "fail_bits"), without=text), F.lit(0))
    out = docs.select(
        doc.alias("doc"),
        measured.alias("w"),
        of_lines.alias("l"),
        F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    out = out.select("doc", "w.*", "l.*", "word_chars", "n_symbols")
    bits = sum((F.when(F.expr(fails), F.lit(BITS[name])).otherwise(0) for name, fails in RULES), F.lit(0))
    names = [f.name for f in out.schema["doc"].dataType.fields[:-1]]
    return out.select(*(F.col("doc").getField(c).alias(c) for c in names), *MEASURED, bits.cast("long").alias("fail_bits"))


def failed(policy: str) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask_of(policy))) != 0


def ablation(led: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """A row for each rule of the policy: documents that fail it, and those that only it rejects.

    Rows with equal bits are counted before the rules are laid beside them, so
    at most 2 to the number of rules rows are exploded.
    """
    masks = led.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask_of(policy))).alias("m")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(BITS[r]).cast("long").alias("bit")) for r in POLICIES[policy])))
    return (
        masks.select("m", "n", rules.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("m").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("m") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
        )
    )


def keep_good(docs: DataFrame, policy: str = PRODUCTION, text: str = "text") -> DataFrame:
    """The rows of docs that pass the policy, with their columns."""
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col(text).alias("text"))
    return ledger(whole).where(~failed(policy)).select("doc.*")
