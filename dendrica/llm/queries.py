"""The operators over the driver's tables, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, jaccard, lines, lm, packing, quality, secret_scan, shards, urls
from .common import WS, load, table, text_of


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup(docs).select("doc_id", F.col("__gone").alias("n_removed"), F.sha2(F.col("text"), 256).alias("text_sha256"), F.length("text").cast("long").alias("n_chars"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", lm.held_out())
    return lm.fit_score(docs, ~F.col("held_out"), keep=("held_out",))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scan(load(spark, sf_dir, "documents")))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents, stored: policies and ablations read it, and no text again."""
    return table(quality.ledger(load(spark, sf_dir, "documents").select("doc_id", "text")))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = _ledger(spark, sf_dir)
    shown = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return led.select("doc_id", *shown, quality.failed("base").alias("base_failed"), (~quality.failed(quality.PRODUCTION)).alias("kept"), "fail_bits")


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the production policy rejects, and what it alone rejects."""
    return quality.ablation(_ledger(spark, sf_dir))


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    slim = docs.select("doc_id", (F.octet_length(text_of()) + 16).cast("long").alias("size"), F.crc32(text_of()).alias("text_crc32"))
    return shards.shuffle_into_shards(slim).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(load(spark, sf_dir, "pages"), load(spark, sf_dir, "labels")).select("page_id", "host", "path", "rule", "verdict", F.round("bad_mean", 6).alias("bad_mean"), F.round("bad_lower", 6).alias("bad_lower"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(load(spark, sf_dir, "documents"), size=4, percent=85)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(load(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(load(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_line_dedup, op2_lm_scoring, op3_secret_scan, op4_nearest, op5_quality_rules, op6_shards, op7_url_filter, op8_jaccard_join, op9_bpe, op10_packing, quality_ablation)
    return {f.__name__: f for f in ops}


#: The order of lines is that of the operator but for rows of equal doc_id.
OP1 = rf"""
WITH l AS (
  SELECT doc_id, no, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS v, line
  FROM (SELECT doc_id, generate_subscripts(x, 1) AS no, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))),
f AS (SELECT v, min((doc_id, no)) AS o, length(v) AS n FROM l WHERE v <> '' GROUP BY v),
s AS (SELECT v, o, n, n // 2 AS h, left(v, n // 2) AS a, right(v, n - n // 2) AS b, left(v, (n - 1) // 2) AS c, right(v, n - 1 - (n - 1) // 2) AS d FROM f WHERE n >= {lines.LEAST}),
p AS (
  SELECT x.v AS v, y.v AS w, x.o AS s, y.o AS t FROM s x JOIN s y ON x.n = y.n AND x.a = y.a AND x.v <> y.v
  UNION ALL SELECT x.v, y.v, x.o, y.o FROM s x JOIN s y ON x.n = y.n AND x.b = y.b AND x.v <> y.v
  UNION ALL SELECT x.v, y.v, x.o, y.o FROM s x JOIN s y ON x.n + 1 = y.n AND x.a = y.c
  UNION ALL SELECT x.v, y.v, x.o, y.o FROM s x JOIN s y ON x.n + 1 = y.n AND x.b = y.d),
near AS (SELECT DISTINCT CASE WHEN s < t THEN w ELSE v END AS v FROM p WHERE levenshtein(v, w) <= {lines.EDITS}),
marked AS (
  SELECT l.doc_id, l.no, l.line, l.v <> '' AND ((l.doc_id, l.no) > f.o OR near.v IS NOT NULL) AS gone
  FROM l LEFT JOIN f ON l.v = f.v LEFT JOIN near ON l.v = near.v),
d AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT coalesce(gone, false)), '') AS t FROM marked GROUP BY doc_id)
SELECT doc_id, n_removed, sha256(t) AS text_sha256, length(t) AS n_chars FROM d
UNION ALL SELECT doc_id, 0, NULL, NULL FROM documents WHERE text IS NULL
"""

OP5 = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[{WS}]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{WS}]')) AS l FROM t),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 6), lambda i: list_slice(w, i, i + 7))) AS g, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) > 8),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines
      FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
        CAST({" + ".join(f"CASE WHEN {fails} THEN {quality.BITS[name]} ELSE 0 END" for name, fails in quality.RULES)} AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""


ABLATION = f"""
WITH o AS ({OP5}), r AS (SELECT unnest([{", ".join(f"'{r}'" for r in quality.POLICIES[quality.PRODUCTION])}]) AS rule, unnest([{", ".join(str(quality.BITS[r]) for r in quality.POLICIES[quality.PRODUCTION])}]) AS bit)
SELECT rule, count(*) FILTER (fail_bits & bit <> 0) AS n_failed, count(*) FILTER (fail_bits & {quality.mask_of(quality.PRODUCTION)} = bit) AS n_only FROM r, o GROUP BY rule
HAVING (SELECT count(*) FROM o) > 0
"""


def _level(name: str) -> str:
    """SQL for the prior strength of a level, as urls._strength has it."""
    return f"""
m_{name} AS (SELECT CASE WHEN n IS NULL OR k < 2 OR v = 0 THEN 2.0 ELSE 1 / r - 1 END AS m FROM (
  SELECT *, least(greatest(CASE WHEN n - nn / n > k - 1 THEN (s - v / n * (k - 1)) / (v / n * (n - nn / n - (k - 1))) ELSE 0 END, 0.01), 0.9) AS r FROM (
    SELECT CAST(sum(n) AS DOUBLE) AS n, CAST(sum(n * n) AS DOUBLE) AS nn, CAST(count(*) AS DOUBLE) AS k, sum(n * pow(b / n - prior, 2)) AS s, sum(n * prior * (1 - prior)) AS v
    FROM p_{name} WHERE n > 0))),"""


def _below(name: str, above: str) -> str:
    """SQL for the priors of a level."""
    return f"""
p_{name} AS (SELECT x.*, (m * u.prior + u.b - x.b) / (m + u.n - x.n) AS prior FROM {name} x JOIN p_{above} u ON x.{above} = u.{above}, m_{above}),"""


def _rule_sql(what: str) -> str:
    out = "NULL"
    for v, h, p in sorted(urls.RULES, key=lambda r: len(r[1] + r[2])):
        out = f"CASE WHEN (host = '{h}' OR suffix(host, '.{h}')) AND prefix(path, '{p}') THEN '{h + p if what == 'rule' else v}' ELSE {out} END"
    return out


_TWO = ", ".join(f"'{s}'" for s in urls.SUFFIXES)
OP7 = rf"""
WITH u AS (SELECT page_id, coalesce(regexp_extract(url, '^(?s:.*?)://((?s:.*))$', 1), '') AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
l AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
h0 AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS b, string_split(host, '.') AS x FROM p LEFT JOIN l ON page_id = doc_id GROUP BY host),
h1 AS (SELECT *, array_to_string(x[-2:], '.') AS last2, array_to_string(x[-3:], '.') AS last3 FROM h0),
host AS (SELECT host, n, b, CASE WHEN last2 IN ({_TWO}) THEN last3 ELSE last2 END AS domain, CASE WHEN last2 IN ({_TWO}) THEN last2 ELSE x[-1] END AS suffix FROM h1),
domain AS (SELECT domain, suffix, sum(n) AS n, sum(b) AS b FROM host GROUP BY ALL),
suffix AS (SELECT suffix, sum(n) AS n, sum(b) AS b FROM domain GROUP BY ALL),
p_suffix AS (SELECT x.*, (t.b - x.b + 1) / (t.n - x.n + 2) AS prior FROM suffix x, (SELECT CAST(sum(n) AS DOUBLE) AS n, CAST(sum(b) AS DOUBLE) AS b FROM suffix) t),
{_level("suffix")}{_below("domain", "suffix")}{_level("domain")}{_below("host", "domain")}{_level("host")}
post AS (SELECT host, (m * prior + b) / (m + n) AS mean, m + n AS total FROM p_host, m_host),
bound AS (SELECT host, mean, {urls.lower_bound("mean", "total")} AS lower FROM post)
SELECT page_id, p.host, path, {_rule_sql("rule").replace("host", "p.host")} AS rule,
  coalesce({_rule_sql("verdict").replace("host", "p.host")}, CASE WHEN lower > {urls.THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict, round(mean, 6) AS bad_mean, round(lower, 6) AS bad_lower
FROM p LEFT JOIN bound ON p.host = bound.host
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1, "op5_quality_rules": OP5, "op7_url_filter": OP7, "quality_ablation": ABLATION}
