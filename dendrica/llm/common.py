"""What the training-data operators share: tables, shared scratch, let-bindings."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words, as a regex class body (Java, RE2 and Python read it alike).
WS = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local one only where none is named (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = f"file://{tempfile.mkdtemp(prefix='dendrica-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named


#: Scratch tables by owner; None owns none.
_OWNED: dict[str, list[str]] = {}
_OWNER: list[str] = []


@contextmanager
def owned(owner: str) -> Iterator[None]:
    """Tables written inside belong to owner."""
    _OWNER.append(owner)
    try:
        yield
    finally:
        _OWNER.pop()


def release(owner: str, docs: DataFrame) -> None:
    """Delete owner's tables that docs does not read, and let go of shuffles that nothing refers to."""
    spark, held = docs.sparkSession, _OWNED.get(owner, [])
    read = docs.inputFiles() if held else []
    for path in [p for p in held if not any(p.rsplit("/", 1)[1] in f for f in read)]:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        held.remove(path)
    spark._jvm.System.gc()


def passing(spark: SparkSession, path: str) -> str:
    """path, deleted when the JVM ends."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def table(df: DataFrame) -> DataFrame:
    """Write df into the shared folder and read it back: cuts lineage, survives lost executors.

    The files go when the JVM ends.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    if _OWNER:
        _OWNED.setdefault(_OWNER[-1], []).append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(passing(spark, path))


def lean(df: DataFrame, records: int = 2000) -> DataFrame:
    """df, with its session's Arrow batches at most `records` long: whole texts of 10,000 rows, Spark's default, are too much for small workers."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf.set(name, str(min(records, int(conf.get(name)) or records)))
    return df


def free(name: str, columns: list[str]) -> str:
    """name, lengthened until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def apart(df: DataFrame, taken: tuple[str, ...], without: str | None = None) -> list[Column]:
    """Columns of df, but one; a name that is taken is lengthened until neither the result nor df has it."""
    used, out = [*taken, *df.columns], []
    for c in df.columns:
        if c == without:
            continue
        name = c
        if c.lower() in {t.lower() for t in taken}:
            used.append(name := free(c, used))
        out.append(F.col(f"`{c}`").alias(name))
    return out


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
