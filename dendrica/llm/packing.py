"""Packing along a space-filling curve.

A document's token counts, hashed to a fixed width, are projected to three
dimensions; their Hilbert key orders the corpus so that documents with like words
lie together. Documents are laid end to end along the curve and cut every
`length` tokens, so only the last sequence is padded.

Only (row, tokens, key) is sorted by range; ids are written once and meet their
places in one join by row. Null and empty texts are the end id alone; repeated
rows and ties of the key go by row number; a null doc_id stays; an empty table
gives no pieces; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, table
from .tokens import default_path, slices, word_ids

LENGTH, END = 2048, 1
WIDTH, DIMS, BITS, SEED = 1024, 3, 16, 7
#: Range partitions of the layout, at most; their totals go to the driver.
RANGES = 1024


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of integer points, an array of (n, dims), by Skilling's transform (2004)."""
    x = points.astype(np.int64).T.copy()
    dims, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    """Hilbert keys of documents given by ids; dense vectors of a few documents at a time."""
    project = np.random.default_rng(SEED).standard_normal((WIDTH, DIMS))
    place = np.zeros((len(ids), DIMS))
    for i, x in enumerate(ids):
        v = np.sqrt(np.bincount(x & (WIDTH - 1), minlength=WIDTH))
        place[i] = v @ project / max(np.linalg.norm(v), 1e-9)
    # The logistic curve spreads normal values evenly enough over the unit interval.
    return hilbert(np.minimum((1 / (1 + np.exp(-1.7 * place)) * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def tokenized(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end: int = END) -> DataFrame:
    """row, key, tokens, curve, ids (zstd of the tokenizer's word size), written out."""
    schema = f"`__row` bigint, `{key}` {docs.schema[key].dataType.simpleString()}, `__n` bigint, `__curve` bigint, `__ids` binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, codec = word_ids(path), pa.Codec("zstd", compression_level=1)
        last = model.kind.type(end)
        for whole in batches:
            for b in slices(whole, 2):
                ids = [np.append(x, last) for x in model.texts(b.column(2))]
                packed = [codec.compress(x.tobytes(), asbytes=True) for x in ids]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x) for x in ids], pa.int64()), pa.array(curve_keys(ids)), pa.array(packed, pa.binary())], ["__row", key, "__n", "__curve", "__ids"])

    return table(lean(docs).select(F.monotonically_increasing_id().alias("__row"), key, F.col(text)).mapInArrow(run, schema))


def laid_out(rows: DataFrame) -> DataFrame:
    """__row, __at: where each document begins when all lie end to end along the curve."""

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.column("__n").to_numpy()
            ends = total + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([b.column("__row"), pa.array(np.full(len(n), part)), pa.array(ends - n), pa.array(ends)], ["__row", "__part", "__begin", "__end"])
            total = int(ends[-1]) if len(ends) else total

    spark = rows.sparkSession
    ranges = min(RANGES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.select("__row", "__n", "__curve").repartitionByRange(ranges, "__curve", "__row").sortWithinPartitions("__curve", "__row")
    local = table(ordered.mapInArrow(running, "`__row` bigint, `__part` bigint, `__begin` bigint, `__end` bigint"))
    totals = sorted((r[0], r[1]) for r in local.groupBy("__part").agg(F.max("__end")).collect())  # a row for each range
    base, starts = 0, []
    for part, n in totals:
        starts.append((part, base))
        base += n
    offsets = spark.createDataFrame(starts, "`__part` bigint, `__base` bigint")
    return local.join(F.broadcast(offsets), "__part").select("__row", (F.col("__base") + F.col("__begin")).alias("__at"))


def pack(docs: DataFrame, length: int = LENGTH, path: str | None = None, key: str = "doc_id", text: str = "text", end: int = END) -> DataFrame:
    """A row for each piece: key, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    path = path or default_path()
    rows = tokenized(docs, path, key, text, end)
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, codec = word_ids(path).kind, pa.Codec("zstd")
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                b = whole.slice(i, 256)
                doc, start, size, ids, total, seq, off = [], [], [], [], [], [], []
                for k, n, z, at in zip(*(b.column(c).to_pylist() for c in (key, "__n", "__ids", "__at")), strict=True):
                    raw, done = np.frombuffer(codec.decompress(z, n * kind.itemsize, asbytes=True), kind), 0
                    while done < n:
                        take = min(n - done, length - (at + done) % length)
                        doc.append(k)
                        start.append(done)
                        size.append(take)
                        ids.append(raw[done : done + take].astype("<u4").tobytes())
                        total.append(n)
                        seq.append((at + done) // length)
                        off.append((at + done) % length)
                        done += take
                longs = [pa.array(x, pa.int64()) for x in (total, seq, off)]
                yield pa.RecordBatch.from_arrays([pa.array(doc, b.schema.field(key).type), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(ids, pa.binary()), *longs], [key, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return rows.join(laid_out(rows), "__row").select(key, "__n", "__ids", "__at").mapInArrow(run, schema)
