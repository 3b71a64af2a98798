"""Language-model scoring: word counts, and a causal self-attention model over subword ids.

The attention model predicts the class of the next subword id (classes: word-final
or not, then by frequency) from the ids before it; an id's share of its class
comes from counts over the whole training corpus. A text is cut into blocks of
SPAN ids. A window is two blocks: the later one's ids are predicted, each by
attention over those ids of both blocks that stand before it, so windows overlap
by half, each id is scored once and sees SPAN ids before it at least (or its
text's beginning). Many windows go at once under one causal mask, with a learnt
weight for each distance.

Weights are trained in numpy on every id of every training text, once. Texts
are dealt by hash into rounds, and in a round into shards of about SHARD ids;
shards of a round train side by side from the same weights and sums of squares,
and their mean goes on. Shards, their order and their batches follow from the
rows alone, and means are sums of whole numbers, so no setting of the cluster
changes a score.

The word model beside it is the add-one unigram model over all training words.
Counts of words never gather in one place: a bounded number of the most frequent
(BROADCAST words and BROADCAST_BYTES at most) goes to every worker, the rest
meets the texts in a join by word.

Null and empty texts are the end token alone. A null key counts as training.
Repeated rows are learnt from and scored each. Without training documents counts
are zero, all ids are equally likely in their class and classes in any context.
Columns that are not named in `keep` are left out; those named come back as they
are, but for names that the result has itself, which are refused.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, table, text_of
from .tokens import WordIds, default_path, placed, slices, split_words, trim, word_ids

END = 1
CLASSES, BUCKETS, DIM, SPAN = 32, 4096, 8, 16
#: The bucket of places before and after a text, and their id.
VOID, NONE = BUCKETS, -1
#: Windows of a step; its rate.
STEP, RATE = 128, 0.2
#: Ids of a shard, about; sixteenths of the training texts in each round.
SHARD, ROUNDS = 1 << 19, (1, 3, 12)
#: Words that every worker holds at most, and their bytes.
BROADCAST, BROADCAST_BYTES = 1 << 18, 16 << 20
#: Bytes of texts whose words are counted together.
COUNTED = 8 << 20


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 7 == 2


# --- the attention model -------------------------------------------------------


def fresh(seed: int = 0) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    shape = {"emb": (BUCKETS, DIM), "wq": (DIM, DIM), "wk": (DIM, DIM), "wv": (DIM, DIM), "wo": (DIM, CLASSES)}
    out = {k: rng.normal(0, 0.3, s).astype(np.float32) for k, s in shape.items()}
    return out | {"bo": np.zeros(CLASSES, np.float32), "near": np.zeros(2 * SPAN, np.float32)}


def flat(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([v.ravel() for v in w.values()])


def shaped(a: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, v in fresh().items():
        out[k] = a[at : at + v.size].reshape(v.shape).astype(np.float32)
        at += v.size
    return out


#: How far a query of the later block stands behind each key of a window; what lies ahead is masked.
GAP = SPAN + np.arange(SPAN)[:, None] - np.arange(2 * SPAN)
AHEAD = np.where(GAP < 0, np.float32(-1e9), np.float32(0))
GAP = np.maximum(GAP, 0)
SCALE = np.float32(1 / math.sqrt(DIM))
LIMIT, LOWEST = 60.0, 1e10


def _windows(a: np.ndarray, n: int, low: int, high: int) -> np.ndarray:
    """n windows of two blocks each, of some columns, over rows that stand block after block; no copy."""
    row, one = a.strides
    return np.ndarray((n, 2 * SPAN, high - low), a.dtype, a, low * one, (SPAN * row, row, one))


def _softmax(z: np.ndarray, times: np.ndarray | np.float32) -> np.ndarray:
    """exp of z, each row scaled to add up to `times`, in place."""
    np.exp(np.clip(z, -LOWEST, LIMIT, out=z), out=z)
    z *= (times / (z @ np.ones(z.shape[-1], np.float32)))[..., None]
    return z


def gradients(w: dict, ids: np.ndarray, target: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the mean loss over targets that are not NONE: of the weights but emb, and of each place's embedding.

    ids: buckets of blocks, the first of which gives context alone; target: classes for the others. Void has the embedding 0.
    """
    n, size, counted = len(ids) // SPAN - 1, len(ids), (target >= 0).astype(np.float32)
    counted /= max(1.0, float(counted.sum()))
    x = np.concatenate([w["emb"], np.zeros((1, DIM), np.float32)]).take(ids, 0)
    cur, pair = x[SPAN:], np.concatenate([w["wk"], w["wv"]], 1)
    kv, q = x @ pair, (cur @ (w["wq"] * SCALE)).reshape(n, SPAN, DIM)
    kw, vw = _windows(kv, n, 0, DIM), _windows(kv, n, DIM, 2 * DIM)
    a = q @ kw.transpose(0, 2, 1)
    a += w["near"][GAP] + AHEAD
    _softmax(a, np.float32(1))
    y = (a @ vw).reshape(-1, DIM)
    y += cur
    p = y @ w["wo"]
    p += w["bo"]
    _softmax(p, counted)
    p.ravel()[np.arange(len(p)) * CLASSES + np.maximum(target, 0)] -= counted
    g = {"wo": y.T @ p, "bo": np.ones(len(p), np.float32) @ p}
    dy = p @ w["wo"].T
    dy3 = dy.reshape(n, SPAN, DIM)
    ds = dy3 @ vw.transpose(0, 2, 1)
    ds -= np.einsum("bij,bij->bi", ds, a)[:, :, None]
    ds *= a
    dq = (ds @ kw).reshape(-1, DIM)
    dq *= SCALE
    both = np.zeros((2, n + 1, SPAN, DIM), np.float32)
    for d, left, right in ((both[0], ds, q), (both[1], a, dy3)):  # a block is the later one of a window, and the earlier one of the next
        dw = left.transpose(0, 2, 1) @ right
        d[:-1] += dw[:, :SPAN]
        d[1:] += dw[:, SPAN:]
    dk, dv = both.reshape(2, size, DIM)
    dnear = (np.ones(n, np.float32) @ ds.reshape(n, -1)).reshape(SPAN, -1) * (AHEAD == 0)
    g |= {"wq": cur.T @ dq, "wk": x.T @ dk, "wv": x.T @ dv, "near": np.bincount(GAP.ravel(), dnear.ravel(), 2 * SPAN).astype(np.float32)}
    dx = dk @ w["wk"].T
    dx += dv @ w["wv"].T
    dy += dq @ w["wq"].T
    dx[SPAN:] += dy
    return g, dx


def step(w: dict, seen: dict, ids: np.ndarray, target: np.ndarray, rate: float) -> None:
    """One step of Adagrad over blocks laid out; seen: sums of squares."""
    g, dx = gradients(w, ids, target)
    by = dx.T.astype(np.float64)
    g["emb"] = np.stack([np.bincount(ids, d, BUCKETS + 1)[:BUCKETS] for d in by], 1).astype(np.float32)
    for k, d in g.items():
        d *= 10
        seen[k] += d * d
        d /= np.sqrt(seen[k])
        d *= rate
        w[k] -= d


def laid_out(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Input ids and target ids of texts (ids, cut at `at`), and where each text's blocks begin.

    Each text has a block of void before it, then the end id and its own ids, filled up with void; targets are its ids and the end id.
    """
    sizes = np.diff(at)
    blocks = -(-(sizes + 1) // SPAN) + 1
    begin = np.concatenate([[0], np.cumsum(blocks)]) * SPAN
    start = begin[:-1] + SPAN
    given, target = np.full(begin[-1], NONE, np.int64), np.full(begin[-1], NONE, np.int64)
    place = np.repeat(start - (at[:-1] - at[0]), sizes) + np.arange(at[-1] - at[0])
    target[place] = given[place + 1] = ids[at[0] : at[-1]]
    given[start] = target[start + sizes] = END
    return given, target, begin


class Trainer:
    """Steps over a stream of laid-out texts, cut alike however they come in."""

    def __init__(self, w: dict, seen: dict, rate: float) -> None:
        self.w, self.seen, self.rate = {k: v.copy() for k, v in w.items()}, {k: v.copy() for k, v in seen.items()}, rate
        self.ids, self.target = np.full(SPAN, VOID), np.full(SPAN, NONE)

    def feed(self, ids: np.ndarray, target: np.ndarray, last: bool = False) -> None:
        self.ids, self.target = np.concatenate([self.ids, ids]), np.concatenate([self.target, target])
        at, size = 0, STEP * SPAN
        while len(self.ids) - at >= size + SPAN or last and len(self.ids) - at > SPAN:
            some = self.target[at + SPAN : at + SPAN + size]
            step(self.w, self.seen, self.ids[at : at + SPAN + len(some)], some, self.rate)
            at += len(some)
        self.ids, self.target = self.ids[at:], self.target[at:]


class Scorer:
    """Log10 probabilities of texts of ids."""

    def __init__(self, w: dict, classes: np.ndarray, share: np.ndarray, bucket: np.ndarray) -> None:
        # Projections are linear, so those of every bucket are kept: query, key, value and a one, class logits.
        x = np.concatenate([w["emb"], np.zeros((1, DIM), np.float32)])
        one = np.ones((len(x), 1), np.float32)
        self.table = np.concatenate([x @ w["wq"] * SCALE, x @ w["wk"], x @ w["wv"], one, x @ w["wo"] + w["bo"]], 1)
        self.bias, self.wo, self.ones = w["near"][GAP] + AHEAD, w["wo"], np.ones(CLASSES, np.float32)
        self.classes, self.share, self.bucket = np.append(classes, 0), np.append(share, 0.0), np.append(bucket, VOID)

    def blocks(self, ids: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each target class; ids: buckets of one block more."""
        n = len(ids) // SPAN - 1
        r = self.table.take(ids, 0)
        cur = r[SPAN:]
        a = cur[:, :DIM].reshape(n, SPAN, DIM) @ _windows(r, n, DIM, 2 * DIM).transpose(0, 2, 1)
        a += self.bias
        np.exp(np.clip(a, -LOWEST, LIMIT, out=a), out=a)
        h = (a @ _windows(r, n, 2 * DIM, 3 * DIM + 1)).reshape(-1, DIM + 1)  # the ones add up the weights
        z = (h[:, :DIM] / h[:, DIM:]) @ self.wo
        z += cur[:, 3 * DIM + 1 :]
        np.clip(z, -LIMIT, LIMIT, out=z)
        picked = z.ravel()[np.arange(len(z)) * CLASSES + target]
        return picked - np.log(np.exp(z, out=z) @ self.ones)

    def texts(self, ids: np.ndarray, at: np.ndarray, chunk: int = 128) -> np.ndarray:
        """Score of each text of ids, cut at `at`, with its end."""
        given, target, begin = laid_out(ids, at)
        x, got = self.bucket[given], np.zeros(len(given))
        for i in range(SPAN, len(x), chunk * SPAN):
            t = target[i : i + chunk * SPAN]
            got[i : i + len(t)] = np.where(t >= 0, self.blocks(x[i - SPAN : i + len(t)], self.classes[t]) / math.log(10) + self.share[t], 0.0)
        return np.add.reduceat(got, begin[:-1]) if len(at) > 1 else np.zeros(0)


def classed(counts: np.ndarray, final: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each id (half the classes for word-final ids, by equal mass), log10 of its share in the class, and its bucket: one of its own for frequent ids."""
    classes, half = np.zeros(len(counts), np.int64), CLASSES // 2
    for side in (0, 1):
        ids = np.flatnonzero(final == bool(side))
        ids = ids[np.argsort(-counts[ids], kind="stable")]
        # By the square root of counts, so that the frequent ones do not share.
        mass = np.cumsum(np.sqrt(counts[ids] + 0.01))
        classes[ids] = side * half + np.minimum((mass - mass[0]) / max(mass[-1], 1e-9) * half, half - 1).astype(np.int64) if len(ids) else 0
    smooth, rank, own = counts + 0.5, np.empty(len(counts), np.int64), BUCKETS * 3 // 4
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
    return classes, np.log10(smooth / np.bincount(classes, smooth, CLASSES)[classes]), np.where(rank < own, rank, own + rank % (BUCKETS - own))


# --- over the corpus -----------------------------------------------------------


@dataclass
class Model:
    path: str
    words: DataFrame  # word, c: the whole vocabulary
    tokens: int  # words and ends in training
    distinct: int
    ends: int
    top: object = None  # Spark broadcast of (a mark, words, log10(c + 1))
    weights: np.ndarray = field(default_factory=lambda: flat(fresh()))
    classes: np.ndarray = field(default_factory=lambda: np.zeros(0))
    share: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bucket: np.ndarray = field(default_factory=lambda: np.zeros(0))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of texts, and how often each stands in a part of the texts."""
    for whole in batches:
        for b in slices(whole, 0, COUNTED):
            words, codes, _ = split_words(b.column(0))
            yield pa.RecordBatch.from_arrays([words.cast(pa.string()).cast(pa.binary()), pa.array(np.bincount(codes, minlength=len(words)))], ["word", "c"])


def vocabulary(docs: DataFrame, text: str = "text", path: str | None = None) -> Model:
    """Counts of all words of docs."""
    docs = lean(docs)
    words = table(docs.select(text).mapInArrow(_counted, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c")))
    level = F.floor(F.log2("c") * 8).cast("int")
    size = F.sum(F.octet_length("word").cast("long"))
    levels = sorted(words.groupBy(level.alias("l")).agg(F.count("*").alias("v"), F.sum("c").alias("c"), size.alias("bytes")).collect(), reverse=True)  # 8 rows a power of two
    ends = docs.count()
    model = Model(path or default_path(), words, sum(r["c"] for r in levels) + ends, sum(r["v"] for r in levels) + (ends > 0), ends)
    least, v, held = None, 0, 0
    for r in levels:
        v, held = v + r["v"], held + r["bytes"]
        if v > BROADCAST or held > BROADCAST_BYTES:
            break
        least = r["l"]
    top = words.where(level >= least).select("word", F.log10(F.col("c") + 1).alias("c")).toArrow() if least is not None else pa.table({"word": pa.array([], pa.binary()), "c": pa.array([], pa.float64())})
    order = top.sort_by("word")
    model.top = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, order["word"].combine_chunks().cast(pa.string()).cast(pa.large_string()), order["c"].to_numpy()))
    return model


def read(docs: DataFrame, model: Model, kept: tuple[str, ...], text: str = "text") -> DataFrame:
    """Each row's kept columns, its subword ids, and what the most frequent words give to its base score; the others in __rest."""
    own = {"__row", "__ids", "__size", "__hits", "__base", "__rest", "n_tokens", "n_known", "train_tokens", "base_score", "score"}
    if bad := own & set(kept):
        raise ValueError(f"columns of the result itself: {sorted(bad)}")
    top, path = model.top, model.path
    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (mark, often, value), ids = top.value, word_ids(path)
        held = _often(ids, path, mark, often)
        for whole in batches:
            for b in slices(whole, len(kept) + 1):
                w = ids.batch(b.column(len(kept) + 1), often, held)
                words = pc.ascii_lower(w.words)  # texts that may name special tokens keep their case for them
                place = w.place if words.equals(w.words) else placed(words, often)
                n = np.diff(w.word_at)
                of = np.repeat(np.arange(len(n)), n)
                known = (place >= 0)[w.codes]
                logs = np.append(value, 0.0)[place][w.codes]
                rest_at = np.concatenate([[0], np.cumsum(np.bincount(of[~known], minlength=len(n)))]).astype(np.int32)
                rest = pa.ListArray.from_arrays(pa.array(rest_at), words.cast(pa.string()).cast(pa.binary()).take(pa.array(w.codes[~known])))
                raw = w.ids.astype("<u4")
                whole_ids = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer((w.id_at * 4).astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())
                cols = [whole_ids, pa.array(np.diff(w.id_at) + 1, pa.int64()), pa.array(n + 1, pa.int64()), pa.array(np.bincount(of[known], minlength=len(n)), pa.int64()), pa.array(np.bincount(of, logs, len(n)), pa.float64()), rest]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(kept) + 1], *cols], ["__row", *kept, "__ids", "__size", "n_tokens", "__hits", "__base", "__rest"])

    rows = lean(docs).select(F.monotonically_increasing_id().alias("__row"), *kept, F.col(text))
    return table(rows.mapInArrow(run, f"`__row` bigint, {types}, `__ids` binary, `__size` bigint, n_tokens bigint, `__hits` bigint, `__base` double, `__rest` array<binary>"))


#: Ids of the most frequent words, of one model a worker.
_HELD: dict[tuple[str, str], tuple[np.ndarray, np.ndarray]] = {}


def _often(ids: WordIds, path: str, mark: str, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if (path, mark) not in _HELD:
        _HELD.clear()
        _HELD[path, mark] = ids.encoded(words)
    return _HELD[path, mark]


def _ids_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts and where each text's begin."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] // 4
    data = column.buffers()[2]
    ids = np.frombuffer(data, "<u4")[at[0] : at[-1]].astype(np.int64) if data is not None and at[-1] > at[0] else np.zeros(0, np.int64)
    return ids, at - at[0]


def _id_counts(rows: DataFrame, size: int) -> np.ndarray:
    """Occurrences of each id in texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(_ids_of(b.column(0))[0], minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], ["id", "n"])

    got = rows.select("__ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # a row for each id of the vocabulary at most
    out = np.zeros(size)
    out[got["id"].to_numpy()] = got["n"].to_numpy()
    return out


#: Weights and sums of squares as whole numbers, so that their sums do not depend on the order.
FIXED = (1 << 32, 1 << 20)


def _mean(sums: DataFrame, fan: int = 32) -> tuple[np.ndarray, np.ndarray] | None:
    """Means of w and seen over rows (g, w, seen, n), added up `fan` rows at a time."""

    def added(key, t):
        total = [sum(np.frombuffer(x.as_py(), np.int64) for x in t.column(c)) for c in ("w", "seen")]
        return pa.table({"g": pa.array([key[0].as_py()], pa.int32()), "w": pa.array([total[0].tobytes()], pa.binary()), "seen": pa.array([total[1].tobytes()], pa.binary()), "n": pa.array([pc.sum(t.column("n")).as_py()], pa.int64())})

    parts = sums.agg(F.max("g")).first()[0]
    while parts is not None and parts >= fan:
        sums, parts = sums.groupBy((F.col("g") / fan).cast("int").alias("part")).applyInArrow(added, sums.schema), parts // fan
    rows = sums.collect()  # `fan` rows at most
    if not rows:
        return None
    n = sum(r["n"] for r in rows)
    return tuple((sum(np.frombuffer(bytes(r[c]), np.int64) for r in rows) / n / scale).astype(np.float32) for c, scale in zip(("w", "seen"), FIXED, strict=True))


def _trained(rows: DataFrame, key: str, bucket: np.ndarray, classes: np.ndarray, shard: int = SHARD) -> np.ndarray:
    """Weights after all rounds over rows(key, __row, __ids, __size)."""
    bucket, classes = np.append(bucket, VOID), np.append(classes, NONE)
    w, seen = flat(fresh()), np.full(flat(fresh()).size, 1e-3, np.float32)
    # Rows without a key may be alike, so their places deal them.
    mark = F.xxhash64(F.col(key).cast("string"), "__ids", F.when(F.col(key).isNull(), F.col("__row")))
    dealt = rows.select("__ids", "__size", mark.alias("mark")).withColumn("part", F.pmod(F.xxhash64("mark"), F.lit(sum(ROUNDS))))
    sizes = {r["part"]: r["n"] for r in dealt.groupBy("part").agg(F.sum("__size").alias("n")).collect()}  # 16 rows
    low = 0
    for many in ROUNDS:
        some, ids = dealt.where(F.col("part").between(low, low + many - 1)), sum(sizes.get(p, 0) for p in range(low, low + many))
        low += many
        if not ids:
            continue

        def run(batches: Iterator[pa.RecordBatch], w: np.ndarray = w, seen: np.ndarray = seen) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            now, trainer, total, n = None, None, [0, 0], 0

            def done() -> None:
                nonlocal n
                if trainer is not None:
                    trainer.feed(np.zeros(0, np.int64), np.zeros(0, np.int64), last=True)
                    for i, (of, scale) in enumerate(zip((trainer.w, trainer.seen), FIXED, strict=True)):
                        total[i] = total[i] + np.rint(flat(of).astype(np.float64) * scale).astype(np.int64)
                    n += 1

            for whole in batches:
                for b in slices(whole, 1):
                    shards = b.column(0).to_numpy()
                    cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
                    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                        if shards[i] != now:
                            done()
                            now, trainer = shards[i], Trainer(shaped(w), shaped(seen), RATE)
                        given, target, _ = laid_out(*_ids_of(b.column(1).slice(i, j - i)))
                        trainer.feed(bucket[given], classes[target])
            done()
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total[0].tobytes()], pa.binary()), pa.array([total[1].tobytes()], pa.binary()), pa.array([n], pa.int64())], ["g", "w", "seen", "n"])
            trim()

        shards = F.pmod(F.xxhash64(F.lit(1), "mark"), F.lit(-(-ids // shard))).alias("shard")
        spread = some.select(shards, "__ids", "mark").repartition("shard").sortWithinPartitions("shard", "mark")
        if (got := _mean(table(spread.mapInArrow(run, "g int, w binary, seen binary, n bigint")))) is not None:
            w, seen = got
    return w


def _fitted(model: Model, rows: DataFrame, key: str) -> Model:
    local = word_ids(model.path)
    counts = _id_counts(rows, local.size)
    counts[END] += model.ends
    final = local.marked if local.marked is not None else np.zeros(local.size, bool)
    model.classes, model.share, model.bucket = classed(counts, final)
    model.weights = _trained(rows, key, model.bucket, model.classes)
    return model


def fit(train_docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> Model:
    """Learn from all rows of train_docs."""
    model = vocabulary(train_docs.select(key, text), text, path)
    return _fitted(model, read(train_docs, model, (key,), text), key)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns of keep, n_tokens, n_known, train_tokens, base_score, score of every row of docs."""
    return _scored(read(docs, model, (key, *keep), text), model, (key, *keep))


def fit_score(docs: DataFrame, training: Column, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), path: str | None = None) -> DataFrame:
    """score of all rows of docs by a model of those that training holds for; each text is read into ids once."""
    docs = docs.withColumn("__train", F.coalesce(training, F.lit(False)))
    model = vocabulary(docs.where("__train").select(key, text), text, path)
    rows = read(docs, model, (key, *keep, "__train"), text)
    return _scored(rows, _fitted(model, rows.where("__train"), key), (key, *keep))


def _scored(rows: DataFrame, model: Model, kept: tuple[str, ...]) -> DataFrame:
    weights, classes, share, bucket = model.weights, model.classes, model.share, model.bucket
    names = [c for c in rows.columns if c not in ("__ids", "__size", "__rest", "__train")]
    types = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shaped(weights), classes, share, bucket)
        for whole in batches:
            for b in slices(whole, len(names)):
                yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(scorer.texts(*_ids_of(b.column(len(names)))), pa.float64())], [*names, "score"])

    out = rows.select(*names, "__ids").mapInArrow(run, f"{types}, score double")
    rare = rows.select("__row", F.explode("__rest").alias("word")).join(model.words, "word").groupBy("__row").agg(F.count("*").alias("__n"), F.sum(F.log10(F.col("c") + 1)).alias("__s"))
    out = out.join(rare, "__row", "left")
    per_token = math.log10(model.tokens + 1 * (model.distinct + 1)) if model.tokens + model.distinct + 1 > 1 else 0.0
    known_end = int(model.ends > 0)
    return out.select(
        *kept,
        "n_tokens",
        (F.col("__hits") + F.coalesce("__n", F.lit(0)) + known_end).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("__base") + F.coalesce("__s", F.lit(0.0)) + math.log10(model.ends + 1) - F.col("n_tokens") * per_token).alias("base_score"),
        "score",
    )
