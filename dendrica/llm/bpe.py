"""Byte-level BPE by a priority queue of merge ranks over a linked symbol list.

A pre-token's symbols form a doubly linked list. All adjacent pairs that have a
merge wait in a heap by (rank, position); the least is taken, skipped if either
symbol has changed since, else merged, and the two new pairs are pushed.
Decoding concatenates vocabulary strings and reads their characters as bytes.

Encoding equals the public `tokenizers` library on the same file, special tokens
included. Null and empty texts have no tokens; repeated rows are encoded each.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import lean

#: Fixed value: how byte-level vocabularies cut a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space within a run of white space, where a run may go on as one pre-token.
ODD = regex.compile(r"\s \s|  |[\x1c-\x1f\x85]")
#: Cached words of a worker; when full the cache starts anew, so memory stays bounded.
CACHE = 1_000_000


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable bytes for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Cache(dict):
    """word: its ids as decimal text; misses are encoded."""

    def __init__(self, encode, most: int) -> None:
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        out = self[word] = b",".join(b"%d" % i for i in self.encode(word))
        return out


class ByteBpe:
    def __init__(self, path: str, cache: int = CACHE) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        vocab = model["vocab"]
        self.letter = letters
        self.ids = {b: vocab[c] for b, c in letters.items() if c in vocab}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[left], vocab[right]] = rank, vocab[left + right]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        back = {c: b for b, c in letters.items()}
        self.strings = {i: bytes(map(back.__getitem__, s)) for s, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.by_text = {b"%d" % i: s for i, s in self.strings.items()}
        self.cut = regex.compile(PATTERN).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.plain, self.spaced = Cache(self.encode, cache // 8), Cache(lambda w: self.encode(" " + w), cache)

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one pre-token."""
        ids, merges = [self.ids[b] for b in raw], self.merges
        n = len(ids)
        if n == 1:
            return ids
        get = merges.get
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := get((ids[i], ids[i + 1])))]
        if not heap:
            return ids
        heapify(heap)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        while heap:
            _, i, left, right, new = heappop(heap)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:  # stale: a neighbour took part in another merge
                continue
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if m := get((new, ids[k])):
                    heappush(heap, (m[0], i, new, ids[k], m[1]))
            h = before[i]
            if h >= 0 and (m := get((ids[h], new))):
                heappush(heap, (m[0], h, ids[h], new, m[1]))
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> list[int]:
        """Ids of any text, by the rules alone."""
        out: list[int] = []
        for part in self.specials.split(text) if self.specials and any(s in text for s in self.special) else (text,):
            if part in self.special:
                out.append(self.special[part])
            else:
                for word in self.cut(part):
                    out += self.merge(word.encode())
        return out

    def encode_text(self, text: str) -> bytes:
        """Ids as decimal text with commas, through the cache.

        A space begins a pre-token unless white space stands on both its sides,
        so the text can be cut at spaces; texts with such a space are encoded
        as a whole.
        """
        if not text:
            return b""
        if ODD.search(text):
            return b",".join(b"%d" % i for i in self.encode(text))
        first, *rest = text.split(" ")
        out = [self.plain[first]] if first else []
        out.extend(map(self.spaced.__getitem__, rest))
        return b",".join(out)

    def decode_text(self, ids: bytes) -> bytes:
        """The text of ids, as UTF-8."""
        raw = b"".join(map(self.by_text.__getitem__, ids.split(b","))) if ids else b""
        return raw.decode("utf-8", "replace").encode()


@lru_cache(maxsize=4)
def model(path: str) -> ByteBpe:
    return ByteBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids array<int> of each row."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            ids = [[int(x) for x in m.encode_text(t.as_py() or "").split(b",") if x] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], [key, "ids"])

    return lean(docs).select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, ids array<int>")


def decode(tokens: DataFrame, path: str | None = None, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, text of each row's ids; null ids give null."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            out = [None if v is None else m.decode_text(b",".join(b"%d" % i for i in v)).decode() for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], [key, "text"])

    return tokens.select(key, ids).mapInArrow(run, f"`{key}` {tokens.schema[key].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, and digests of the ids and of their decoding, in one pass: ids never leave the worker."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, sha = model(path), hashlib.sha256
        for b in batches:
            n, of_ids, of_text = [], [], []
            for t in b.column(1):
                ids = m.encode_text(t.as_py() or "")
                n.append(ids.count(b",") + 1 if ids else 0)
                of_ids.append(sha(ids).hexdigest())
                of_text.append(sha(m.decode_text(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return lean(docs).select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
