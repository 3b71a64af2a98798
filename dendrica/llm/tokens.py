"""Token ids of whole texts, by the public `tokenizers` library, a distinct word of a batch at a time.

No pre-token of the word vocabulary holds white space, so a text's ids are those
of its space-separated words one after another. A batch of texts is cut into
words and numbered column-wise; the library sees each distinct word once, and
ids are laid out by index. Nothing is kept between batches, so memory is bounded
by a batch.
"""

from __future__ import annotations

import ctypes
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .bpe import byte_letters

#: Bytes of texts that are handled at once, and texts.
BYTES, TEXTS = 4 << 20, 8192
#: Marks that, in a run after a letter or digit, make a pre-token.
MARKS = ".,;:!?#$%&*()[]{}-+=/_\\\"|<>~^@"
#: Words that go to the library as one text.
JOINED = 1000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def trim() -> None:
    """Give freed memory back: the executor's limit counts it."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def slices(batch: pa.RecordBatch, column: int, most: int = BYTES, rows: int = TEXTS) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of bounded text; a longer text is a piece of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = min(max(at + 1, int(np.searchsorted(ends, base + most, "right"))), at + rows)
        yield batch.slice(at, to - at)
        trim()
        at = to


def gathered(flat: np.ndarray, offsets: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of flat (cut at offsets) by their numbers, end to end, and their offsets."""
    sizes = np.diff(offsets)[codes]
    out = np.concatenate([[0], np.cumsum(sizes)])
    return flat[np.repeat(offsets[:-1][codes] - out[:-1], sizes) + np.arange(out[-1])], out


@dataclass
class Words:
    """A batch's distinct words, the number of each word of each text, and the texts' ids."""

    words: pa.Array
    codes: np.ndarray
    word_at: np.ndarray
    ids: np.ndarray
    id_at: np.ndarray
    #: Places of the words among those whose ids were known, or -1.
    place: np.ndarray


def placed(words: pa.Array, among: pa.Array) -> np.ndarray:
    """Place of each word, or -1."""
    return pc.fill_null(pc.index_in(words, among), -1).to_numpy()


def split_words(texts: pa.Array, keep_case: str | None = None) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of texts in lower case (A-Z), the number of each word, and where each text's begin.

    Texts that hold keep_case stay as they are.
    """
    # Copied first: casts of slices keep offsets that kernels of pyarrow 23 read wrongly.
    texts = pc.fill_null(texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string()), "")
    low = pc.ascii_lower(texts)
    if keep_case and pc.any(held := pc.match_substring(texts, keep_case)).as_py():
        low = pc.if_else(held, texts, low)
    parts = pc.ascii_split_whitespace(low)
    flat, at = parts.flatten(), parts.offsets.to_numpy() - parts.offsets[0].as_py()
    some = pc.greater(pc.binary_length(flat), 0)
    if not pc.all(some).as_py():  # white space at either end
        at = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])[at]
        flat = flat.filter(some)
    numbered = flat.dictionary_encode()
    return numbered.dictionary, numbered.indices.to_numpy(), at


class WordIds:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        self.size = self.tok.get_vocab_size()
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        spec, self.marked = json.loads(self.tok.to_str()), None
        self.bare, suffix = self.tok, spec["model"].get("end_of_word_suffix")
        if suffix:
            self.marked = np.zeros(self.size, bool)
            self.marked[[i for w, i in self.tok.get_vocab().items() if w.endswith(suffix)]] = True
            self.letters = {b: c for b, c in byte_letters().items() if b != 32}
            self.bare = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and offsets of words of one pre-token each, past all that would cut and lower them.

        The model's alphabet stands for bytes, so words go in as their bytes'
        letters, many as one text; the last id alone of each ends a word.
        """
        texts = [" ".join(words[i : i + JOINED]).encode().decode("latin-1").translate(self.letters) for i in range(0, len(words), JOINED)]
        found = [np.array(e.ids, self.kind) for e in self.bare.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate(found) if found else np.zeros(0, self.kind)
        cut = np.flatnonzero(self.marked[ids]) + 1
        return (ids, np.concatenate([[0], cut])) if len(cut) == len(words) else None

    def _units(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and offsets of distinct words."""
        n = len(units)
        plain = pc.and_(pc.ascii_is_alpha(units), pc.ascii_is_lower(units)).to_numpy(zero_copy_only=False)
        rest = np.flatnonzero(~plain)
        # Words of letters that lower case and NFC leave alone are one pre-token, too.
        plain[rest] = [t.isalpha() and t.lower() == t and is_normalized("NFC", t) for t in units.take(pa.array(rest)).to_pylist()]
        some, odd = np.flatnonzero(plain), np.flatnonzero(~plain)
        got = self._joined(units.take(pa.array(some)).to_pylist()) if self.marked is not None else None
        if got is None:
            some, odd, got = some[:0], np.arange(n), (np.zeros(0, self.kind), np.zeros(1, np.int64))
        each = [np.array(e.ids, self.kind) for e in self.tok.encode_batch_fast(units.take(pa.array(odd)).to_pylist(), add_special_tokens=False)]
        flat, sizes = np.concatenate([got[0], *each]), np.concatenate([np.diff(got[1]), np.array([len(x) for x in each], np.int64)])
        place = np.empty(n, np.int64)
        place[np.concatenate([some, odd])] = np.arange(n)
        return gathered(flat, np.concatenate([[0], np.cumsum(sizes)]), place)

    def encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and offsets of distinct words; runs of marks after a letter or digit are encoded apart."""
        n = len(words)
        words = words.take(pa.array(np.arange(n))).cast(pa.large_string())
        stems = pc.ascii_rtrim(words, characters=MARKS)
        size, whole = pc.binary_length(stems).to_numpy(), pc.binary_length(words).to_numpy()
        offsets, data = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + n + 1], np.frombuffer(words.buffers()[2] or b"", np.uint8)
        ends = (size > 0) & (size < whole)
        last = np.zeros(n, np.uint8)
        last[ends] = data[offsets[:-1][ends] + size[ends] - 1]
        ends &= (last >= 48) & (last <= 57) | (last >= 97) & (last <= 122) | (last >= 65) & (last <= 90)
        ends &= ~pc.match_substring(words, "<|").to_numpy(zero_copy_only=False)
        at = np.flatnonzero(ends)
        marks = [w[k:] for w, k in zip(words.take(pa.array(at)).cast(pa.large_binary()).to_pylist(), size[at].tolist(), strict=True)]
        base = pc.if_else(pa.array(ends), stems, words)
        units = pa.concat_arrays([base, pa.array(marks, pa.large_binary()).cast(pa.large_string())]).dictionary_encode()
        codes = units.indices.to_numpy()
        flat, cut = self._units(units.dictionary)
        start = np.arange(n) + np.cumsum(ends) - ends
        sequence = np.empty(n + len(at), np.int64)
        sequence[start] = codes[:n]
        sequence[start[at] + 1] = codes[n:]
        ids, each = gathered(flat, cut, sequence)
        return ids, each[np.append(start, n + len(at))]

    def batch(self, texts: pa.Array, often: pa.Array | None = None, held: tuple[np.ndarray, np.ndarray] | None = None) -> Words:
        """Words and ids of texts; held: ids and offsets of the words of `often`, which are not encoded again."""
        words, codes, at = split_words(texts, "<|")  # the vocabulary is lower case, but for names of special tokens
        place = placed(words, often) if held is not None else np.full(len(words), -1)
        new = np.flatnonzero(place < 0)
        flat, cut = self.encoded(words.take(pa.array(new)))
        if held is not None:
            number = place.copy()
            number[new] = len(often) + np.arange(len(new))
            flat, cut = gathered(np.concatenate([held[0], flat]), np.concatenate([held[1], held[1][-1] + cut[1:]]), number)
        ids, each = gathered(flat, cut, codes)
        return Words(words, codes, at, ids, each[at], place)

    def texts(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text."""
        w = self.batch(texts)
        return [w.ids[a:b] for a, b in zip(w.id_at[:-1], w.id_at[1:], strict=True)]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)
