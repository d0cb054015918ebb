"""Byte-level BPE encoding of whole columns with a public vocabulary.

Pre-tokenisation works on arrays of code points of many texts at once. Every code point gets a class (letter,
number, space, other). The splitting automaton's state after a code point is its class alone, whatever the state before: every transition function is
constant, so the scan that composes them ends after one step, a comparison of neighbours. A token starts where a run of one class does, moved back over
one joined space and cut after contractions. No regular expression is run. Slices of the UTF-8 bytes go through a
cache of merged words; offsets stay known: a token's bytes are its vocabulary entry's (decode_column).
"""

from __future__ import annotations

import base64
import os
import unicodedata
from collections.abc import Iterator, Sequence
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Folder of the vocabulary files; override by parameter or OREFOLD_TOKENIZERS.
TOKENIZER_DIR = os.environ.get("OREFOLD_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"

OTHER, LETTER, NUMBER, SPACE = range(4)

#: White space of the Unicode standard, as first and last code point. Fixed values.
_SPACES = ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
#: Suffixes that an apostrophe splits off. Fixed values.
_SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")

#: Code points encoded at once; larger texts are encoded alone.
BLOCK = 1_000_000
#: Words and ids a worker's cache may reach before it starts anew, and the size of its table for short words.
CACHE_WORDS, CACHE_IDS, SLOT_BITS = 400_000, 4_000_000, 17
_MIX = np.uint64(0x9E3779B97F4A7C15)

_loaded: dict[str, "Encoder"] = {}
_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """Class of every code point, from the Unicode database."""
    global _classes
    if _classes is None:
        kinds = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        for a, b in _SPACES:
            table[a : b + 1] = SPACE
        _classes = table
    return _classes


def token_starts(cps: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Positions at which pre-tokens start in joined texts; text_starts are the texts' first positions (of non-empty ones)."""
    n = len(cps)
    kind = classes()[cps]
    edge = np.zeros(n + 1, bool)
    edge[text_starts] = True
    edge[n] = True
    start = edge[:-1].copy()
    start[1:] |= kind[1:] != kind[:-1]
    inner = ~edge[:-1]  # positions with a neighbour on the left in the same text
    space = kind == SPACE
    # the last character of a run of spaces stands alone or joins what follows it, unless the text ends there
    run_end = np.flatnonzero(start[1:] & space[:-1] & inner[1:])  # last space before another class
    first = start & ~space
    start[run_end] = True
    joined = run_end[cps[run_end] == 32]
    start[joined + 1] = False
    # an apostrophe that starts a token takes a suffix with it
    quote = np.flatnonzero((cps == 39) & start & first)
    if len(quote):
        padded = np.concatenate((cps, [0, 0, 0]))
        blocked = np.concatenate((edge, [True, True, True]))
        length = np.zeros(len(quote), np.int64)
        for suffix in _SUFFIXES:
            hit = np.ones(len(quote), bool)
            for i, ch in enumerate(suffix, 1):
                hit &= (padded[quote + i] == ord(ch)) & ~blocked[quote + i]
            length[hit] = len(suffix)  # no suffix is the start of another
        quote, length = quote[length > 0], length[length > 0]
        start[quote + 1] = False
        after = quote + 1 + length
        after = after[after < n]
        start[after] = True
    return np.flatnonzero(start)


class Encoder:
    """A vocabulary of ranks, with a cache of merged words."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self._forget()

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Ids of one pre-token: pairs are merged by rank, the leftmost first; n log n in its length."""
        ranks = self.ranks
        if word in ranks:
            return (ranks[word],)
        n = len(word)
        end = list(range(1, n + 1))  # end of the part that starts here; 0: no longer a start
        before = list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, size = heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] - i != size:
                continue  # one of the two parts has changed since
            end[i], end[j] = end[j], 0
            if end[i] < n:
                before[end[i]] = i
                k = end[end[i]]
                if (r := ranks.get(word[i:k])) is not None:
                    heappush(heap, (r, i, k - i))
            p = before[i]
            if p >= 0 and (r := ranks.get(word[p : end[i]])) is not None:
                heappush(heap, (r, p, end[i] - p))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = end[i]
        return tuple(out)

    def _forget(self) -> None:
        """An empty cache: words by bytes, a direct-mapped table for words of up to 7 bytes, and the ids of all of them."""
        self.index: dict[bytes, int] = {}
        self.slots = np.zeros(1 << SLOT_BITS, np.uint64)  # the word's bytes with its length on top; 0: free
        self.slot_word = np.zeros(1 << SLOT_BITS, np.int64)
        self.first, self.size, self.pool = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int32)
        self.n_words = self.n_pool = 0

    def _add(self, ids: tuple[int, ...]) -> int:
        if self.n_words == len(self.first):
            self.first, self.size = (np.concatenate((x, np.zeros_like(x))) for x in (self.first, self.size))
        while self.n_pool + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        k, p = self.n_words, self.n_pool
        self.first[k], self.size[k] = p, len(ids)
        self.pool[p : p + len(ids)] = ids
        self.n_words, self.n_pool = k + 1, p + len(ids)
        return k

    def _word(self, word: bytes) -> int:
        k = self.index.get(word)
        if k is None:
            k = self._add(self.merge(word))
            self.index[word] = k
        return k

    def _words(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Index of each pre-token's word, and the number of pre-tokens of each text."""
        joined = "".join(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        if not joined:
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        if self.n_words > CACHE_WORDS or self.n_pool > CACHE_IDS:
            self._forget()
        raw = joined.encode("utf-8", "surrogatepass")
        at = np.concatenate(([0], np.cumsum(lengths)))
        if len(raw) == len(joined):
            cps = np.frombuffer(raw, np.uint8)
            starts = token_starts(cps, at[:-1][lengths > 0])
            bytes_at = np.append(starts, len(cps))
        else:
            cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
            starts = token_starts(cps, at[:-1][lengths > 0])
            width = (1 + (cps > 0x7F) + (cps > 0x7FF) + (cps > 0xFFFF)).astype(np.uint8)
            offset = np.concatenate(([0], np.cumsum(width, dtype=np.int64)))
            bytes_at = offset[np.append(starts, len(cps))]
        size = np.diff(bytes_at)
        word = np.zeros(len(size), np.int64)
        short = np.flatnonzero(size < 8)
        # eight bytes from every start, cut to the word and topped with its length
        eights = np.ndarray((len(raw),), "<u8", raw + bytes(8), strides=(1,))
        n = size[short].astype(np.uint64)
        key = (eights[bytes_at[short]] & ((np.uint64(1) << (n << np.uint64(3))) - np.uint64(1))) | (n << np.uint64(56))
        slot = ((key * _MIX) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        hit = self.slots[slot] == key
        word[short] = self.slot_word[slot]
        missed = short[~hit]
        rest = np.concatenate((missed, np.flatnonzero(size >= 8)))
        get, add = self.index.get, self._word
        slices = [raw[a:b] for a, b in zip(bytes_at[rest].tolist(), bytes_at[rest + 1].tolist())]
        found = list(map(get, slices))
        if None in found:
            found = [x if x is not None else add(w) for x, w in zip(found, slices)]
        word[rest] = found
        self.slots[slot[~hit]] = key[~hit]
        self.slot_word[slot[~hit]] = word[missed]
        # where several missed words share a slot, both lines keep the last one, so table and word agree
        return word, np.diff(np.searchsorted(starts, at))

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order as one array, and the number of ids of each text."""
        word, per_text = self._words(texts)
        sizes = self.size[word]
        total = np.concatenate(([0], np.cumsum(sizes)))
        upto = np.concatenate(([0], np.cumsum(per_text)))
        ids = self.pool[np.repeat(self.first[word] - total[:-1], sizes) + np.arange(total[-1])]
        return ids, np.diff(total[upto])

    def count(self, texts: Sequence[str]) -> np.ndarray:
        """The number of ids of each text."""
        word, per_text = self._words(texts)
        total = np.concatenate(([0], np.cumsum(self.size[word])))
        return np.diff(total[np.concatenate(([0], np.cumsum(per_text)))])

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids; their bytes follow each other without gaps, which gives every token's offset."""
        if not hasattr(self, "parts"):
            self.parts = {i: b for b, i in self.ranks.items()}
        return b"".join(self.parts[i] for i in ids).decode("utf-8", "replace")


def decode_column(encoded: DataFrame, keep: Sequence[str], ids: str = "ids", vocabulary: str = VOCABULARY, folder: str = TOKENIZER_DIR) -> DataFrame:
    """The columns `keep` of every row with the text that its ids stand for; null and empty lists give an empty text."""
    path = os.path.join(folder, vocabulary)
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in encoded.schema if f.name in keep) + "text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = [enc.decode(x or ()) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(texts, pa.string())], names=[*keep, "text"])

    return encoded.select(*keep, ids).mapInArrow(run, schema)


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file, loaded once per process."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def _blocks(texts: list[str | None]) -> Iterator[list[str]]:
    block, size = [], 0
    for t in texts:
        t = t or ""
        if block and size + len(t) > BLOCK:
            yield block
            block, size = [], 0
        block.append(t)
        size += len(t)
    if block:
        yield block


def encode_column(docs: DataFrame, keep: Sequence[str], text: str = "text", vocabulary: str = VOCABULARY, folder: str = TOKENIZER_DIR, ids: bool = True) -> DataFrame:
    """The columns `keep` of every row with `ids` (array<int>) or, with ids=False, only their number `n_tokens`.

    Strings of special tokens are ordinary text. Null and empty texts give an empty list, or 0. Rows stay as they are, repeated ones
    too; nothing is shuffled. Texts of any length are encoded whole.
    """
    path = os.path.join(folder, vocabulary)
    fields = {f.name: f for f in docs.schema}
    result = "ids array<int>" if ids else "n_tokens bigint"
    schema = "".join(f"`{c}` {fields[c].dataType.simpleString()}, " for c in keep) + result

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("__text")).to_pylist()
            at = 0
            for block in _blocks(column):
                if ids:
                    found, counts = enc.encode(block)
                    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                    last = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found))
                else:
                    last = pa.array(enc.count(block).astype(np.int64))
                kept = [batch.column(batch.schema.get_field_index(c)).slice(at, len(block)) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, last], names=[*keep, "ids" if ids else "n_tokens"])
                at += len(block)

    return docs.select(*keep, docs[text].alias("__text")).mapInArrow(run, schema)
