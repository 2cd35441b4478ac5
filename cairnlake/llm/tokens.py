"""Encoding a corpus with a byte-level BPE vocabulary through a minimal acyclic transducer lexicon."""

from __future__ import annotations

import base64
import hashlib
import heapq
import os
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_file

#: Fixed value: the word split of the byte-level vocabularies.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A vocabulary file is shipped to the executors only up to this size.
MOST_VOCABULARY_BYTES = 64 << 20


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from lines of a base64 token and its id."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Exact byte-pair merging: always the pair of least rank, the leftmost on ties. n log n, so words of any length pass."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    n = len(word)
    end, nxt, prv = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = bytearray(b"\1" * n)
    while heap:
        _, i, j, stop = heapq.heappop(heap)
        if not alive[i] or j >= n or not alive[j] or nxt[i] != j or end[j] != stop:
            continue
        alive[j], end[i], nxt[i] = 0, stop, nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
            if (r := ranks.get(word[i : end[nxt[i]]])) is not None:
                heapq.heappush(heap, (r, i, nxt[i], end[nxt[i]]))
        if (p := prv[i]) >= 0 and (r := ranks.get(word[p : end[i]])) is not None:
            heapq.heappush(heap, (r, p, i, end[i]))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class Lexicon:
    """Minimal acyclic transducer from words (bytes) to lists of ids.

    States with the same continuations are one state. The output of an arc is the number of words that sort before it
    below its state; the sum along a path is the word's place in the sorted list, which leads to its ids. All parts are
    flat arrays in one block of bytes, so a file of it can be memory-mapped and shared by all workers of a machine.
    """

    PARTS = (("keys", np.int64), ("targets", np.int32), ("skips", np.int32), ("final", np.uint8), ("offsets", np.int64), ("ids", np.int32))

    def __init__(self, block: np.ndarray):
        sizes = block[: 8 * len(self.PARTS)].view(np.int64)
        at = 8 * len(self.PARTS)
        for (name, kind), n in zip(self.PARTS, sizes):
            nbytes = int(n) * np.dtype(kind).itemsize
            setattr(self, name, block[at : at + nbytes].view(kind))
            at += (nbytes + 7) // 8 * 8

    @classmethod
    def compile(cls, words: dict[bytes, list[int]]) -> bytes:
        """Words must not be empty."""
        ordered = sorted(words)
        register: dict[tuple, int] = {}
        final: list[int] = []
        arcs: list[tuple[tuple[int, int], ...]] = []
        counts: list[int] = []

        def settle(accepts: bool, out: list[tuple[int, int]]) -> int:
            signature = (accepts, tuple(out))
            state = register.get(signature)
            if state is None:
                state = register[signature] = len(final)
                final.append(int(accepts))
                arcs.append(signature[1])
                counts.append(int(accepts) + sum(counts[t] for _, t in out))
            return state

        path: list[list] = [[False, []]]  # unsettled states along the last word: accepts, arcs
        last = b""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                accepts, out = path.pop()
                path[-1][1].append((last[len(path) - 1], settle(accepts, out)))

        for word in ordered:
            shared = len(os.path.commonprefix([last, word]))
            close(shared)
            path.extend([False, []] for _ in range(len(word) - shared))
            path[-1][0], last = True, word
        close(0)
        root = settle(*path[0])
        number = {root: 0} | {s: i + 1 for i, s in enumerate(s for s in range(len(final)) if s != root)}
        keys, targets, skips = [], [], []
        for state in sorted(number, key=number.get):
            before = final[state]
            for label, target in sorted(arcs[state]):
                keys.append(number[state] * 256 + label)
                targets.append(number[target])
                skips.append(before)
                before += counts[target]
        offsets = np.cumsum([0, *(len(words[w]) for w in ordered)])
        parts = [keys, targets, skips, [final[s] for s in sorted(number, key=number.get)], offsets, list(chain.from_iterable(words[w] for w in ordered))]
        out = [np.array([len(p) for p in parts], np.int64).tobytes()]
        for (_, kind), part in zip(cls.PARTS, parts):
            data = np.asarray(part, kind).tobytes()
            out.append(data + b"\0" * (-len(data) % 8))
        return b"".join(out)

    def find(self, words: list[bytes]) -> list[list[int] | None]:
        """Ids of each word, None if it is not in the lexicon; all words walk together, one byte a step."""
        if not words or not len(self.keys):
            return [None] * len(words)
        lengths = np.array([len(w) for w in words])
        flat = np.frombuffer(b"".join(words) or b"\0", np.uint8)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        state, place = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        live = np.flatnonzero(lengths > 0)
        step = 0
        while len(live):
            key = state[live] * 256 + flat[starts[live] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[arc] == key
            state[live[~hit]] = -1
            live, arc = live[hit], arc[hit]
            place[live] += self.skips[arc]
            state[live] = self.targets[arc]
            step += 1
            live = live[lengths[live] > step]
        known = (state >= 0) & (lengths > 0)
        known[known] = self.final[state[known]] == 1
        return [self.ids[self.offsets[p] : self.offsets[p + 1]].tolist() if k else None for k, p in zip(known, place)]


_WORKER: dict = {}


def _splitter():
    if "split" not in _WORKER:
        import regex

        _WORKER["split"] = regex.compile(SPLIT)
    return _WORKER["split"]


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """(word, n) over the whole corpus; each batch is counted in Python before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = _splitter()
        for batch in batches:
            found: Counter = Counter()
            for value in batch.column(0):
                if (s := value.as_py()) is not None:
                    found.update(split.findall(s))
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])

    return df.select(text).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Encoder:
    """What a worker needs to encode: ranks, the lexicon, and a bounded cache of words already encoded."""

    def __init__(self, ranks: dict[bytes, int], lexicon: Lexicon, most: int = 200_000):
        self.ranks, self.lexicon, self.most = ranks, lexicon, most
        self.cache: dict[str, list[int]] = {}

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        split, cache = _splitter(), self.cache
        words = [split.findall(t) if t else [] for t in texts]
        new = list({w for ws in words for w in ws if w not in cache})
        if new:
            if len(cache) + len(new) > self.most:
                cache = self.cache = {}
                new = list({w for ws in words for w in ws})
            raw = [w.encode() for w in new]
            for word, data, ids in zip(new, raw, self.lexicon.find(raw)):
                cache[word] = merge(data, self.ranks) if ids is None else ids
        return [list(chain.from_iterable(map(cache.__getitem__, ws))) for ws in words]


def encode_corpus(df: DataFrame, key: str, text: str, vocabulary: str, frequent: int = 50_000, longest: int = 64) -> DataFrame:
    """(key, ids): the token ids of every text without special tokens; null and empty texts give an empty list.

    The ``frequent`` most frequent words of the whole corpus of at most ``longest`` characters (a bound on what the
    driver holds) are compiled with their
    ids into a transducer that every executor fetches once as a file and all its workers memory-map. Every other word is merged exactly. Texts of any length are encoded whole; one key gives
    one row for each of its rows; extra columns are ignored. ``vocabulary`` is the path of a file of base64 tokens and
    ranks, readable by the driver.
    """
    spark = df.sparkSession
    data = open(vocabulary, "rb").read(MOST_VOCABULARY_BYTES + 1)
    if len(data) > MOST_VOCABULARY_BYTES:
        raise ValueError("the vocabulary file is too large to be shipped")
    short = word_counts(df, text).where((F.col("n") > 1) & (F.length("word") <= longest))
    top = short.orderBy(F.desc("n"), "word").limit(frequent).collect()  # at most `frequent` words of `longest` characters
    ranks = read_ranks(data)
    words = {r["word"].encode(): merge(r["word"].encode(), ranks) for r in top}
    block = Lexicon.compile(words) if words else Lexicon.compile({b"\0": merge(b"\0", ranks)})
    name = ship_file(spark, "lexicon", block)
    shipped = spark.sparkContext.broadcast(data)
    token = hashlib.sha256(data + block).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if token not in _WORKER:
            _WORKER[token] = Encoder(read_ranks(shipped.value), Lexicon(np.memmap(SparkFiles.get(name), np.uint8, "r")))
        encoder = _WORKER[token]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists = encoder.encode(part.column(1).to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                flat = np.fromiter(chain.from_iterable(lists), np.int32, int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>")
