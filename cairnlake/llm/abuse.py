"""Abusive, hateful or sexual content: a factorization machine over hashed terms, learned from noisy document labels."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.plain import plain

#: Letters of other scripts that are written for Latin ones.
LOOKALIKES = str.maketrans("авекмнорстухіјѕԁɡαβεικνορτυχ", "abekmhopctyxijsdgabeiknoptux")

#: Digits and signs written for letters.
LEET = str.maketrans("013457@$!|", "oieastasil")

BITS, RANK = 18, 8

_INVISIBLE = re.compile("[­᠎​-‏‪-‮⁠-⁤︀-️﻿]")
_SPACED = re.compile(r"(?<![^\W_])[^\W\d_]([ .\-_*·])[^\W\d_](?:\1[^\W\d_])+(?![^\W_])")
_BETWEEN = re.compile(r"[ .\-_*·]")
_SEGMENT = re.compile(r"(?<=[.!?…。！？])[\"”’)*_]*\s+|\n+|<[^>]{1,40}>")
_TOKEN = re.compile(r"[^\W_]+(?:[*@$!#%&+|]+[^\W_]+)*")
_RUN = re.compile(r"(.)\1+")


def segments(text: str) -> list[str]:
    """Sentences in a plain form: compatibility forms, lower case, no invisible characters, lookalikes to Latin, spelled-out words joined."""
    t = text.lower() if text.isascii() else _INVISIBLE.sub("", unicodedata.normalize("NFKC", text)).lower()
    out = []
    for part in _SEGMENT.split(t):
        if part and not part.isspace():
            if not part.isascii():
                part = " ".join(w.translate(LOOKALIKES) if any("a" <= c <= "z" for c in w) else w for w in part.split(" "))
                part = "".join(c for c in unicodedata.normalize("NFD", part) if not unicodedata.combining(c))
            out.append(_SPACED.sub(lambda m: _BETWEEN.sub("", m.group()), part))
    return out


def _term(token: str) -> tuple[str, str, bool]:
    """Plain spelling with runs of a letter as one, outline (ends and length), and whether letters are masked."""
    letters = any(c.isalpha() for c in token)
    if not letters:
        return "0", "", False
    masked = not token.isalpha()
    spelled = _RUN.sub(r"\1", token.translate(LEET)) if masked else _RUN.sub(r"\1", token)
    return spelled, f"{token[0]}.{token[-1]}.{min(len(token), 12)}", masked


class _Places(dict):
    """Numbers of tokens in the order they were first met; their hashes stand in arrays of the same order."""

    def __init__(self):
        super().__init__()
        self.spelled = np.zeros(1024, np.uint64)
        self.outline = np.zeros(1024, np.int64)  # -1 where there is none
        self.masked = np.zeros(1024, bool)

    def __missing__(self, token: str) -> int:
        spelled, outline, masked = _term(token)
        at = self[token] = len(self)
        if at == len(self.spelled):
            self.spelled, self.outline, self.masked = (np.concatenate([a, np.zeros_like(a)]) for a in (self.spelled, self.outline, self.masked))
        self.spelled[at] = zlib.crc32(spelled.encode())
        self.outline[at] = zlib.crc32(("~" + outline).encode()) if outline else -1
        self.masked[at] = masked
        return at


class Terms:
    """Hashes the terms of segments, a batch of texts at a time; caches tokens up to a bound."""

    def __init__(self, bits: int = BITS, most: int = 300_000):
        self.bits, self.mask, self.most, self.places = bits, (1 << bits) - 1, most, _Places()

    def of_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat, starts, owner): distinct term numbers of all segments that have words, end to end; where each segment starts; the text it is of.

        Terms are words, outlines, masks and word pairs. All arithmetic is done on whole batches.
        """
        if len(self.places) > self.most:
            self.places = _Places()
        place, tokens, sizes, owner = self.places.__getitem__, [], [], []
        for n, text in enumerate(texts):
            for segment in segments(text) if text else ():
                if found := _TOKEN.findall(segment):
                    tokens += map(place, found)
                    sizes.append(len(found))
                    owner.append(n)
        if not sizes:
            return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.array(tokens)
        seg = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
        first, outline, masked = (a[at] for a in (self.places.spelled, self.places.outline, self.places.masked))
        pairs = (first[:-1] * np.uint64(0x9E3779B1) + first[1:] * np.uint64(0x85EBCA77)) >> np.uint64(7)
        inside, shown = seg[:-1] == seg[1:], outline >= 0
        term = np.concatenate([first, outline[shown].astype(np.uint64), np.full(masked.sum(), zlib.crc32(b"*masked*"), np.uint64), pairs[inside]]) & np.uint64(self.mask)
        of = np.concatenate([seg, seg[shown], seg[masked], seg[:-1][inside]])
        both = np.sort((of << np.uint64(self.bits)) | term)
        both = both[np.append(True, both[1:] != both[:-1])]
        starts = np.searchsorted(both >> np.uint64(self.bits), np.arange(len(sizes), dtype=np.uint64))
        return (both & np.uint64(self.mask)).astype(np.int32), starts, np.array(owner)

    def of(self, text: str) -> list[np.ndarray]:
        """One array of distinct term numbers per segment that has words."""
        flat, starts, _ = self.of_all([text])
        return np.split(flat, starts[1:]) if len(starts) else []


class Machine:
    """Second-order factorization machine: bias + sum of term weights + sum over term pairs of the product of their factors."""

    def __init__(self, bits: int = BITS, rank: int = RANK, seed: int = 7):
        n = 1 << bits
        self.bias = np.float32(-2.0)
        self.w = np.zeros(n, np.float32)
        self.v = (np.random.default_rng(seed).standard_normal((n, rank)) * 0.02).astype(np.float32)

    def margin(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Margins of segments laid end to end; every segment has terms. Terms are weighted so that lengths compare."""
        v = self.v[flat]
        s = np.add.reduceat(v, starts)
        q = np.add.reduceat((v * v).sum(1), starts)
        return self.bias + np.add.reduceat(self.w[flat], starts) + ((s * s).sum(1) - q) / 2

    def fit(self, rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, epochs: int = 5, batch: int = 256, rate: float = 0.08, decay: float = 2e-5, seed: int = 11) -> Machine:
        """AdaGrad on the logistic loss."""
        rng = np.random.default_rng(seed)
        gw, gv, gb = np.full_like(self.w, 1e-3), np.full(len(self.w), 1e-2, np.float32), 1e-3
        sizes = np.array([len(r) for r in rows])
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                chosen = order[at : at + batch]
                flat = np.concatenate([rows[i] for i in chosen])
                n = sizes[chosen]
                starts = np.concatenate([[0], np.cumsum(n)[:-1]])
                v = self.v[flat]
                s = np.add.reduceat(v, starts)
                z = self.bias + np.add.reduceat(self.w[flat], starts) + ((s * s).sum(1) - np.add.reduceat((v * v).sum(1), starts)) / 2
                g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[chosen]) * weight[chosen]).astype(np.float32)
                each = np.repeat(g, n)
                dw = each + decay * self.w[flat]
                dv = each[:, None] * (np.repeat(s, n, axis=0) - v) + decay * v
                np.add.at(gw, flat, dw * dw)
                np.add.at(gv, flat, (dv * dv).mean(1))
                np.add.at(self.w, flat, -rate * dw / np.sqrt(gw[flat]))
                np.add.at(self.v, flat, -(rate / 2) * dv / np.sqrt(gv[flat])[:, None])
                gb += float(g.sum()) ** 2
                self.bias -= np.float32(rate * float(g.sum()) / gb**0.5)
        return self


def suspicion(rows: list[np.ndarray], owner: np.ndarray, bad: np.ndarray, size: int, least: int = 3) -> np.ndarray:
    """How far the telling terms of each segment speak for bad documents: the sum of what their log odds exceed 1 by.

    Odds are counted over documents with one added to each side; a term of fewer than ``least`` documents says nothing.
    Weak correlations, such as those of a language or a place, stay under the threshold however many they are.
    """
    flat = np.concatenate(rows).astype(np.int64)
    seg = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    seen = np.unique(owner[seg] * size + flat)
    doc, term = seen // size, seen % size
    n_bad = np.bincount(term[bad[doc]], minlength=size)
    n_good = np.bincount(term[~bad[doc]], minlength=size)
    odds = np.log((n_bad + 1) / (bad.sum() + 2)) - np.log((n_good + 1) / ((~bad).sum() + 2))
    odds[n_bad + n_good < least] = 0
    return np.bincount(seg, np.maximum(odds - 1, 0)[flat], minlength=len(rows))


def learn(docs: list[tuple[float, list[np.ndarray]]], bits: int = BITS, rounds: int = 2) -> Machine:
    """Learn which segments are bad from (share of bad labels, segments) of documents.

    A document is bad because of some of its segments. Segments of bad documents that are full of telling terms start as
    bad ones; the machine learnt from them corrects that start. Segments of good documents that look as bad count less, as
    their labels may be wrong: what recurs in good documents stays good. Bad documents need not have a suspicious segment. Terms of under three segments are not used.
    """
    docs = [d for d in docs if d[1]]
    rows = [s for _, segs in docs for s in segs]
    bad = np.array([b > 0.5 for b, _ in docs], bool)
    if not bad.any() or bad.all():
        return Machine(bits)
    owner = np.repeat(np.arange(len(docs)), [len(segs) for _, segs in docs])
    telling = suspicion(rows, owner, bad, 1 << bits)
    used = np.bincount(np.concatenate(rows), minlength=1 << bits) >= 3
    rows = [k if len(k := r[used[r]]) else r[:1] for r in rows]
    flat, starts = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])[:-1]])
    of_bad, unsure = bad[owner], np.array([b == 0.5 for b, _ in docs], bool)[owner]
    likely, doubt = telling > 2.5, telling > 1.2
    machine = Machine(bits)
    for r in range(rounds):
        y = (of_bad & likely).astype(np.float32)
        weight = np.where(of_bad | unsure, np.where(likely, 1.0, np.where(doubt, 0.0, 0.5)), np.where(likely, 0.3, 1.0)).astype(np.float32)
        machine = Machine(bits).fit(rows, y, weight)
        z = machine.margin(flat, starts)
        likely, doubt = z > 0, z > -2
    return machine


def label_shares(labels: DataFrame, doc: str, label: str, good: str) -> DataFrame:
    """(doc, bad): share of the labels of a document, in plain form, that aren't ``good``; null and blank labels don't count."""
    word = plain(F.col(label))
    return labels.where((word != "") & F.col(doc).isNotNull()).groupBy(doc).agg(F.avg((word != good).cast("double")).alias("bad"))


_WORKER: dict = {}


def training_segments(docs: DataFrame, shares: DataFrame, doc: str, text: str, sample: int) -> list[tuple[float, list[np.ndarray]]]:
    """Hashed segments of a bounded sample of labelled documents, whole texts, on the driver: at most ``sample`` documents, chosen by a hash of their id."""
    chosen = shares.orderBy(F.xxhash64(doc)).limit(sample)  # bounded by `sample`, so it may be broadcast
    rows = docs.select(doc, text).where(f"{text} is not null").join(F.broadcast(chosen), doc).select(text, "bad")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _WORKER.setdefault("terms", Terms())
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                flat, starts, owner = terms.of_all(part.column(0).to_pylist())
                ends = np.append(starts[1:], len(flat))
                first = np.searchsorted(owner, np.arange(part.num_rows + 1))  # the segments of each text
                cuts = np.append(starts, len(flat))[first].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat, pa.int32()))
                sizes = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array((ends - starts).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(1), lists, sizes], ["bad", "flat", "sizes"])

    table = rows.mapInArrow(run, "bad double, flat array<int>, sizes array<int>").toArrow()
    out = []
    for bad, flat, sizes in zip(table.column(0).to_pylist(), table.column(1), table.column(2)):
        terms = np.array(flat.values, np.int32) if len(flat) else np.zeros(0, np.int32)
        cuts = np.cumsum(sizes.as_py())[:-1] if len(sizes) else []
        out.append((bad, np.split(terms, cuts) if len(terms) else []))
    return out


def scored(docs: DataFrame, labels: DataFrame, doc: str, text: str, label: str, good: str = "ok", sample: int = 20_000) -> DataFrame:
    """(doc, score): the probability that the worst segment of the text is abusive, hateful or sexual; one row per row of ``docs``.

    Every text is read whole. Null, empty and wordless texts score 0. Without labels of both kinds every score is that
    of the prior. The model (two arrays of fixed size, about 9 MB) is broadcast; there is no shuffle of texts.
    """
    spark = docs.sparkSession
    machine = learn(training_segments(docs, label_shares(labels, doc, label, good), doc, text, sample))
    sent = spark.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, model = _WORKER.setdefault("terms", Terms()), sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                flat, starts, owner = terms.of_all(part.column(1).to_pylist())
                best = np.full(part.num_rows, -np.inf)
                if len(starts):
                    np.maximum.at(best, owner, model.margin(flat, starts))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.where(np.isneginf(best), 0.0, 1 / (1 + np.exp(-np.clip(best, -50, 50)))))], [doc, "score"])

    return docs.select(doc, text).mapInArrow(run, f"{doc} {docs.schema[doc].dataType.simpleString()}, score double")
