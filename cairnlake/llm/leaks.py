"""Evaluation texts leaking into training text: one Aho-Corasick automaton over normalised passages."""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The test items are a stated set; more text than this is refused rather than shipped to every executor.
MOST_ITEM_CHARS = 64 << 20

_WORD = r"[\p{L}\p{N}]+"
_WORKER: dict = {}


def normal_words(text: str) -> list[str]:
    """Unbroken runs of letters or digits in lower case."""
    if "word" not in _WORKER:
        import regex

        _WORKER["word"] = regex.compile(_WORD)
    return [w.lower() for w in _WORKER["word"].findall(text)]


def passages(items: list[tuple], words: int) -> dict[str, list[tuple]]:
    """Every window of ``words`` words of every part of every item: window -> [(item, part, place of its first word)]."""
    out: dict[str, list[tuple]] = {}
    for item, *texts in items:
        for part, text in enumerate(texts):
            tokens = normal_words(text or "")
            for i in range(len(tokens) - words + 1):
                out.setdefault(" " + " ".join(tokens[i : i + words]) + " ", []).append((item, part, i))
    return out


def _automaton(key: str, shipped: str, words: int):
    if key not in _WORKER:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for window, found in passages(json.loads(shipped), words).items():
            machine.add_word(window, (len(window), found))
        if len(machine):
            machine.make_automaton()
        _WORKER[key] = machine
    return _WORKER[key]


def scan(text: str, machine, words: int) -> list[tuple]:
    """(item, part, first and last+1 character of the passage in the text, words) of every longest leaked passage.

    The text is read once in its normal form; hits are mapped back by the character spans of its words. Windows that
    overlap in both the item and the text are joined.
    """
    tokens = normal_words(text)
    if len(tokens) < words or not len(machine):
        return []
    hits = list(machine.iter(" " + " ".join(tokens) + " "))
    if not hits:
        return []
    starts, at = [], 0
    for t in tokens:
        starts.append(at)
        at += len(t) + 1
    spans = [m.span() for m in _WORKER["word"].finditer(text)]
    runs: dict[tuple, list[int]] = {}
    for end, (length, found) in hits:
        first = bisect_right(starts, end - length + 1) - 1
        for item, part, place in found:
            runs.setdefault((item, part, first - place), []).append(first)
    out = []
    for (item, part, _), firsts in runs.items():
        firsts = sorted(set(firsts))
        low = previous = firsts[0]
        for f in [*firsts[1:], None]:
            if f is None or f > previous + words:
                out.append((item, part, spans[low][0], spans[previous + words - 1][1], previous + words - low))
                low = f
            previous = f
    return out


def leaked_passages(docs: DataFrame, items: DataFrame, doc: str, text: str, item: str, parts: list[str], words: int = 13) -> DataFrame:
    """(doc, item, part, first_char, last_char, n_words): every passage of at least ``words`` consecutive words of an item's part in a text.

    The items are the stated held-out set; their total length is checked before they are shipped, and each worker
    compiles one automaton. Texts are scanned whole and once, in the partitions they are read in: no shuffle. Items with
    fewer words than a passage can't leak; null and empty texts give no rows; repeated rows give repeated results.
    """
    spark = docs.sparkSession
    held_out = items.select(item, *parts).where(f"{item} is not null")
    chars = sum((F.coalesce(F.length(p), F.lit(0)).cast("long") for p in parts), F.lit(16).cast("long"))
    if (held_out.agg(F.sum(chars)).first()[0] or 0) > MOST_ITEM_CHARS:
        raise ValueError("the held-out set is too large to be shipped")
    rows = [tuple(r) for r in held_out.collect()]  # bounded by the check above
    shipped = json.dumps(sorted(rows, key=str))
    key = hashlib.sha256(f"{words}{shipped}".encode()).hexdigest()
    sent = spark.sparkContext.broadcast(shipped)
    id_type, item_type = docs.schema[doc].dataType.simpleString(), items.schema[item].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(key, sent.value, words)
        for batch in batches:
            ids, out = batch.column(0), []
            for i, value in enumerate(batch.column(1)):
                if (s := value.as_py()) is not None:
                    out.extend((i, *hit) for hit in scan(s, machine, words))
            if out:
                at, item_ids, part, low, high, n = zip(*out)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(item_ids).cast(kind), pa.array([parts[p] for p in part]), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(n, pa.int32())], [doc, item, "part", "first_char", "last_char", "n_words"])

    kind = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[item_type]
    return docs.select(doc, text).mapInArrow(run, f"{doc} {id_type}, {item} {item_type}, part string, first_char long, last_char long, n_words int")
