"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all test texts, documents scanned once.

The automaton's alphabet is words: each word of the test texts is a letter, any other word of a document a letter that
no window has. So a document is one short string, a window at most WINDOW letters, and a match can't start or end inside
a word. Matches are runs of words; their places in the original text come from the places of the words.

Automata hold BLOCK_LETTERS letters at most. More windows make several automata: a pass over the documents for each,
what was found so far travelling with its row. Documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, bound_arrow, require
from .words import LETTERS_AND_DIGITS, pieces

WINDOW = 10
#: Letters of all windows of an automaton, some 100 bytes each; words number fewer than Unicode's characters.
BLOCK_LETTERS = 1_000_000
#: Stands for a word that no window has.
OTHER = "\0"

_automata: dict = {}


def _letter(n: int) -> str:
    return chr(n + 1 if n < 0xD7FF else n + 0x801)  # surrogates are no characters


class Automaton:
    """Of (window, item) pairs, words of a window being joined by a blank."""

    def __init__(self, pairs: list[tuple[bytes, str | None]]):
        import ahocorasick

        own: dict[bytes, set] = {}
        for window, item in pairs:
            own.setdefault(window, set()).add(item)
        self.letters: dict[bytes, str] = {}
        self.items, self.sizes = [sorted(x for x in items if x is not None) for items in own.values()], np.zeros(len(own), np.int64)
        self.found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, window in enumerate(own):
            key = "".join(self.letters.setdefault(w, _letter(len(self.letters))) for w in window.split(b" "))
            self.sizes[i] = len(key)
            self.found.add_word(key, i)
        self.found.make_automaton()

    def scan(self, data: bytes) -> tuple[int, np.ndarray, set[str]]:
        """Of translated bytes: the number of words, the runs of words that windows cover, and the items of these."""
        text = "".join("".join(map(self.letters.get, words, repeat(OTHER))) for words in pieces(data))
        hits = np.fromiter((x for hit in (self.found.iter(text) if self.letters else ()) for x in hit), np.int64).reshape(-1, 2)
        if not len(hits):
            return len(text), np.empty((0, 2), np.int64), set()
        stops = hits[:, 0] + 1
        return len(text), union(stops - self.sizes[hits[:, 1]], stops), {x for i in np.unique(hits[:, 1]).tolist() for x in self.items[i]}


def union(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Sorted runs that neither meet nor overlap."""
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    first = np.flatnonzero(np.r_[True, start[1:] > stop[:-1]])
    return np.stack([start[first], stop[np.r_[first[1:] - 1, len(stop) - 1]]], 1)


def places(raw: bytes, data: bytes, runs: np.ndarray) -> np.ndarray:
    """Runs of words as ranges of code points of the original text."""
    edges = np.flatnonzero(np.diff(np.frombuffer(data, np.uint8) != 32, prepend=False, append=False))
    at = np.stack([edges[::2][runs[:, 0]], edges[1::2][runs[:, 1] - 1]], 1)
    chars = np.r_[0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)]
    return chars[at]


def windows(benchmark: DataFrame, item_col: str, text_cols: tuple[str, ...], window: int = WINDOW) -> DataFrame:
    """(window binary, item string), each once. A text of fewer words is one window, one without words none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column(0), b.column(1), strict=True):
                words = (text.as_py() or b"").translate(LETTERS_AND_DIGITS).split()
                for at in range(0, max(len(words) - window + 1, min(len(words), 1)), 4096):
                    out = [b" ".join(words[i : i + window]) for i in range(at, min(at + 4096, max(len(words) - window + 1, 1)))]
                    yield pa.record_batch([pa.array(out, pa.binary()), pa.array([item.as_py()] * len(out), pa.string())], ["window", "item"])

    texts = F.explode(F.array(*(F.col(f"`{c}`").cast("string").cast("binary") for c in text_cols)))
    return benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), texts.alias("text")).mapInArrow(run, "window binary, item string").distinct()


def _blocks(pairs: DataFrame, size: int) -> Iterator[list[tuple[bytes, str | None]]]:
    """The pairs in lists of ``size`` pairs; the driver holds one partition and one list."""
    block = []
    for r in pairs.toLocalIterator():
        block.append((bytes(r[0]), r[1]))
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def _scanner(block, name: str, last: bool):
    """A pass over (id, text, runs, items). block: a broadcast list of pairs. last: results go out, not rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _automata:
            _automata.clear()  # a worker keeps one
            _automata[name] = Automaton(block.value)
        automaton = _automata[name]
        for b in batches:
            out: list[tuple] = []
            for text, runs, items in zip(*b.columns[1:], strict=True):
                raw = text.as_py() or b""
                data = raw.translate(LETTERS_AND_DIGITS)
                n, found, own = automaton.scan(data)
                before = np.frombuffer(runs.as_py() or b"", np.int64).reshape(-1, 2)
                found = union(*np.concatenate([before, found]).T) if len(before) and len(found) else before if len(before) else found
                own = sorted(own | set(items.as_py() or ()))
                if last:
                    spans = [{"start": x, "stop": y} for x, y in places(raw, data, found).tolist()] if len(found) else []
                    out.append((n, int((found[:, 1] - found[:, 0]).sum()), own, spans))
                else:
                    out.append((found.tobytes(), own))
            columns = list(zip(*out, strict=True)) if out else [[]] * (4 if last else 2)
            if last:
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))]
                yield pa.record_batch([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["id", "n_words", "n_hit", "items", "spans"])
            else:
                yield pa.record_batch([b.column(0), b.column(1), pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.list_(pa.string()))], ["id", "text", "runs", "items"])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", text_cols: tuple[str, ...] = ("text",), window: int = WINDOW, letters: int = BLOCK_LETTERS) -> DataFrame:
    """A row per document: id_col, n_words, n_hit (words inside an occurrence of a window), items (ids, as strings, of the
    test items with occurring windows, each once, in order), spans (ranges of code points of the text, end exclusive,
    from the first to the last word of each run of hit words).

    text_cols: the benchmark's texts, such as questions and answers; windows don't span columns. A null text has no
    words. An item without an id hits, but isn't named. Rows that share an item id are one item. Repeated documents and
    null ids give a row each; without test items nothing is hit; other columns don't matter.
    """
    require(docs, id_col, text_col)
    require(benchmark, item_col, *text_cols)
    spark = docs.sparkSession
    bound_arrow(spark)
    scratch, kind = Scratch(spark, "decontaminate"), docs.schema[id_col].dataType.simpleString()
    path = scratch.write(windows(benchmark, item_col, text_cols, window), "windows")
    pairs = spark.read.schema("window binary, item string").parquet(path)
    blocks = -(-pairs.count() // (size := max(1, letters // window))) or 1
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"), F.lit(None).cast("binary").alias("runs"), F.lit(None).cast("array<string>").alias("items"))
    before = None
    for n, block in enumerate(_blocks(pairs, size) if blocks > 1 else iter([[(bytes(r[0]), r[1]) for r in pairs.collect()]])):
        last = n == blocks - 1
        scan = _scanner(spark.sparkContext.broadcast(block), f"{path}-{n}", last)
        if last:
            rows = rows.mapInArrow(scan, f"id {kind}, n_words long, n_hit long, items array<string>, spans array<struct<start: long, stop: long>>")
            break
        done = scratch.write(rows.mapInArrow(scan, f"id {kind}, text binary, runs binary, items array<string>"), f"block{n}", "zstd")
        if before:
            scratch.drop(before)
        rows, before = spark.read.schema(f"id {kind}, text binary, runs binary, items array<string>").parquet(done), done
    scratch.drop(path)
    return rows.withColumnRenamed("id", id_col)
