"""Whole CSV records from lines: a quoted field may have line breaks, and files are still read block by block.

Whether a line starts inside quotes depends on all lines before it. Each line turns that state into another one; a block's
lines together do so as well, and so a first pass gives each block that has quotes its state at either start. From these,
in the order of blocks, follows how each block starts. The second pass then joins a block's lines to records; what a block
boundary cuts leaves as fragments, two of a block at most, which are put together by file.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

_COLUMNS = "value binary, file string, block long"
_WHOLE, _END, _START, _INNER = 0, 1, 2, 3  # a record; a fragment that ends one, starts one, or does neither


def patterns(sep: str) -> tuple[str, str]:
    """For a line that starts outside and inside quotes: what it matches if it ends inside. A quote opens a field only at
    its start; a doubled quote inside stands for one."""
    d, inside = re.escape(sep), '[^"]*+(?:""[^"]*+)*+'
    field = f'(?:"{inside}"[^{d}]*+|[^"{d}][^{d}]*+|)'
    opened = f'(?:{field}{d})*+"{inside}$'
    return f"^{opened}", f'^{inside}(?:$|"[^{d}]*+{d}{opened})'


class Quotes:
    def __init__(self, sep: str):
        self.outside, self.inside = (re.compile(p.encode()) for p in patterns(sep))

    def after(self, line: bytes, state: bool) -> bool:
        """Whether the next line starts inside quotes."""
        return bool((self.inside if state else self.outside).match(line))


def lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.text(paths).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def starts(rows: DataFrame, sep: str) -> dict[str, list[tuple[int, bool]]]:
    """By file with quoted line breaks, its blocks with quotes and their state at the end; a row per block comes here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quotes, found = Quotes(sep), {}
        for b in batches:
            for line, file, block in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                a, z, some = found.get((file, block), (False, True, False))
                line = line.as_py()
                a = quotes.after(line, a)
                found[file, block] = a, quotes.after(line, z), some or a
        own = [(file, block, *state) for (file, block), state in found.items()]
        if own:
            yield pa.record_batch([pa.array(c) for c in zip(*own, strict=True)], ["file", "block", "a", "z", "some"])

    blocks = rows.filter(F.col("value").cast("string").contains('"')).mapInArrow(run, "file string, block long, a boolean, z boolean, some boolean")
    out: dict[str, list[tuple[int, bool]]] = {}
    for r in sorted(map(tuple, blocks.withColumn("any", F.max(F.col("some")).over(Window.partitionBy("file"))).filter("any").drop("any", "some").collect())):
        file, block, a, z = r
        own = out.setdefault(file, [])
        own.append((block, z if own and own[-1][1] else a))
    return out


def _joined(known: dict[str, list[tuple[int, bool]]], sep: str, encoding: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quotes, now, state, held, began = Quotes(sep), None, False, [], False
        blocks = {file: {k for k, _ in own} for file, own in known.items()}
        out: list[tuple] = []

        def put(kind: int) -> None:
            out.append((b"\n".join(held).decode(encoding, "replace"), *now, kind))
            held.clear()

        def batch() -> pa.RecordBatch:
            made = pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int32()), strict=True)], ["value", "file", "block", "kind"])
            out.clear()
            return made

        for b in batches:
            quoted = pc.match_substring(b.column(0), b'"').to_pylist()
            for line, some, file, block in zip(b.column(0), quoted, b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if (file, block) != now:
                    if held:
                        put(_INNER if began else _START)
                    own = known.get(file, [])
                    at = bisect_left(own, (block, False))
                    now, began = (file, block), bool(at and own[at - 1][1])
                    state = began
                if some and blocks.get(file) and block not in blocks[file]:
                    raise RuntimeError(f"{file} is split in another way than before: read it again")
                held.append(line.as_py())
                state = quotes.after(held[-1], state) if some else state
                if not state:
                    put(_END if began else _WHOLE)
                    began = False
            if out:
                yield batch()
        if held:
            put(_INNER if began else _START)
        if out:
            yield batch()

    return run


def whole(spark: SparkSession, paths: list[str], sep: str, encoding: str, header: str, breaks: bool | None = None) -> DataFrame:
    """(value, file): the records of files of one kind, without their header and without empty lines. Inside a record, lines
    are joined by a line feed."""
    rows = lines(spark, paths)
    known = starts(rows, sep) if breaks is not False else {}
    if known or encoding not in ("utf-8", "latin-1"):
        parts = rows.mapInArrow(_joined(known, sep, encoding), "value string, file string, block long, kind int")
        out = parts.filter(F.col("kind") == _WHOLE).select("value", "file", "block")
        if known:
            by = Window.partitionBy("file").orderBy("block", "kind")  # two fragments of a block at most
            cut = parts.filter(F.col("kind") != _WHOLE).withColumn("record", F.count_if(F.col("kind") == _START).over(by))
            put = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "kind", "value"))), lambda x: x["value"]), "\n")
            out = out.unionByName(cut.groupBy("file", "record").agg(put.alias("value"), F.min("block").alias("block")).select("value", "file", "block"))
    else:
        text = F.col("value").cast("string") if encoding == "utf-8" else F.decode("value", "ISO-8859-1")
        out = rows.select(text.alias("value"), "file", "block")
    return out.filter((F.trim("value") != "") & ~((F.col("block") == 0) & (F.col("value") == header))).select("value", "file")


def parsed(rows: DataFrame, names: tuple[str, ...], sep: str, bad: str, source: str) -> DataFrame:
    """The records' fields as text, bad: the record where it has another number of fields, source: its file."""
    quoted = [f"`{n.replace('`', '``')}`" for n in names]
    options = {"sep": sep, "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}
    fields = F.from_csv("value", ", ".join(f"{n} string" for n in (*quoted, bad)), options)
    return rows.select(fields.alias("r"), F.col("file").alias(source)).select(*(F.col("r")[n].alias(n) for n in (*names, bad)), source)
