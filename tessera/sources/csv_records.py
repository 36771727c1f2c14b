"""Whole records of CSV files of any size, read by many tasks.

A quoted cell may hold line breaks, so a reader that starts in the middle of a file can't tell from the text there
whether a line begins a record. The number of quotes before it can: a line begins a record if that number is
even. So lines are scanned as splittable text. A first aggregate counts the quotes of each file block; their running
parity over a file's blocks, one row a block, says for each block whether it begins inside a quoted cell. The scan then follows
the parity from line to line within a block and emits records. A record that crosses blocks leaves a piece in each of them (at most two
pieces a block), which are put together by another small window over the blocks.

No step holds a file, no line is shuffled, and the header is the first record of the same scan. Files may be compressed (then a file is one block).
"""

from __future__ import annotations

import csv
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import scratch_path

#: Blocks that begin inside a quoted cell are joined by broadcast up to this number (about 100 bytes each); above it the lines are sorted by block.
BROADCAST_BLOCKS = 100_000

_WHOLE, _HEAD, _TAIL = 2, 0, 1  # a record, the end of one that began in an earlier block, the beginning of one that goes on


def csv_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block) of every line; lines of one block come in order within a partition."""
    return spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _blocks(lines: DataFrame) -> DataFrame:
    """Per block: whether it begins inside a quoted cell; for a file's first block also the first line."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    order = F.monotonically_increasing_id()
    first = F.when((F.col("block") == 0) & ~F.col("value").isin("", "\r"), F.struct(order.alias("at"), F.col("value").alias("line"), (quotes % 2).alias("odd")))
    per_block = lines.select("file", "block", quotes.alias("quotes"), first.alias("first")).groupBy("file", "block").agg(
        F.sum("quotes").alias("quotes"), F.min("first").alias("first"))
    before = F.sum("quotes").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    return per_block.select("file", "block", (F.coalesce(before, F.lit(0)) % 2).cast("int").alias("inside"), "first.line", "first.odd")


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of blocks, each block's in a row, to (file, block, kind, text)."""
    here, inside, open_lines, head, header_due = None, 0, [], False, False

    def emit(file, block, kinds, texts):
        n = len(texts)
        return pa.RecordBatch.from_arrays([pa.array([file] * n, pa.string()), pa.array([block] * n, pa.int64()), pa.array(kinds, pa.int32()), texts],
                                          names=["file", "block", "kind", "text"])

    def close():
        """The record that is open at a block's end."""
        if open_lines and not header_due:
            yield emit(*here, [_HEAD if head else _TAIL], pa.array(["\n".join(open_lines)], pa.string()))

    for batch in batches:
        if not batch.num_rows:
            continue
        value, file, block, begins = (batch.column(i) for i in range(4))
        names, at = file.dictionary_encode(), block.to_numpy()
        code = names.indices.to_numpy()
        cut = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (code[1:] != code[:-1]))).tolist()
        for lo, hi in zip(cut, [*cut[1:], batch.num_rows], strict=True):
            run = (file[lo].as_py(), int(at[lo]))
            if run != here:
                yield from close()
                here, inside, open_lines = run, begins[lo].as_py(), []
                head, header_due = bool(inside), run[1] == 0
            text = value.slice(lo, hi - lo)
            after = (inside + np.cumsum(pc.count_substring(text, '"').to_numpy())) % 2
            before = np.append(inside, after[:-1])
            whole = (before == 0) & (after == 0)
            rest = ~whole
            if header_due and not open_lines:  # the first line that isn't blank begins the header
                first = np.flatnonzero(~pc.is_in(text, pa.array(["", "\r"])).to_numpy(zero_copy_only=False))[:1]
                if len(first) and whole[first[0]]:
                    whole[first[0]], header_due = False, False
            if whole.any():
                some = text.filter(pa.array(whole))
                yield emit(*run, np.full(len(some), _WHOLE, np.int32), some)
            for i in np.flatnonzero(rest).tolist():  # lines of records of several lines
                open_lines.append(text[i].as_py())
                if after[i] == 0:
                    if header_due:
                        header_due = False
                    else:
                        yield emit(*run, [_HEAD if head else _WHOLE], pa.array(["\n".join(open_lines)], pa.string()))
                    open_lines, head = [], False
            inside = int(after[-1])
    yield from close()


def csv_records(spark: SparkSession, path: str, first_record: Callable[[str], list[str]]) -> list[tuple[list[str], DataFrame]]:
    """(header, records) for each different header among the files; ``records``: (text), a whole record without its line break, header and blank
    lines left out. ``first_record(file)`` reads the header of a file where it spans several lines."""
    lines = csv_lines(spark, path)
    blocks_path = scratch_path(spark, "csv-blocks")
    _blocks(lines).write.parquet(blocks_path)
    blocks = spark.read.parquet(blocks_path)
    inside = blocks.where("inside = 1").select("file", "block", "inside")
    crossing = inside.count()
    if not crossing:
        placed = lines.withColumn("inside", F.lit(0))
    elif crossing <= BROADCAST_BLOCKS:
        placed = lines.join(F.broadcast(inside), ["file", "block"], "left")
    else:
        placed = (lines.withColumn("at", F.monotonically_increasing_id()).join(inside, ["file", "block"], "left")
                  .repartition("file", "block").sortWithinPartitions("file", "block", "at"))
    parts = placed.select("value", "file", "block", F.coalesce("inside", F.lit(0)).alias("inside")).mapInArrow(
        _records, "file string, block long, kind int, text string")
    if not crossing:  # a beginning that nothing goes on with: a quote that is never closed
        records = parts.select("file", "text")
    else:
        pieces = parts.where(F.col("kind") != _WHOLE)
        number = F.sum("kind").over(Window.partitionBy("file").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, 0))
        joined = (pieces.withColumn("number", number).where("number > 0").groupBy("file", "number")
                  .agg(F.sort_array(F.collect_list(F.struct("block", "kind", "text"))).alias("pieces")))
        records = parts.where(F.col("kind") == _WHOLE).select("file", "text").unionAll(
            joined.select("file", F.array_join("pieces.text", "\n").alias("text")))
    text = F.col("text")
    text = F.when(text.endswith("\r"), F.expr("substring(text, 1, length(text) - 1)")).otherwise(text)
    records = records.withColumn("text", F.replace(text, F.lit("\r\n"), F.lit("\n"))).where("text <> ''")

    # one row for each different first line, and for each file whose header goes on in the next one
    first = blocks.where("line is not null").select("line", F.when(F.col("odd") == 1, F.col("file")).alias("only")).distinct()
    headers: dict[tuple[str, ...], list] = {}
    for r in first.collect():
        cells = first_record(r.only) if r.only else next(csv.reader([r.line.removesuffix("\r")]))
        headers.setdefault(tuple(cells), []).append(r)
    if len(headers) == 1:
        return [(list(h), records.select("text")) for h in headers]
    begun = records.join(blocks.where("line is not null").select("file", "line", "odd"), "file")
    same = lambda rows: (F.col("odd") == 0) & F.col("line").isin([r.line for r in rows if not r.only]) | F.col("file").isin([r.only for r in rows if r.only])
    return [(list(h), begun.where(same(rows)).select("text")) for h, rows in headers.items()]
