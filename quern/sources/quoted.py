"""Records of delimited text whose quoted fields hold line breaks, found split by split.

Whether a line begins inside a quoted field depends on all lines before it. A split is read under both assumptions, which
gives a map of two states to two states; composing the maps over the splits of a file tells where each split begins. Then
every split puts its own lines together, and only the pieces at the edges of splits are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.ship import ship

_PIECE = "file string, block long, kind int, header boolean, record string"
WHOLE, TAIL, HEAD = 0, 1, 2  # a record of its own; the beginning of one that goes on in later splits; what goes on from earlier ones


def line_states(delimiter: str) -> Callable[[str, bool], bool]:
    """Whether the next line begins inside a quoted field, given a line and whether it begins inside one.

    A field is quoted if a quote is its first character; two quotes inside stand for one; what follows the closing quote up to
    the delimiter, and quotes in other fields, are plain text."""
    d = re.escape(delimiter)
    close = re.compile(rf'(?:[^"]++|"")*+"[^{d}]*+')
    fields = re.compile(rf'(?:{d}(?:"(?:[^"]++|"")*+"[^{d}]*+|(?!")[^{d}]*+))*+')

    def after(line: str, inside: bool) -> bool:
        if inside:
            met = close.match(line)
            if met is None:
                return True
            line = line[met.end():]
            return bool(line) and fields.match(line).end() < len(line)
        return fields.match(delimiter + line).end() <= len(line)
    return after


def _lines(spark: SparkSession, path: str, charset: str) -> DataFrame:
    line = F.make_valid_utf8("value") if charset == "utf-8" else F.decode(F.col("value").cast("binary"), charset)
    return (spark.read.option("lineSep", "\n").text(path)
            .select(line.alias("line"), F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_block_start").alias("block")))


def _starts(lines: DataFrame, delimiter: str) -> DataFrame:
    """(file, block) of the splits that begin inside a quoted field. Lines without quotes change nothing and are left out."""
    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after, at, out, inside = line_states(delimiter), None, False, True

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"file": [at[0]], "block": pa.array([at[1]], pa.int64()), "from_out": [out], "from_in": [inside]})

        for batch in batches:
            for line, *split in zip(*(batch[c].to_pylist() for c in ("line", "file", "block")), strict=True):
                if split != at:
                    if at is not None:
                        yield row()
                    at, out, inside = split, False, True
                out, inside = after(line, out), after(line, inside)
        if at is not None:
            yield row()

    maps = lines.where(F.contains("line", F.lit('"'))).mapInArrow(both, "file string, block long, from_out boolean, from_in boolean")
    # A map that forgets where it came from settles the state; after it, only swaps change it.
    steps = lines.select("file", "block").distinct().join(maps, ["file", "block"], "left").select(
        "file", "block", F.expr("CASE WHEN from_out = from_in THEN from_out END").alias("fixed"),
        F.expr("CASE WHEN from_out AND NOT from_in THEN 1 ELSE 0 END").alias("swap"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    run = steps.select("file", "block", "fixed", F.coalesce(F.sum("swap").over(before), F.lit(0)).alias("swaps"), "swap")
    known = F.last(F.expr("CASE WHEN fixed IS NOT NULL THEN struct(fixed, swaps + swap AS swaps) END"), ignorenulls=True).over(before)
    return (run.withColumn("known", known)
            .where("pmod(swaps - coalesce(known.swaps, 0), 2) = 1 <> coalesce(known.fixed, false)").select("file", "block"))


def quoted_records(spark: SparkSession, path: str, delimiter: str, charset: str = "utf-8") -> DataFrame:
    """`record`: every record of the files under `path` but the first of each file, the header. Blank lines between records go;
    line breaks, also inside fields, become \\n.

    The splits that begin inside a field are broadcast: at most one row for each split, and the scan plans those on the driver
    anyway. Files of any size are read by as many tasks as they have splits."""
    ship(spark)
    lines = _lines(spark, path, charset)
    inside = _starts(lines, delimiter).withColumn("inside", F.lit(True))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after, at, state, open_, head, header, out = line_states(delimiter), None, False, [], False, False, []

        def put(kind: int) -> None:
            nonlocal open_, header
            out.append((*at, kind, header and kind != HEAD, "\n".join(open_)))
            header, open_ = header and kind == HEAD, []

        def leave() -> None:
            if open_ or head:
                put(HEAD if head else TAIL)

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 5
            out.clear()
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "block", "kind", "header", "record"])

        for batch in batches:
            for line, began, *split in zip(*(batch[c].to_pylist() for c in ("line", "inside", "file", "block")), strict=True):
                if split != at:
                    if at is not None:
                        leave()
                    at, state, open_, header = split, bool(began), [], split[1] == 0
                    head = state
                if not state and not open_ and line in ("", "\r"):
                    continue
                open_.append(line.removesuffix("\r"))
                state = after(line, state) if '"' in line else state
                if not state:
                    put(HEAD if head else WHOLE)
                    head = False
            yield flush()
        if at is not None:
            leave()
        yield flush()

    pieces = lines.join(F.broadcast(inside), ["file", "block"], "left").select("line", "file", "block", "inside").mapInArrow(assemble, _PIECE)
    edges = pieces.where(f"kind <> {WHOLE}").withColumn("owner", F.sum((F.col("kind") == TAIL).cast("int")).over(
        Window.partitionBy("file").orderBy("block", F.col("kind").desc())))
    ordered = F.array_sort(F.collect_list(F.struct("block", "kind", "record")))
    joined = edges.groupBy("file", "owner").agg(F.max("header").alias("header"), F.array_join(F.transform(ordered, lambda p: p["record"]), "\n").alias("record"))
    whole = pieces.where(f"kind = {WHOLE}").select("header", "record").unionByName(joined.select("header", "record"))
    return whole.where("NOT header").select("record")
