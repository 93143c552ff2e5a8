"""Waveforms (VCD): changes read as a table, and written from one.

A file is read in byte ranges, by the lines that begin in each. The time that a range begins at is the last one of the ranges before it: a
first pass takes each range's last time, which is carried on over the ranges of a file."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netframe.functions.text import id_code
from netframe.operators.components import written
from netframe.operators.waves import changes
from netframe.sources import documents
from netframe.sources.ranges import RANGE_BYTES, Batches, byte_ranges, carried, dealt, lines, open_source, rows_of, whole

_TIME, _SCALAR, _VECTOR = re.compile(rb"#(\d+)"), re.compile(rb"([01xXzZ])(\S+)"), re.compile(rb"[bB]([01xXzZ]+)\s+(\S+)")
_VARIABLE = re.compile(rb"\$var \S+ \d+ (\S+) (\S+)")
_LINE = "path string, seq long, t long, value string, code string, signal string"


def _range_lines(row: dict) -> Iterator[tuple[int, bytes]]:
    with open_source(row["path"], row.get("content")) as source:
        for at, line in lines(source, row["length"], row["begin"]):
            if at >= row["end"]:
                return
            yield at, line.strip()


def _times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each range with its last time."""
    out = Batches(pa.schema([("path", pa.string()), ("length", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("last", pa.int64())]))
    for row in rows_of(batches):
        last = None
        for _, line in _range_lines(row):
            if line[:1] == b"#" and (found := _TIME.fullmatch(line)):
                last = int(found[1])
        yield from out.add((row["path"], row["length"], row["begin"], row["end"], last), 100)
    yield from out.flush()


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Changes, with a null signal, and declarations, with a null value."""
    out = Batches(pa.schema([("path", pa.string()), ("seq", pa.int64()), ("t", pa.int64()), ("value", pa.string()), ("code", pa.string()), ("signal", pa.string())]))
    for row in rows_of(batches):
        path, t = row["path"], row["t"] or 0
        for at, line in _range_lines(row):
            if found := _TIME.fullmatch(line):
                t = int(found[1])
            elif found := _SCALAR.fullmatch(line) or _VECTOR.fullmatch(line):
                yield from out.add((path, at, t, found[1].decode().lower(), found[2].decode(errors="replace"), None), 100 + len(line))
            elif found := _VARIABLE.match(line):
                yield from out.add((path, at, t, None, found[1].decode(errors="replace"), found[2].decode(errors="replace")), 100 + len(line))
    yield from out.flush()


def _changes(ranges: DataFrame) -> DataFrame:
    """Signals are looked up by a join whose way Spark chooses by the size of their table; a signal with many changes is split there."""
    read = (ranges if "content" in ranges.columns else dealt(ranges)).mapInArrow(_parsed, _LINE)
    names = written(read.where("value IS NULL").select("path", "code", "signal"), "signals")
    return read.where("value IS NOT NULL").drop("signal").join(names, ["path", "code"]).select("path", "t", "seq", "signal", "value")


def parse_vcd(files: DataFrame) -> DataFrame:
    """(path, t, seq, signal, value) of files (path, value): every change, seq in order. Scalars are 0, 1, x or z, vectors strings of them."""
    return _changes(whole(files).withColumn("t", F.lit(0).cast("long")))


def read_vcd(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The columns of parse_vcd() from files at path, read in ranges of so many bytes."""
    summaries = written(dealt(written(byte_ranges(spark, path, range_bytes), "ranges")).mapInArrow(_times, "path string, length long, begin long, end long, last long"), "ranges")
    return _changes(written(carried(summaries, t=("last", "last")), "ranges"))


def frames(waves: DataFrame) -> DataFrame:
    """(path, t, signals): at every time, each signal's last value so far, as a map."""
    last = waves.groupBy("path", "t", "signal").agg(F.max_by("value", "seq").alias("value"))
    grid = waves.select("path", "t").distinct().join(waves.select("path", "signal").distinct(), "path")
    w = Window.partitionBy("path", "signal").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    held = grid.join(last, ["path", "t", "signal"], "left").withColumn("value", F.last("value", ignorenulls=True).over(w))
    return held.where("value is not null").groupBy("path", "t").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("signal", "value")))).alias("signals"))


def to_vcd(waves: DataFrame, signals: DataFrame) -> DataFrame:
    """(part, key, text): a file's lines. waves: (signal, t, seq, value) with null for unknown; signals: (signal, n) numbers them. Everything starts unknown; only changes are written."""
    spark = waves.sparkSession
    head = signals.select(F.lit(1).alias("part"), F.lpad(F.col("n").cast("string"), 20, "0").alias("key"), F.concat(F.lit("$var wire 1 "), id_code(F.col("n")), F.lit(" "), F.col("signal"), F.lit(" $end")).alias("text"))
    dump = signals.select(F.lit(3).alias("part"), F.lpad(F.col("n").cast("string"), 20, "0").alias("key"), F.concat(F.lit("x"), id_code(F.col("n"))).alias("text"))
    fixed = spark.createDataFrame([(0, "", "$timescale 1ns $end"), (0, "~", "$scope module top $end"), (2, "", "$upscope $end"), (2, "~", "$enddefinitions $end"), (2, "~~", "$dumpvars"), (4, "", "$end")], "part int, key string, text string")
    unknown = signals.select("signal", F.lit(-1).cast("long").alias("t"), F.lit(-1).cast("long").alias("seq"), F.lit(None).cast(waves.schema["value"].dataType).alias("value"))
    new = changes(waves.select("signal", "t", "seq", "value").unionByName(unknown)).where("t >= 0").join(signals, "signal")
    time_key = F.lpad(F.col("t").cast("string"), 20, "0")
    values = new.select(F.lit(5).alias("part"), F.concat(time_key, F.lit("b"), F.lpad(F.col("n").cast("string"), 20, "0"), F.lpad(F.col("seq").cast("string"), 20, "0")).alias("key"), F.concat(F.coalesce(F.col("value").cast("string"), F.lit("x")), id_code(F.col("n"))).alias("text"))
    times = new.select("t").distinct().select(F.lit(5).alias("part"), F.concat(time_key, F.lit("a")).alias("key"), F.concat(F.lit("#"), F.col("t").cast("string")).alias("text"))
    out = fixed
    for part in (head, dump, times, values):
        out = out.unionByName(part)
    return out


def write_vcd(waves: DataFrame, signals: DataFrame, path: str, overwrite: bool = False) -> None:
    """to_vcd's lines as the document at path."""
    documents.write_lines(to_vcd(waves, signals), path, overwrite)
