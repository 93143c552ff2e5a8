"""Files as byte ranges that tasks read on their own, and state that runs through a file as a scan over summaries of its ranges.

Spark lists the files (no content is read); a range is a row (path, length, begin, end). What a format carries from one range to the next
(the section that is open, the last time, how many cells there were) is summed up for each range by a first pass, a row each; a window over
these few rows gives every range what comes before it, and a second pass reads with that. No window runs over records, and a task
holds a block of its range at a time."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from typing import Any, BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RANGE_BYTES = 8 << 20
#: Bytes that a task asks a store for at a time.
BLOCK_BYTES = 1 << 20
#: Rows, and about as many bytes, of an Arrow batch.
BATCH_ROWS, BATCH_BYTES = 5000, 8 << 20
#: Tasks that ranges are dealt to at most.
MAX_TASKS = 20_000


def byte_ranges(spark: SparkSession, path: str, size: int = RANGE_BYTES) -> DataFrame:
    """(path, length, begin, end) of the files at path; an empty file is one empty range."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")  # the content column isn't asked for, so it isn't read
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(size).cast("long"))).alias("begin")
    return files.select("path", "length", begin).withColumn("end", F.least(F.col("begin") + size, "length"))


def dealt(ranges: DataFrame) -> DataFrame:
    """The ranges (a written table, or a listing) in tasks of about RANGE_BYTES each; small files share one."""
    n, size = ranges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("end") - F.col("begin")), F.lit(0))).first()
    return ranges.repartition(max(1, min(n, MAX_TASKS, max(ranges.sparkSession.sparkContext.defaultParallelism, size // RANGE_BYTES))))


def open_source(path: str, content: bytes | None = None) -> BinaryIO:
    """An open file of any store that Arrow knows, or of bytes that are at hand."""
    if content is not None:
        return io.BytesIO(content)
    local = re.match(r"file:/+", path)
    if local:  # Spark writes file:/x, and doesn't escape
        return fs.LocalFileSystem().open_input_file("/" + path[local.end() :])
    store, place = fs.FileSystem.from_uri(path)
    return store.open_input_file(place)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, Any]]:
    """A row at a time, as ranges and files are few and may hold contents."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


class Batches:
    """Collects rows into Arrow batches of a schema, of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.held = schema, [], 0

    def add(self, row: tuple, size: int) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.held += size
        if len(self.rows) >= BATCH_ROWS or self.held >= BATCH_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = zip(*self.rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)
            self.rows, self.held = [], 0


def carried(summaries: DataFrame, **state: tuple[str, str]) -> DataFrame:
    """Each range with what the ranges before it in its file leave behind. state: name = (column, how): `sum`, or `last` for the last value that isn't null."""
    before = Window.partitionBy("path").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a file
    ways = {"sum": lambda c: F.coalesce(F.sum(c).over(before), F.lit(0).cast("long")), "last": lambda c: F.last(c, ignorenulls=True).over(before)}
    return summaries.withColumns({name: ways[how](column) for name, (column, how) in state.items()})


def whole(files: DataFrame) -> DataFrame:
    """Texts that are at hand, (path, value), as one range each."""
    content = F.encode(F.coalesce("value", F.lit("")), "UTF-8")
    size, zero = F.octet_length("value").cast("long"), F.lit(0).cast("long")
    return files.select("path", content.alias("content"), F.coalesce(size, zero).alias("length"), zero.alias("begin"), F.coalesce(size, zero).alias("end"))


def lines(source: BinaryIO, size: int, begin: int, block: int = BLOCK_BYTES) -> Iterator[tuple[int, bytes]]:
    """(offset, line with its end) of the lines that begin at begin or behind it."""
    at, held, skipping = max(0, begin - 1), b"", begin > 0
    source.seek(at)
    while at + len(held) < size:
        held += source.read(min(block, size - at - len(held)))
        *ended, held = held.split(b"\n")
        for line in ended:
            if not skipping:
                yield at, line + b"\n"
            skipping = False
            at += len(line) + 1
    if held and not skipping:
        yield at, held
