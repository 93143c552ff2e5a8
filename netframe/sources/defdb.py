"""Routed databases (DEF): components, pins and nets as tables. Routing is skipped.

A file is read in byte ranges. A statement belongs to the range in which the terminator before it is the first one of a line that begins there
or later, so ranges agree without seeing each other; its task follows it to its end. The section that a range begins in comes from a
first pass: each range's last section head, carried on over the ranges of a file."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netframe.operators.components import written
from netframe.sources.ranges import RANGE_BYTES, Batches, byte_ranges, carried, dealt, lines, open_source, rows_of, whole

_SECTION = re.compile(r"(COMPONENTS|PINS|NETS|SPECIALNETS) \d+")
_COMMENT, _ENDED, _TERMINATOR = re.compile(r"#[^\n]*"), re.compile(r"^(?:END \w+ )+"), re.compile(r";\s")


def range_statements(source: BinaryIO, size: int, begin: int, end: int) -> Iterator[tuple[int, str]]:
    """(offset, text) of a range's statements, blanks made single and `END section` before them taken off."""
    held, start, skipping = [], 0, begin > 0
    for at, raw in lines(source, size, begin):
        line, last = _COMMENT.sub(" ", raw.decode(errors="replace")), 0
        for found in _TERMINATOR.finditer(line):
            held.append(line[last : found.start()])
            if not skipping:
                yield start, _plain(held)
            held, start, last, skipping = [], at + found.end(), found.end(), False
            if at >= end:
                return
        held.append(line[last:])
    if not skipping and "".join(held).strip():
        yield start, _plain(held)


def _plain(parts: list[str]) -> str:
    return _ENDED.sub("", " ".join("".join(parts).split()))


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each range with its last section."""
    out = Batches(pa.schema([("path", pa.string()), ("length", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("last", pa.string())]))
    for row in rows_of(batches):
        with open_source(row["path"], row.get("content")) as source:
            found = [m[1] for _, text in range_statements(source, row["length"], row["begin"], row["end"]) if (m := _SECTION.fullmatch(text))]
        yield from out.add((row["path"], row["length"], row["begin"], row["end"], found[-1] if found else None), 100)
    yield from out.flush()


def _statements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = Batches(pa.schema([("path", pa.string()), ("seq", pa.int64()), ("text", pa.string()), ("section", pa.string())]))
    for row in rows_of(batches):
        section = row["section"]
        with open_source(row["path"], row.get("content")) as source:
            for at, text in range_statements(source, row["length"], row["begin"], row["end"]):
                head = _SECTION.fullmatch(text)
                section = head[1] if head else section
                yield from out.add((row["path"], at, text, section), 100 + len(text))
    yield from out.flush()


class RoutedDatabase:
    """Tables of the databases in ranges (path, length, begin, end, section, and content where the text is at hand)."""

    def __init__(self, ranges: DataFrame):
        at_hand = "content" in ranges.columns
        self.statements = (ranges if at_hand else dealt(ranges)).mapInArrow(_statements, "path string, seq long, text string, section string")

    @classmethod
    def of_texts(cls, files: DataFrame) -> RoutedDatabase:
        """Databases whose text is at hand: (path, value)."""
        return cls(whole(files).withColumn("section", F.lit(None).cast("string")))

    def design(self) -> DataFrame:
        """(path, name, units_per_micron, die_xlo, die_ylo, die_xhi, die_yhi)."""
        get = lambda pattern, k=1: F.max(F.nullif(F.regexp_extract("text", pattern, k), F.lit("")))
        die = r"^DIEAREA \( (-?\d+) (-?\d+) \) \( (-?\d+) (-?\d+) \)"
        return self.statements.groupBy("path").agg(get(r"^DESIGN (\S+)$").alias("name"), get(r"^UNITS DISTANCE MICRONS (\d+)").cast("long").alias("units_per_micron"), *(get(die, k + 1).cast("long").alias(c) for k, c in enumerate(("die_xlo", "die_ylo", "die_xhi", "die_yhi"))))

    def _entries(self, *sections: str) -> DataFrame:
        return self.statements.where(F.col("section").isin(*sections) & F.col("text").startswith("- "))

    def components(self) -> DataFrame:
        """(path, name, cell, x, y, orientation); x and y are null where a component isn't placed."""
        at = r"\+ (?:PLACED|FIXED|COVER) \( (-?\d+) (-?\d+) \) (\w+)"
        get = lambda k: F.nullif(F.regexp_extract("text", at, k), F.lit(""))
        return self._entries("COMPONENTS").select("path", F.split("text", " ")[1].alias("name"), F.split("text", " ")[2].alias("cell"), get(1).cast("long").alias("x"), get(2).cast("long").alias("y"), get(3).alias("orientation"))

    def pins(self) -> DataFrame:
        """(path, name, direction, net)."""
        return self._entries("PINS").select("path", F.split("text", " ")[1].alias("name"), F.lower(F.regexp_extract("text", r"\+ DIRECTION (\w+)", 1)).alias("direction"), F.regexp_extract("text", r"\+ NET (\S+)", 1).alias("net"))

    def net_pins(self) -> DataFrame:
        """(path, net, special, instance, pin): instance is null for the design's own pins."""
        own = F.regexp_extract("text", r"^- \S+([^+]*)", 1)
        each = self._entries("NETS", "SPECIALNETS").select("path", F.split("text", " ")[1].alias("net"), (F.col("section") == "SPECIALNETS").alias("special"), F.explode(F.regexp_extract_all(own, F.lit(r"\( (\S+) (\S+) "), F.lit(0))).alias("p"))
        part = F.split("p", " ")
        return each.select("path", "net", "special", F.nullif(part[1], F.lit("PIN")).alias("instance"), part[2].alias("pin"))


def read_def(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> RoutedDatabase:
    """Databases at path, read in ranges of so many bytes."""
    summaries = written(dealt(written(byte_ranges(spark, path, range_bytes), "ranges")).mapInArrow(_heads, "path string, length long, begin long, end long, last string"), "ranges")
    return RoutedDatabase(written(carried(summaries, section=("last", "last")), "ranges"))
