"""Layout streams (GDSII), read in byte ranges by many tasks.

Records stand one behind the other with nothing to mark where one begins, so a range can't be read without knowing where the one
before it ends. A first pass guesses: each range takes the first place from which a run of records has types and data types of the
format, follows the records to its end, and writes a row with where it entered, where the next range must enter, how many structures and
elements began and the last structure's name. The guess holds if it is where the range before has come out; as the first range begins
with the file, agreement all along proves every one of them. A range that doesn't agree is joined to the one before and followed again from there, so a
wrong guess costs time and never a record. A running sum over these rows, one for each range, gives every range its structure and its
first element's number. The second pass then reads each range on its own and gathers elements into rows where they are:
the task in whose range an element begins follows it to its end. Elements aren't shuffled, and a task holds a block at a time.

Readers take only the element types that are asked for; others are passed over while their bytes are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netframe.functions.text import ibm_real, signed, unsigned
from netframe.operators.components import written
from netframe.sources.ranges import BLOCK_BYTES, RANGE_BYTES, Batches, byte_ranges, carried, dealt, open_source, rows_of

# fixed values of the format: record types
BGNLIB, LIBNAME, UNITS, ENDLIB, BGNSTR, STRNAME, ENDSTR = 0x01, 0x02, 0x03, 0x04, 0x05, 0x06, 0x07
BOUNDARY, PATH, SREF, AREF, TEXT, LAYER, DATATYPE, WIDTH, XY, ENDEL = 0x08, 0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x0E, 0x0F, 0x10, 0x11
SNAME, COLROW, NODE, TEXTTYPE, STRING, STRANS, MAG, ANGLE, PATHTYPE, BOX, BOXTYPE = 0x12, 0x13, 0x15, 0x16, 0x19, 0x1A, 0x1B, 0x1C, 0x21, 0x2D, 0x2E
# fixed values of the format: record types by the data type that they have (none, bits, two and four byte integers, eight byte reals, text)
DATA_TYPES = {
    0: (ENDLIB, ENDSTR, BOUNDARY, PATH, SREF, AREF, TEXT, ENDEL, NODE, BOX),
    1: (0x17, STRANS, 0x26),
    2: (0x00, BGNLIB, BGNSTR, LAYER, DATATYPE, COLROW, TEXTTYPE, PATHTYPE, 0x22, 0x2A, 0x2B, BOXTYPE),
    3: (WIDTH, XY, 0x2F, 0x30, 0x31),
    5: (UNITS, MAG, ANGLE),
    6: (LIBNAME, STRNAME, SNAME, STRING, 0x1F, 0x20, 0x23, 0x2C),
}
_HEADS = frozenset(kind << 8 | data for data, kinds in DATA_TYPES.items() for kind in kinds)
_STARTS = frozenset((BOUNDARY, PATH, SREF, AREF, TEXT, BOX, NODE))
#: Where the length of two bytes ends.
MAX_RECORD = 0xFFFF
#: Records that have to follow each other for a place to be taken as one where a record begins, and bytes that are looked at for them.
PROBE_RECORDS, PROBE_BYTES = 24, 1 << 18
#: The exit of a range that the library or the file ends in.
ENDED = -1

ATTRIBUTES = {
    "layer": LAYER, "datatype": DATATYPE, "texttype": TEXTTYPE, "boxtype": BOXTYPE, "width": WIDTH, "path_type": PATHTYPE, "xy": XY,
    "sname": SNAME, "colrow": COLROW, "string": STRING, "strans": STRANS, "mag": MAG, "angle": ANGLE,
}
_RANGE = "path string, length long, begin long, end long, entry long"
_SUMMARY = _RANGE + ", leave long, n_cells long, last_name string, n_elements long"
_ELEMENT = "path string, cell_id long, cell string, seq long, kind int, " + ", ".join(f"{a} binary" for a in ATTRIBUTES)
_RECORD = "path string, off long, rectype int, body binary, cell_id long, cell string, seq long"


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


# -- bytes ----------------------------------------------------------------------------------------------------------


def records(source: BinaryIO, size: int, at: int, block: int = BLOCK_BYTES) -> Iterator[tuple[int, int, bytes]]:
    """(offset, type, body) of the records from at to the end of the library. One that is too short or overruns the file raises ValueError."""
    held, base = b"", at
    while at + 4 <= size:
        k = at - base
        if len(held) - k <= MAX_RECORD and base + len(held) < size:
            source.seek(base + len(held))
            held, base, k = held[k:] + source.read(block), at, 0
        n, kind = held[k] << 8 | held[k + 1], held[k + 2]
        if n < 4 or at + n > size:
            raise ValueError(f"bad record at byte {at}")
        yield at, kind, held[k + 4 : k + n]
        at += n
        if kind == ENDLIB:
            return


def guess(source: BinaryIO, size: int, begin: int, end: int) -> int | None:
    """The first place of a range from which records of the format follow each other, or None."""
    source.seek(begin)
    window = source.read(min(MAX_RECORD, end - begin) + PROBE_BYTES)
    whole = begin + len(window) >= size
    for first in range(min(MAX_RECORD, end - begin)):
        at, seen = first, 0
        while seen < PROBE_RECORDS and at + 4 <= len(window):
            n = window[at] << 8 | window[at + 1]
            if n < 4 or n & 1 or (window[at + 2] << 8 | window[at + 3]) not in _HEADS:
                seen = -1
                break
            at += n
            seen += 1
            if window[at - n + 2] == ENDLIB:
                seen = PROBE_RECORDS
        if seen >= PROBE_RECORDS or (seen > 0 and not whole and at + 4 > len(window)):
            return begin + first
    return None


def _text(body: bytes) -> str:
    return body.rstrip(b"\0").decode("latin-1")


def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The summary of each range: the first begins with its file, others enter where they are told or guess."""
    out = Batches(_arrow(_SUMMARY))
    for row in rows_of(batches):
        size, end, entry = row["length"], row["end"], row["entry"]
        leave, n_cells, name, n_elements = None, 0, None, 0
        with open_source(row["path"], row.get("content")) as source:
            if entry is None:
                entry = 0 if row["begin"] == 0 else guess(source, size, row["begin"], end)
            if entry is not None and entry >= end and end < size:
                leave = entry
            elif entry is not None:
                try:
                    for at, kind, body in records(source, size, entry):
                        if at >= end:
                            leave = at
                            break
                        n_cells += kind == BGNSTR
                        n_elements += kind in _STARTS
                        name = _text(body) if kind == STRNAME else name
                    else:
                        leave = ENDED
                except ValueError:  # a wrong guess, or the second pass says so
                    leave = None
        yield from out.add((row["path"], size, row["begin"], end, entry, leave, n_cells, name, n_elements), 100)
    yield from out.flush()


def elements(batches: Iterator[pa.RecordBatch], kinds: frozenset[int] = _STARTS) -> Iterator[pa.RecordBatch]:
    """The elements of some types that begin in each range, of its summary and what is before it."""
    out, wanted = Batches(_arrow(_ELEMENT)), frozenset(ATTRIBUTES.values())
    for row in rows_of(batches):
        path, end, cell_id, name, seq = row["path"], row["end"], row["cells_before"], row["name_before"], row["elements_before"]
        own, kind_of = None, None
        with open_source(path, row.get("content")) as source:
            for at, kind, body in _checked(path, source, row):
                if at >= end and own is None:
                    break
                if kind in _STARTS:
                    if at >= end:
                        break
                    seq += 1
                    own, kind_of = ({} if kind in kinds else None), kind
                elif kind == ENDEL:
                    if own is not None:
                        row_of = (path, cell_id, name, seq, kind_of, *(own.get(a) for a in ATTRIBUTES.values()))
                        yield from out.add(row_of, 200 + sum(map(len, own.values())))
                        own = None
                elif kind == BGNSTR:
                    cell_id += 1
                elif kind == STRNAME:
                    name = _text(body)
                elif own is not None and kind in wanted:
                    own.setdefault(kind, body)
    yield from out.flush()


def framed(batches: Iterator[pa.RecordBatch], kinds: frozenset[int] | None = None) -> Iterator[pa.RecordBatch]:
    """The records of some types (all if None) that begin in each range, with the structure and the number of elements so far."""
    out = Batches(_arrow(_RECORD))
    for row in rows_of(batches):
        path, end, cell_id, name, seq = row["path"], row["end"], row["cells_before"], row["name_before"], row["elements_before"]
        with open_source(path, row.get("content")) as source:
            for at, kind, body in _checked(path, source, row):
                if at >= end:
                    break
                cell_id += kind == BGNSTR
                seq += kind in _STARTS
                name = _text(body) if kind == STRNAME else name
                if kinds is None or kind in kinds:
                    yield from out.add((path, at, kind, body, cell_id, name, seq), 200 + len(body))
    yield from out.flush()


def _checked(path: str, source: BinaryIO, row: dict) -> Iterator[tuple[int, int, bytes]]:
    if row["length"] < 4:
        raise ValueError(f"{path}: not a layout stream")
    try:
        yield from records(source, row["length"], row["entry"])
    except ValueError as e:
        raise ValueError(f"{path}: {e}") from None


def proven(ranges: DataFrame) -> DataFrame:
    """Summaries of ranges (path, length, begin, end) whose entries agree all along each file, with cells_before, name_before and elements_before; ranges behind the end of a library are left out."""
    state = written(dealt(ranges.withColumn("entry", F.lit(None).cast("long"))).mapInArrow(follow, _SUMMARY), "ranges")
    order = Window.partitionBy("path").orderBy("begin")  # rows of ranges
    while True:
        over = F.coalesce(F.max(F.col("leave") == ENDED).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
        agrees = (F.col("begin") == 0) | F.coalesce(F.col("entry") == F.lag("leave").over(order), F.lit(False))
        seen = state.withColumn("over", over).withColumn("joins", ~(F.col("over") | agrees))
        if seen.where("joins").isEmpty():
            break
        runs = seen.withColumn("run", F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(order))
        first = [F.min_by(c, "begin").alias(c) for c in ("length", "entry", "leave", "n_cells", "last_name", "n_elements")]
        met = runs.groupBy("path", "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), *first, F.count(F.lit(1)).alias("n"))
        columns = [x.split()[0] for x in _SUMMARY.split(", ")]
        again = written(met.where("n > 1").select(*columns[:5]), "ranges")
        state = written(met.where("n = 1").select(*columns).unionByName(dealt(again).mapInArrow(follow, _SUMMARY)), "ranges")
    held = carried(seen.where("NOT over"), cells_before=("n_cells", "sum"), name_before=("last_name", "last"), elements_before=("n_elements", "sum"))
    return written(held, "ranges")


# -- tables ---------------------------------------------------------------------------------------------------------


def _string(body: Column) -> Column:
    return F.regexp_replace(F.decode(body, "ISO-8859-1"), "\\x00+$", "")


def _points(body: Column) -> Column:
    """The points of an XY record."""
    words = F.transform(F.sequence(F.lit(0), F.greatest(F.length(body) / 8 - 1, F.lit(0)).cast("int")), lambda i: F.substring(F.hex(body), i * 16 + 1, F.lit(16)))

    def number(digits: Column) -> Column:
        value = F.conv(digits, 16, 10).cast("long")
        return F.when(value >= 1 << 31, value - (1 << 32)).otherwise(value)

    return F.transform(words, lambda w: F.struct(number(F.substring(w, 1, 8)).alias("x"), number(F.substring(w, 9, 8)).alias("y")))


class Layout:
    """Tables of the layouts in ranges, as proven() gives them."""

    def __init__(self, ranges: DataFrame):
        self.ranges = ranges
        self._cells = None

    @classmethod
    def of_streams(cls, files: DataFrame) -> Layout:
        """Layouts whose streams are at hand: (path, content), each one range of its own."""
        size, zero = F.octet_length("content").cast("long"), F.lit(0).cast("long")
        return cls(files.select("path", "content", size.alias("length"), zero.alias("begin"), size.alias("end"), zero.alias("entry"), zero.alias("cells_before"), F.lit(None).cast("string").alias("name_before"), zero.alias("elements_before")))

    def _dealt(self) -> DataFrame:
        return self.ranges if "content" in self.ranges.columns else dealt(self.ranges)

    def records(self, *kinds: int) -> DataFrame:
        """(path, off, rectype, body, cell_id, cell, seq) of the records of some types, or of all."""
        wanted = frozenset(kinds) or None
        return self._dealt().mapInArrow(lambda batches: framed(batches, wanted), _RECORD)

    def elements(self, *kinds: int) -> DataFrame:
        """(path, cell_id, cell, seq, kind, the bytes of each attribute) of the elements of some types, or of all."""
        wanted = frozenset(kinds) or _STARTS
        return self._dealt().mapInArrow(lambda batches: elements(batches, wanted), _ELEMENT)

    def library(self) -> DataFrame:
        """(path, lib, user_unit, db_unit_m)."""
        real = lambda k: F.max(F.when(F.col("rectype") == UNITS, ibm_real(F.substring(F.hex("body"), 16 * k + 1, 16))))
        return self.records(LIBNAME, UNITS).groupBy("path").agg(F.max(F.when(F.col("rectype") == LIBNAME, _string(F.col("body")))).alias("lib"), real(0).alias("user_unit"), real(1).alias("db_unit_m"))

    def _structures(self) -> DataFrame:
        """(path, cell, cell_id) of every structure, written once."""
        if self._cells is None:
            self._cells = written(self.records(STRNAME).select("path", "cell", "cell_id"), "structures")
        return self._cells

    def cells(self) -> DataFrame:
        """(path, cell_id, cell); of equal names the last one holds."""
        return self._structures().groupBy("path", "cell").agg(F.max("cell_id").alias("cell_id"))

    def _of(self, *kinds: int) -> DataFrame:
        """Elements, without those of structures that a later one of the same name replaces."""
        last = self.cells().select("path", "cell", F.col("cell_id").alias("last"))
        replaced = self._structures().join(last, ["path", "cell"]).where("cell_id < last").select("path", "cell_id")
        return self.elements(*kinds).join(replaced, ["path", "cell_id"], "left_anti")

    def boundaries(self) -> DataFrame:
        """(path, cell, seq, layer, datatype, ring); boxes are boundaries too."""
        return self._of(BOUNDARY, BOX).select("path", "cell", "seq", signed(F.col("layer"), 0, 2).alias("layer"), signed(F.coalesce("datatype", "boxtype"), 0, 2).alias("datatype"), _points(F.col("xy")).alias("ring"))

    def paths(self) -> DataFrame:
        """(path, cell, seq, layer, datatype, width, path_type, pts)."""
        return self._of(PATH).select("path", "cell", "seq", signed(F.col("layer"), 0, 2).alias("layer"), signed(F.col("datatype"), 0, 2).alias("datatype"), F.coalesce(signed(F.col("width"), 0, 4), F.lit(0)).alias("width"), F.coalesce(signed(F.col("path_type"), 0, 2), F.lit(0)).alias("path_type"), _points(F.col("xy")).alias("pts"))

    def texts(self) -> DataFrame:
        """(path, cell, seq, layer, texttype, x, y, value)."""
        return self._of(TEXT).select("path", "cell", "seq", signed(F.col("layer"), 0, 2).alias("layer"), signed(F.col("texttype"), 0, 2).alias("texttype"), signed(F.col("xy"), 0, 4).alias("x"), signed(F.col("xy"), 4, 4).alias("y"), _string(F.col("string")).alias("value"))

    def references(self) -> DataFrame:
        """(path, parent, child, ref_id, ox, oy, angle, mirror, mag, n_cols, n_rows, col_dx, col_dy, row_dx, row_dy): steps of arrays by truncating division."""
        own = self._of(SREF, AREF).withColumn("pts", _points(F.col("xy")))
        n_cols, n_rows = (F.coalesce(unsigned(F.col("colrow"), k, 2), F.lit(1)) for k in (0, 2))
        step = lambda k, c, n: F.when(F.col("kind") == AREF, F.expr(f"(pts[{k}].{c} - pts[0].{c}) div greatest({n}, 1)")).otherwise(F.lit(0).cast("long"))
        made = own.withColumn("n_cols", n_cols).withColumn("n_rows", n_rows)
        return made.select(
            "path", F.col("cell").alias("parent"), _string(F.col("sname")).alias("child"), F.col("seq").alias("ref_id"), F.get(F.col("pts"), F.lit(0))["x"].alias("ox"), F.get(F.col("pts"), F.lit(0))["y"].alias("oy"),
            F.coalesce(ibm_real(F.hex("angle")), F.lit(0.0)).alias("angle"), F.coalesce(unsigned(F.col("strans"), 0, 2).bitwiseAND(0x8000) != 0, F.lit(False)).alias("mirror"), F.coalesce(ibm_real(F.hex("mag")), F.lit(1.0)).alias("mag"),
            "n_cols", "n_rows", step(1, "x", "n_cols").alias("col_dx"), step(1, "y", "n_cols").alias("col_dy"), step(2, "x", "n_rows").alias("row_dx"), step(2, "y", "n_rows").alias("row_dy"),
        )


class LayoutTables:
    """A layout whose tables are at hand already (columns as Layout's methods give them): what extract takes from a lake instead of a stream."""

    def __init__(self, **tables: DataFrame):
        for name in ("cells", "boundaries", "paths", "texts", "references"):
            setattr(self, name, lambda table=tables[name]: table)


def read_gds(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> Layout:
    """Layouts at path, read in ranges of so many bytes."""
    return Layout(proven(byte_ranges(spark, path, range_bytes)))
