"""Queries over sources and over the whole extraction: the driver's tables are drawn as a layout or written as files, which are read again.

A file holds a bounded range of keys, so its text is gathered in one group of known size."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netframe.functions.geometry import ring_box
from netframe.functions.text import escape_identifier
from netframe.operators import render, scoring
from netframe.operators.extract import Extracted, Netlist, extract
from netframe.plans.bridge import ctes, rings, view
from netframe.operators.components import dealt, shared_folder
from netframe.operators.netlist import numbered
from netframe.sources import defdb, documents, gds, jsonir, vcd, verilog
from netframe.sources.files import write_files

QUERIES, ORACLES = {}, {}

#: Keys that one written file holds, and bytes of the ranges that files are read in: each file is cut several times.
KEYS = 500
RANGE = 16_384


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _files(lines: DataFrame, head: Column, tail: str) -> DataFrame:
    """(path, value) of lines (key, line), KEYS keys a file, in the order of keys."""
    held = lines.groupBy(F.floor(F.col("key") / KEYS).alias("file")).agg(F.array_sort(F.collect_list(F.struct("key", "line"))).alias("held"))
    return held.select(F.concat(F.lit("f"), F.col("file").cast("string")).alias("path"), F.concat(head, F.array_join(F.col("held.line"), ""), F.lit(tail)).alias("value"))


# -- layout streams -------------------------------------------------------------------------------------------------


def _words(n: Column, digits: int) -> Column:
    """n as a big-endian number of so many hexadecimal digits."""
    return F.lpad(F.hex(F.pmod(n.cast("long"), F.lit(1 << (4 * digits)))), digits, "0")


def _record(kind: int, dtype: int, body: Column) -> Column:
    return F.concat(_words(F.length(body) / 2 + 4, 4), F.lit(f"{kind:02X}{dtype:02X}"), body)


@query(f"WITH {ctes('v_ring')} SELECT CONCAT('f', poly_id // {KEYS}) AS path, 67 + poly_id % 6 AS layer, poly_id % 30 AS datatype, COUNT(*) + 1 AS n_points, MIN(x) - 700000 AS xlo, MIN(y) - 9 AS ylo, MAX(x) - 700000 AS xhi, MAX(y) - 9 AS yhi FROM v_ring GROUP BY poly_id")
def q_read_gds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings as boundaries of layout streams, with coordinates on both sides of zero."""
    closed = F.concat(F.col("ring"), F.slice("ring", 1, 1))
    points = F.array_join(F.transform(closed, lambda p: F.concat(_words(p["x"] - 700_000, 8), _words(p["y"] - 9, 8))), "")
    none = F.lit("")
    drawn = F.concat(_record(gds.BOUNDARY, 0, none), _record(gds.LAYER, 2, _words(67 + F.col("poly_id") % 6, 4)), _record(gds.DATATYPE, 2, _words(F.col("poly_id") % 30, 4)), _record(gds.XY, 3, points), _record(gds.ENDEL, 0, none))
    head = F.concat(_record(0, 2, F.lit("0258")), _record(gds.BGNSTR, 2, F.lit("0" * 48)), _record(gds.STRNAME, 6, F.hex(F.lit("rings."))))
    files = _files(rings(spark, sf_dir).select(F.col("poly_id").alias("key"), drawn.alias("line")), head, f"0004{gds.ENDSTR:02X}000004{gds.ENDLIB:02X}000000")
    streams = files.select("path", F.unhex("value").alias("content"))
    read = gds.Layout.of_streams(streams).boundaries()
    return read.select("path", "layer", "datatype", F.size("ring").cast("long").alias("n_points"), *ring_box("ring"))


def _on_disk(spark: SparkSession, files: DataFrame) -> str:
    """Writes files (path, content) to a new folder of the shared one; returns the folder."""
    folder = f"{shared_folder(spark)}/sources-{uuid.uuid4().hex}"
    write_files(files, folder)
    return folder


def _library(name: str, elements: DataFrame) -> DataFrame:
    """(path, content): streams of one structure that holds elements (key, line in hexadecimal digits)."""
    head = F.concat(_record(0, 2, F.lit("0258")), _record(gds.BGNLIB, 2, F.lit("0" * 48)), _record(gds.BGNSTR, 2, F.lit("0" * 48)), _record(gds.STRNAME, 6, F.hex(F.lit(name))))
    return _files(elements, head, f"0004{gds.ENDSTR:02X}000004{gds.ENDLIB:02X}00" + "0" * 64).select("path", F.unhex("value").alias("content"))


def _file_name() -> Column:
    return F.regexp_extract("path", "([^/]*)$", 1).alias("path")


def _element(kind: int, *parts: Column) -> Column:
    return F.concat(_record(kind, 0, F.lit("")), *parts, _record(gds.ENDEL, 0, F.lit("")))


def _even(text: Column) -> Column:
    """Text in hexadecimal digits, filled up to an even length."""
    raw = F.hex(F.encode(text, "ISO-8859-1"))
    return F.when(F.length(raw) % 4 == 0, raw).otherwise(F.concat(raw, F.lit("00")))


@query(
    f"WITH {ctes('v_ref')} SELECT CONCAT('f', ref_id // {KEYS}) AS path, child, ox - 5000 AS ox, oy, CAST(angle AS DOUBLE) AS angle, mirror, n_cols, n_rows, "
    "CASE WHEN n_cols * n_rows > 1 THEN dx ELSE 0 END AS col_dx, CASE WHEN n_cols * n_rows > 1 THEN dy ELSE 0 END AS row_dy FROM v_ref"
)
def q_read_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placements as references and arrays of layout streams, turned and mirrored, read from files in ranges."""
    refs = view(spark, sf_dir, "v_ref")
    array = F.col("n_cols") * F.col("n_rows") > 1
    angle = F.when(F.col("angle") == 90, "425A000000000000").when(F.col("angle") == 180, "42B4000000000000").when(F.col("angle") == 270, "4310E00000000000").otherwise("0" * 16)
    point = lambda x, y: F.concat(_words(x - 5000, 8), _words(y, 8))
    own = F.concat(_record(gds.SNAME, 6, _even(F.col("child"))), F.when(F.col("mirror"), _record(gds.STRANS, 1, F.lit("8000"))).otherwise(""), _record(gds.ANGLE, 5, angle))
    single = _element(gds.SREF, own, _record(gds.XY, 3, point(F.col("ox"), F.col("oy"))))
    corners = F.concat(point(F.col("ox"), F.col("oy")), point(F.col("ox") + F.col("n_cols") * F.col("dx"), F.col("oy")), point(F.col("ox"), F.col("oy") + F.col("n_rows") * F.col("dy")))
    many = _element(gds.AREF, own, _record(gds.COLROW, 2, F.concat(_words(F.col("n_cols"), 4), _words(F.col("n_rows"), 4))), _record(gds.XY, 3, corners))
    folder = _on_disk(spark, _library("refs", refs.select(F.col("ref_id").alias("key"), F.when(array, many).otherwise(single).alias("line"))))
    read = gds.read_gds(spark, folder, RANGE).references()
    return read.select(_file_name(), "child", "ox", "oy", "angle", "mirror", *(F.col(c).cast("long").alias(c) for c in ("n_cols", "n_rows", "col_dx", "row_dy")))


@query(f"WITH {ctes('v_label')} SELECT CONCAT('f', text_id // {KEYS}) AS path, 67 + level AS layer, text_id % 9 AS texttype, x - 20000 AS x, y, value FROM v_label")
def q_read_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as texts of layout streams, read from files in ranges."""
    parts = _record(gds.LAYER, 2, _words(67 + F.col("level"), 4)), _record(gds.TEXTTYPE, 2, _words(F.col("text_id") % 9, 4)), _record(gds.XY, 3, F.concat(_words(F.col("x") - 20_000, 8), _words(F.col("y"), 8))), _record(gds.STRING, 6, _even(F.col("value")))
    folder = _on_disk(spark, _library("texts.", view(spark, sf_dir, "v_label").select(F.col("text_id").alias("key"), _element(gds.TEXT, *parts).alias("line"))))
    return gds.read_gds(spark, folder, RANGE).texts().select(_file_name(), "layer", "texttype", "x", "y", "value")


@query(
    f"WITH {ctes('v_rect')} SELECT CONCAT('f', rect_id // {KEYS}) AS path, level AS layer, CASE WHEN rect_id % 5 = 0 THEN 0 ELSE rect_id % 30 END AS width, CASE WHEN rect_id % 3 = 0 THEN 2 ELSE 0 END AS path_type, "
    "xlo - 9 AS x0, ylo AS y0, xhi AS x1, CASE WHEN rect_id % 2 = 0 THEN ylo ELSE yhi END AS y1, CAST(2 + rect_id % 2 AS BIGINT) AS n_points FROM v_rect"
)
def q_read_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of two or three points, some without width or type, read from files in ranges."""
    k = F.col("rect_id")
    point = lambda x, y: F.concat(_words(x, 8), _words(y, 8))
    bend = point(F.col("xhi"), F.col("ylo"))
    points = F.concat(point(F.col("xlo") - 9, F.col("ylo")), bend, F.when(k % 2 == 1, point(F.col("xhi"), F.col("yhi"))).otherwise(""))
    parts = (
        _record(gds.LAYER, 2, _words(F.col("level"), 4)), _record(gds.DATATYPE, 2, F.lit("0014")), F.when(k % 3 == 0, _record(gds.PATHTYPE, 2, F.lit("0002"))).otherwise(""),
        F.when(k % 5 == 0, "").otherwise(_record(gds.WIDTH, 3, _words(k % 30, 8))), _record(gds.XY, 3, points),
    )
    folder = _on_disk(spark, _library("p", view(spark, sf_dir, "v_rect").select(k.alias("key"), _element(gds.PATH, *parts).alias("line"))))
    read = gds.read_gds(spark, folder, RANGE).paths()
    last = F.element_at("pts", -1)
    return read.select(_file_name(), "layer", F.col("width").cast("long").alias("width"), F.col("path_type").cast("int").alias("path_type"), F.col("pts")[0]["x"].alias("x0"), F.col("pts")[0]["y"].alias("y0"), last["x"].alias("x1"), last["y"].alias("y1"), F.size("pts").cast("long").alias("n_points"))


# -- waveforms ------------------------------------------------------------------------------------------------------


@query(f"WITH {ctes('v_wave')} SELECT CONCAT('f', event_id // {KEYS}) AS path, t, signal, COALESCE(CAST(value AS VARCHAR), 'x') AS value FROM v_wave")
def q_read_vcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waves written as waveform files and read in ranges: each change with the time it stands under, its signal by its short name."""
    waves = view(spark, sf_dir, "v_wave").withColumn("key", F.col("event_id"))
    code = F.concat(F.lit("s"), F.substring(F.col("signal"), 1, 3))
    value = F.coalesce(F.col("value").cast("string"), F.lit("x"))
    line = F.concat(F.when((F.col("key") % 3 == 0) | (F.col("key") % KEYS == 0), F.concat(F.lit("#"), F.col("t").cast("string"), F.lit("\n"))).otherwise(""), F.when(F.col("key") % 2 == 0, F.concat(value, code)).otherwise(F.concat(F.lit("b"), value, F.lit(" "), code)), F.lit("\n"))
    names = waves.select(code.alias("code"), "signal").distinct().agg(F.array_sort(F.collect_set(F.concat(F.lit("$var wire 1 "), "code", F.lit(" "), "signal", F.lit(" $end\n")))).alias("names"))  # a row of five declarations
    files = _files(waves.select("key", line.alias("line")), F.lit(""), "").crossJoin(F.broadcast(names)).select("path", F.concat(F.array_join("names", ""), F.lit("$enddefinitions $end\n"), "value").cast("binary").alias("content"))
    return vcd.read_vcd(spark, _on_disk(spark, files), RANGE).select(_file_name(), "t", "signal", "value")


# -- routed databases -----------------------------------------------------------------------------------------------


@query(f"WITH {ctes('v_pin')} SELECT DISTINCT CONCAT('f', inst_id // {KEYS}) AS path, CONCAT('n', inst_id) AS net, inst_id % 4 = 0 AS special, CASE WHEN pin = 2 THEN NULL ELSE CONCAT('u', net_id) END AS instance, CONCAT('A', pin) AS pin FROM v_pin")
def q_read_def_nets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nets of routed databases with comments, breaks and routing, plain ones and special ones in turn, read from files in ranges."""
    pins = view(spark, sf_dir, "v_pin")
    held = F.format_string("( %s A%d )%s", F.when(F.col("pin") == 2, "PIN").otherwise(F.concat(F.lit("u"), F.col("net_id").cast("string"))), "pin", F.when(F.col("pin") % 2 == 0, " # ; ( not A ) \n").otherwise(" "))
    nets = pins.groupBy("inst_id").agg(F.array_join(F.array_sort(F.collect_list(held)), "").alias("held"))
    k = F.col("inst_id")
    section = F.when(k % 4 == 0, "SPECIALNETS").otherwise("NETS")
    line = F.concat(section, F.lit(" 1 ;\n - n"), k.cast("string"), F.lit("\n "), "held", F.lit("+ ROUTED met1 ( 5 6 ) ( 7 8 ) ;\nEND "), section, F.lit("\n"))
    files = _files(nets.select(k.alias("key"), line.alias("line")), F.lit("DESIGN nets ;\n"), "END DESIGN\n").select("path", F.col("value").cast("binary").alias("content"))
    return defdb.read_def(spark, _on_disk(spark, files), RANGE).net_pins().select(_file_name(), "net", "special", "instance", "pin")


# -- Verilog --------------------------------------------------------------------------------------------------------


@query(f"WITH {ctes('v_pin')} SELECT 'u[' || inst_id || ']' AS name, replace(cell, ' ', '_') AS cell, 'A' || pin AS pin, CASE WHEN net_id % 2 = 0 THEN 'n' ELSE 'n.' END || net_id AS net FROM v_pin")
def q_read_verilog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances and pins of Verilog modules, with escaped names."""
    net = F.concat(F.when(F.col("net_id") % 2 == 0, "n").otherwise("n."), F.col("net_id").cast("string"))
    held = F.concat(F.lit(".A"), F.col("pin").cast("string"), F.lit("("), escape_identifier(net), F.lit(")"))
    insts = view(spark, sf_dir, "v_pin").groupBy("inst_id", "cell").agg(F.array_join(F.array_sort(F.collect_list(held)), ", ").alias("held"))
    name = F.concat(F.lit("u["), F.col("inst_id").cast("string"), F.lit("]"))
    lines = insts.select(F.col("inst_id").alias("key"), F.concat(F.lit("  "), escape_identifier(F.translate("cell", " ", "_")), F.lit(" "), escape_identifier(name), F.lit(" ("), "held", F.lit("); // "), "cell", F.lit(";\n")).alias("line"))
    read = verilog.StructuralVerilog(_files(lines, F.lit("module \\m[0] ();\n"), "endmodule\n"))
    return read.pins().join(read.instances(), ["path", "inst_id"]).select("name", "cell", "pin", "net")


# -- JSON -----------------------------------------------------------------------------------------------------------


@query(f"WITH {ctes('v_pin')} SELECT 'u\"' || inst_id AS instance, cell, inst_id * 10 AS x, inst_id % 2 = 1 AS mirror, 'A' || pin AS pin, CASE WHEN net_id % 9 = 0 THEN 'VPWR' || net_id ELSE 'n' || net_id END AS net, CASE WHEN net_id % 9 = 0 THEN 'power' ELSE 'signal' END AS kind, net_id % 9 = 0 AS labelled FROM v_pin")
def q_json_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A netlist's document, written by many tasks in ordered parts and read again: each pin with its instance and net."""
    pins = view(spark, sf_dir, "v_pin")
    k, net = F.col("inst_id"), F.col("net_id")
    insts = pins.select("inst_id", "cell").distinct().select("inst_id", F.concat(F.lit('u"'), k.cast("string")).alias("name"), "cell", (k * 10).alias("x"), k.alias("y"), F.lit(0.0).alias("angle"), (k % 2 == 1).alias("mirror"), *((k * 10 + n).alias(c) for n, c in enumerate(("xlo", "ylo", "xhi", "yhi"))))
    supply = net % 9 == 0
    nets = pins.select("net_id").distinct().select("net_id", F.concat(F.when(supply, "VPWR").otherwise("n"), net.cast("string")).alias("name"), supply.alias("named_in_layout"), F.when(supply, "power").otherwise("signal").alias("kind"), *((net + n).alias(c) for n, c in enumerate(("xlo", "ylo", "xhi", "yhi"))))
    ports = nets.where("named_in_layout").select("name", F.lit("inout").alias("direction"), "net_id")
    stats = insts.agg(*(F.count("*").alias(c) for c in jsonir.COUNTS.values()))
    netlist = Netlist(insts, pins.select("inst_id", F.concat(F.lit("A"), F.col("pin").cast("string")).alias("pin"), "net_id"), nets, ports, insts, stats, insts.where("inst_id % 100 = 7").select(F.col("name").alias("warning")), insts.limit(0).select("cell"))
    folder = f"{shared_folder(spark)}/document-{uuid.uuid4().hex}"
    jsonir.write_extraction(netlist, "top", folder)
    read = jsonir.read_document(spark, folder)
    named = read["nets"].select(F.col("name").alias("net"), "kind", "labelled")
    return read["pins"].join(read["instances"].select(F.col("name").alias("instance"), "cell", "x", "mirror"), "instance").join(named, "net").select("instance", "cell", "x", "mirror", "pin", "net", "kind", "labelled")


# -- documents that tasks write -------------------------------------------------------------------------------------

#: Ports are nets whose number PORTS divides.
PORTS = 10
_WRITTEN = (
    f"WITH {ctes('v_pin')}, n AS (SELECT *, CASE WHEN net_id % 3 = 0 THEN 'n[' || net_id || ']' ELSE 'n' || net_id END AS net FROM v_pin), p AS (SELECT DISTINCT net_id, net FROM n WHERE net_id % {PORTS} = 0) "
    "SELECT 'pin' AS kind, 'u/' || inst_id AS name, replace(cell, ' ', '_') AS cell, 'A' || pin AS pin, net FROM n UNION ALL "
    "SELECT 'port', net, CASE WHEN net_id % 4 = 0 THEN 'input' ELSE 'output' END, NULL, NULL FROM p UNION ALL SELECT DISTINCT 'net', net, NULL, NULL, NULL FROM n"
)


def _named_netlist(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """insts, pins, ports and nets, some by names that must be escaped."""
    pins = view(spark, sf_dir, "v_pin")
    number = F.col("net_id")
    net = F.when(number % 3 == 0, F.format_string("n[%d]", number)).otherwise(F.format_string("n%d", number))
    nets = pins.select("net_id", net.alias("name"), F.lit("signal").alias("kind")).distinct()
    ports = nets.where(number % PORTS == 0).select("name", F.when(number % 4 == 0, "input").otherwise("output").alias("direction"), F.col("name").alias("net"))
    insts = pins.select("inst_id", F.format_string("u/%d", "inst_id").alias("name"), F.translate("cell", " ", "_").alias("cell")).distinct()
    return insts, pins.select("inst_id", F.format_string("A%d", F.col("pin").cast("long")).alias("pin"), net.alias("net")), ports, nets.select("name", "kind")


def _listed(pins: DataFrame, ports: DataFrame, nets: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    row = lambda df, kind, *columns: df.select(F.lit(kind).alias("kind"), *(c.alias(n) for c, n in zip(columns, ("name", "cell", "pin", "net"))))
    out = row(pins, "pin", F.col("name"), F.col("cell"), F.col("pin"), F.col("net"))
    return out.unionByName(row(ports, "port", F.col("name"), F.col("direction"), none, none)).unionByName(row(nets, "net", F.col("name"), none, none, none))


@query(_WRITTEN)
def q_write_verilog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module written by many tasks as one committed document and read again: pins, ports and nets."""
    insts, pins, ports, _ = _named_netlist(spark, sf_dir)
    folder = f"{shared_folder(spark)}/module-{uuid.uuid4().hex}"
    verilog.write_verilog(insts, pins, ports, "m[0]", folder)
    read = verilog.read_written(spark, folder)
    pins, own = (dealt(df, "path", "inst_id") for df in (read.pins(), read.instances()))
    return _listed(pins.join(own, ["path", "inst_id"]), read.ports(), read.nets().select("name").distinct())


@query(_WRITTEN)
def q_write_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A netlist written by many tasks as one committed JSON document and read again: pins, ports and nets."""
    insts, pins, ports, nets = _named_netlist(spark, sf_dir)
    folder = f"{shared_folder(spark)}/netlist-{uuid.uuid4().hex}"
    jsonir.write_json_netlist("m", ports, nets, insts, pins, folder)
    read = jsonir.read_written_netlist(spark, folder)
    pins, own = dealt(read["pins"], "instance"), dealt(read["instances"].withColumnRenamed("name", "instance"), "instance")
    return _listed(pins.join(own, "instance").withColumnRenamed("instance", "name"), read["ports"], read["nets"])


_FIXED = "(0, '$timescale 1ns $end'), (1, '$scope module top $end'), (3, '$upscope $end'), (4, '$enddefinitions $end'), (5, '$dumpvars'), (7, '$end')"


@query(
    f"WITH {ctes('v_wave')}, s AS (SELECT signal, row_number() OVER (ORDER BY signal) - 1 AS k FROM (SELECT DISTINCT signal FROM v_wave)), "
    "b AS (SELECT *, LAG(value) OVER (PARTITION BY signal ORDER BY t, event_id) AS was FROM v_wave), c AS (SELECT t, k, event_id, COALESCE(CAST(value AS VARCHAR), 'x') || chr(CAST(33 + k AS INT)) AS line FROM b JOIN s USING (signal) WHERE value IS DISTINCT FROM was), "
    f"d AS (SELECT part, 0 AS t, 0 AS k, 0 AS e, line FROM (VALUES {_FIXED}) f(part, line) UNION ALL SELECT 2, 0, k, 0, '$var wire 1 ' || chr(CAST(33 + k AS INT)) || ' ' || signal || ' $end' FROM s UNION ALL SELECT 6, 0, k, 0, 'x' || chr(CAST(33 + k AS INT)) FROM s "
    "UNION ALL SELECT DISTINCT 8, t, -1, 0, '#' || t FROM c UNION ALL SELECT 8, t, k, event_id, line FROM c) SELECT row_number() OVER (ORDER BY part, t, k, e) - 1 AS n, line FROM d"
)
def q_write_vcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A waveform written by many tasks as one committed document: every line of it, in order."""
    wave = view(spark, sf_dir, "v_wave").withColumnRenamed("event_id", "seq")
    signals = numbered(wave.select("signal").distinct(), ["signal"], "n")
    folder = f"{shared_folder(spark)}/wave-{uuid.uuid4().hex}"
    vcd.write_vcd(wave, signals, folder)
    return documents.numbered_lines(spark, folder).withColumnRenamed("value", "line")


@query(
    f"WITH {ctes('v_rect')}, b AS (SELECT MIN(xlo) AS x0, MIN(ylo) AS y0, MAX(xhi) AS x1, MAX(yhi) AS y1 FROM v_rect), p AS (SELECT *, 1600::DOUBLE / (x1 - x0) AS s, CAST(round((y1 - y0) * 1600::DOUBLE / (x1 - x0)) AS BIGINT) AS h FROM b), "
    "r AS (SELECT level, rect_id, printf('<rect x=\"%.2f\" y=\"%.2f\" width=\"%.2f\" height=\"%.2f\" fill=\"%s\"/>', (xlo - x0) * s, (y1 - yhi) * s, (xhi - xlo) * s, (yhi - ylo) * s, list_extract(['#c0392b', '#2e86c1', '#28b463', '#f39c12', '#8e44ad', '#16a085'], level + 1)) AS line FROM v_rect, p WHERE level <= 5), "
    "d AS (SELECT 0 AS part, 0 AS level, 0 AS k, 0 AS id, printf('<svg xmlns=\"http://www.w3.org/2000/svg\" width=\"1600\" height=\"%d\" viewBox=\"0 0 1600 %d\">', h, h) AS line FROM p UNION ALL SELECT 1, 0, 0, 0, '<rect width=\"100%\" height=\"100%\" fill=\"#ffffff\"/>' "
    "UNION ALL SELECT 5, level, 0, 0, printf('<g id=\"%s\">', list_extract(['li1', 'met1', 'met2', 'met3', 'met4', 'met5'], level + 1)) FROM r GROUP BY level UNION ALL SELECT 5, level, 1, rect_id, line FROM r UNION ALL SELECT 5, level, 2, 0, '</g>' FROM r GROUP BY level UNION ALL SELECT 6, 0, 0, 0, '</svg>') "
    "SELECT row_number() OVER (ORDER BY part, level, k, id) - 1 AS n, line FROM d"
)
def q_write_svg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The picture of all rectangles, written by many tasks as one committed document: every line of it, in order."""
    folder = f"{shared_folder(spark)}/picture-{uuid.uuid4().hex}"
    render.write_svg(view(spark, sf_dir, "v_rect").withColumn("net", F.col("rect_id")), folder, by="layer")
    return documents.numbered_lines(spark, folder).withColumnRenamed("value", "line")


# -- extraction -----------------------------------------------------------------------------------------------------

PITCH = 1000


def _row_layout(spark: SparkSession, sf_dir: str) -> gds.LayoutTables:
    """A row of cells, one for each order, every other one mirrored: each fifth is a capacitor, the rest are inverters. Behind each
    cell whose key three doesn't divide, a wire leads to where the next cell's input is; every other wire is a path."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"))
    box = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    ring = "array<struct<x:long,y:long>>"
    own = [("inv_1", 1, 67, 20, box(0, 0, 20, 20)), ("inv_1", 2, 67, 20, box(80, 0, 100, 20)), ("inv_1", 3, 81, 4, box(-5, -10, 105, 30)), ("decap_3", 1, 67, 20, box(0, 0, 20, 20))]
    shapes = spark.createDataFrame([("f", *row) for row in own], f"path string, cell string, seq long, layer long, datatype long, ring {ring}")
    texts = spark.createDataFrame([("f", "inv_1", 4, 67, 5, 10, 10, "A"), ("f", "inv_1", 5, 67, 5, 90, 10, "Y"), ("f", "decap_3", 2, 67, 5, 10, 10, "VPWR")], "path string, cell string, seq long, layer long, texttype long, x long, y long, value string")
    at, zero, file = F.col("k") * PITCH, F.lit(0).cast("long"), F.lit("f").alias("path")
    point = lambda x, y: F.struct(x.alias("x"), F.lit(y).cast("long").alias("y"))
    wired = orders.where("k % 3 <> 0").select(file, F.lit("top").alias("cell"), F.col("k").alias("seq"), F.lit(67).cast("long").alias("layer"), F.lit(20).cast("long").alias("datatype"))
    wire_at = F.col("seq") * PITCH
    rects = wired.where("seq % 2 = 0").withColumn("ring", F.array(*(point(wire_at + x, y) for x, y in box(90, -15, PITCH + 10, 15))))
    paths = wired.where("seq % 2 = 1").select("*", F.lit(30).cast("long").alias("width"), zero.alias("path_type"), F.array(point(wire_at + 90, 0), point(wire_at + PITCH + 10, 0)).alias("pts"))
    refs = orders.select(file, F.lit("top").alias("parent"), F.when(F.col("k") % 5 == 0, "decap_3").otherwise("inv_1").alias("child"), F.col("k").alias("ref_id"), at.alias("ox"), zero.alias("oy"), F.lit(0.0).alias("angle"), (F.col("k") % 2 == 1).alias("mirror"), F.lit(1.0).alias("mag"), F.lit(1).cast("long").alias("n_cols"), F.lit(1).cast("long").alias("n_rows"), *(zero.alias(c) for c in ("col_dx", "col_dy", "row_dx", "row_dy")))
    cells = spark.createDataFrame([("f", 1, "inv_1"), ("f", 2, "decap_3"), ("f", 3, "top")], "path string, cell_id long, cell string")
    return gds.LayoutTables(cells=cells, boundaries=shapes.unionByName(rects), paths=paths, texts=texts, references=refs)


def _extracted(spark: SparkSession, sf_dir: str) -> Extracted:
    return extract(_row_layout(spark, sf_dir))


_ROW = (
    "WITH o AS (SELECT o_orderkey AS k, o_orderkey % 5 = 0 AS cap FROM orders), a AS (SELECT o.k, o.cap, CASE WHEN p.k % 3 <> 0 THEN p.k ELSE -o.k END AS net FROM o LEFT JOIN o p ON p.k = o.k - 1), "
    "pins AS (SELECT k, 'A' AS pin, net FROM a WHERE NOT cap UNION ALL SELECT k, 'Y', k FROM o WHERE NOT cap), power AS (SELECT net FROM a WHERE cap) "
)


@query(_ROW + f"SELECT k * {PITCH} AS x, pin, COUNT(*) OVER (PARTITION BY net) AS n_pins, CASE WHEN net IN (SELECT net FROM power) THEN 'power' ELSE 'signal' END AS kind FROM pins")
def q_extract_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pin of the extraction, with the number of pins on its net and the net's kind: a wire to a capacitor's pin is power."""
    found = _extracted(spark, sf_dir)
    on_net = found.pins.groupBy("net_id").agg(F.count("*").alias("n_pins")).join(found.nets.select("net_id", "kind"), "net_id")
    return found.pins.join(found.places.select("inst_id", "x"), "inst_id").join(on_net, "net_id").select("x", "pin", "n_pins", "kind")


@query("SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE o_orderkey % 5 <> 0 AND o_orderkey % 4 <> 0) AS n_found FROM orders")
def q_def_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of routed databases that the extraction has at the same corner of its abutment box; every fourth is written a step aside, and capacitors aren't extracted."""
    k = F.col("o_orderkey")
    corner = F.when(k % 2 == 1, "-30").otherwise("-10")
    line = F.format_string(" - u%d %s + SOURCE DIST + PLACED ( %d %s ) %s ;\n", k, F.when(k % 5 == 0, "decap_3").otherwise("inv_1"), k * PITCH - 5 + F.when(k % 4 == 0, 1).otherwise(0), corner, F.when(k % 2 == 1, "FS").otherwise("N"))
    lines = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("key"), line.alias("line"))
    read = defdb.RoutedDatabase.of_texts(_files(lines, F.concat(F.lit("DESIGN row ;\nCOMPONENTS "), F.size("held").cast("string"), F.lit(" ;\n")), "END COMPONENTS\nEND DESIGN\n"))
    return scoring.placements_found(read.components().select("cell", "x", "y"), _extracted(spark, sf_dir).instances.select("cell", F.col("xlo").alias("x"), F.col("ylo").alias("y")))


@query(
    "SELECT COUNT(*) AS instances, COUNT(*) FILTER (WHERE o_orderkey % 5 <> 0) AS logic_instances, CAST(SUM(CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 3 END) + COUNT(*) FILTER (WHERE o_orderkey % 3 <> 0) AS BIGINT) AS polygons, "
    "CAST(SUM(CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 2 END) + COUNT(*) FILTER (WHERE o_orderkey % 3 <> 0) AS BIGINT) AS rectangles, CAST(SUM(CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 2 END) AS BIGINT) AS labels, CAST(0 AS BIGINT) AS unbound, CAST(0 AS BIGINT) AS warnings FROM orders"
)
def q_extract_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extraction's counts: every placed instance, shapes of all layers, all labels."""
    return _extracted(spark, sf_dir).stats.select("instances", "logic_instances", "polygons", "rectangles", "labels", "unbound", "warnings")


def _block_layout(spark: SparkSession, sf_dir: str) -> gds.LayoutTables:
    """A block for each order, turned and mirrored in all eight ways: two inverters that a wire joins over two higher levels. In every third block one cut is missing."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"))
    box = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    wire = [(67, 20, box(100, 5, 160, 15)), (67, 44, box(150, 6, 156, 12)), (68, 20, box(145, 0, 200, 20)), (68, 44, box(185, 6, 190, 12)), (69, 20, box(180, 0, 280, 20)), (68, 20, box(260, 0, 310, 20)), (67, 44, box(302, 6, 306, 12)), (67, 20, box(300, 0, 311, 20))]
    last_cut = (68, 44, box(265, 6, 270, 12))
    inverter = [(67, 20, box(0, 0, 20, 20)), (67, 20, [(80, 0), (100, 0), (100, 30), (90, 30), (90, 20), (80, 20)])]
    drawn = {"inv_1": inverter, "joined": [*wire, last_cut], "open": wire}
    rows = [("f", cell, n, *shape) for cell, shapes in drawn.items() for n, shape in enumerate(shapes, 1)]
    boundaries = spark.createDataFrame(rows, "path string, cell string, seq long, layer long, datatype long, ring array<struct<x:long,y:long>>")
    texts = spark.createDataFrame([("f", "inv_1", 4, 67, 5, 10, 10, "A"), ("f", "inv_1", 5, 67, 5, 95, 10, "Y")], "path string, cell string, seq long, layer long, texttype long, x long, y long, value string")
    zero, one, file = F.lit(0).cast("long"), F.lit(1).cast("long"), F.lit("f").alias("path")
    plain = [F.lit(1.0).alias("mag"), one.alias("n_cols"), one.alias("n_rows"), *(zero.alias(c) for c in ("col_dx", "col_dy", "row_dx", "row_dy"))]
    k = F.col("k")
    top = orders.select(file, F.lit("top").alias("parent"), F.when(k % 3 == 0, "open").otherwise("joined").alias("child"), k.alias("ref_id"), (k * 2 * PITCH).alias("ox"), zero.alias("oy"), (90.0 * (k % 4)).cast("double").alias("angle"), (F.floor(k / 4) % 2 == 1).alias("mirror"), *plain)
    inner = spark.createDataFrame([("f", c, "inv_1", n, 300 * n, 0, 0.0, False) for c in ("joined", "open") for n in (0, 1)], "path string, parent string, child string, ref_id long, ox long, oy long, angle double, mirror boolean").select("*", *plain)
    cells = spark.createDataFrame([("f", n, c) for n, c in enumerate(("inv_1", "joined", "open", "top"))], "path string, cell_id long, cell string")
    paths = spark.createDataFrame([], "path string, cell string, seq long, layer long, datatype long, width long, path_type long, pts array<struct<x:long,y:long>>")
    return gds.LayoutTables(cells=cells, boundaries=boundaries, paths=paths, texts=texts, references=top.unionByName(inner))


@query("SELECT o_orderkey AS k, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 4 ELSE 3 END AS BIGINT) AS n_nets, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 END AS BIGINT) AS most, CAST(4 AS BIGINT) AS n_pins, CAST(o_orderkey % 4 AS BIGINT) AS quarters FROM orders")
def q_extract_nets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nets of each block: the inverters are two levels down, turned and mirrored with their block, and joined over three levels by cuts."""
    found = extract(_block_layout(spark, sf_dir))
    pins = found.pins.join(found.places.select("inst_id", F.floor((F.col("x") + PITCH) / (2 * PITCH)).alias("k"), "angle"), "inst_id")
    nets = pins.groupBy("k", "net_id").agg(F.count("*").alias("n"), F.max("angle").alias("angle"))
    return nets.groupBy("k").agg(F.count("*").alias("n_nets"), F.max("n").alias("most"), F.sum("n").alias("n_pins"), (F.max("angle") / 90).cast("long").alias("quarters"))
