"""Netlists as JSON: one document for a netlist, read into tables and written from them.

Documents are written by tasks in parts of their own, a line for each object; the parts one after the other are the document. read_document()
and read_written_netlist() read such parts line by line, each where it is."""

from __future__ import annotations

import json
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netframe.sources import documents

if TYPE_CHECKING:
    from netframe.operators.extract import Netlist

#: Rows of a list are lines: all but the first begin with a comma.
ROWS = "\n,"
SCHEMA = "name string, ports array<struct<name: string, direction: string, net: string>>, nets array<struct<name: string, kind: string>>, instances array<struct<name: string, cell: string, pins: map<string, string>>>"


def read_json_netlist(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """ports, nets, instances and pins."""
    doc = spark.read.json(path, schema=SCHEMA, multiLine=True)
    inst = doc.select(F.posexplode("instances").alias("inst_id", "i")).select(F.col("inst_id").cast("long").alias("inst_id"), "i.*")
    return {
        "ports": doc.select(F.inline("ports")),
        "nets": doc.select(F.inline("nets")),
        "instances": inst.select("inst_id", "name", "cell"),
        "pins": inst.select("inst_id", F.explode("pins").alias("pin", "net")),
    }


def write_json_netlist(name: str, ports: DataFrame, nets: DataFrame, insts: DataFrame, pins: DataFrame, path: str, overwrite: bool = False) -> None:
    """A netlist as the document at path: a line for each port, net and instance (inst_id, name, cell), with its pins (inst_id, pin, net). Of a pin's several nets none is lost: that is an error of the map."""
    own = pins.groupBy("inst_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("pin", "net")))).alias("pins"))
    each = insts.join(own, "inst_id", "left").withColumn("pins", F.coalesce("pins", F.expr("cast(map() as map<string,string>)")))
    row = lambda section, df, key, *columns: df.select(F.lit(section).alias("section"), key.alias("key"), F.to_json(F.struct(*columns)).alias("text"))
    rows = row(0, ports, F.col("name"), "name", "direction", "net").unionByName(row(1, nets, F.col("name"), "name", "kind")).unionByName(row(2, each, _number("inst_id"), "name", "cell", "pins"))
    head = f'{{"name":{json.dumps(name, ensure_ascii=False)},"ports":[\n'
    sections = [documents.Section(head, ROWS, "\n],"), documents.Section('"nets":[\n', ROWS, "\n],"), documents.Section('"instances":[\n', ROWS, "\n]}\n")]
    documents.write_document(rows, sections, path, overwrite)


def stats_json(stats: DataFrame) -> DataFrame:
    """(value): each row of stats as a document."""
    return stats.select(F.to_json(F.struct(*stats.columns)).alias("value"))


# fixed values of the document: names of the counts, by the names that extract gives them
COUNTS = {
    "instances": "instances", "logic_instances": "logic_instances", "polygons": "polygons", "rectangles": "rectangles", "nets_total": "nets", "nets_signal": "signal_nets", "labels": "labels",
    "unbound_pins": "unbound", "split_pins": "split_pins", "inferred_body_pins": "inferred_body_pins", "unknown_cells": "unknown_cells",
}
#: What a line of ports, nets or instances may have.
LINE = (
    "name string, direction string, net string, kind string, labelled boolean, bbox array<long>, cell string, x long, y long, abutment array<long>, angle double, mirror_x boolean, connections map<string,string>"
)


def document(netlist: Netlist, module: str) -> tuple[DataFrame, list[documents.Section]]:
    """Rows (section, key, text) and sections of the document of an extraction, counts first. write_extraction() writes them."""
    section = lambda n, df: df.select(F.lit(n).alias("section"), "key", "text")
    edges = F.array("xlo", "ylo", "xhi", "yhi")
    counts = netlist.stats.select(F.lit("").alias("key"), F.regexp_replace(F.to_json(F.struct(*(F.col(own).alias(name) for name, own in COUNTS.items()))), "\\}$", "").alias("text"))
    names = netlist.nets.select("net_id", F.col("name").alias("net"))
    ports = netlist.ports.join(names, "net_id", "left").select(F.col("name").alias("key"), F.to_json(F.struct("name", "direction", F.coalesce("net", F.lit("")).alias("net"))).alias("text"))
    nets = netlist.nets.select(_number("net_id"), F.to_json(F.struct("name", "kind", F.col("named_in_layout").alias("labelled"), edges.alias("bbox"))).alias("text"))
    held = netlist.pins.join(names, "net_id", "left").groupBy("inst_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("pin", F.coalesce("net", F.lit("")).alias("net"))))).alias("connections"))
    each = netlist.instances.join(held, "inst_id", "left").withColumn("connections", F.coalesce("connections", F.expr("cast(map() as map<string,string>)")))
    insts = each.select(_number("inst_id"), F.to_json(F.struct("name", "cell", "x", "y", edges.alias("abutment"), F.col("angle").cast("double").alias("angle"), F.col("mirror").alias("mirror_x"), "connections"), {"ignoreNullFields": "true"}).alias("text"))
    warnings = netlist.warnings.distinct().select(F.col("warning").alias("key"), F.expr("substring(to_json(array(warning)), 2, length(to_json(array(warning))) - 2)").alias("text"))
    rows = section(0, counts).unionByName(section(1, warnings)).unionByName(section(2, ports)).unionByName(section(3, nets)).unionByName(section(4, insts))
    own = f'{{"module":{json.dumps(module, ensure_ascii=False)}'
    sections = [documents.Section('{"stats":'), documents.Section(',"warnings":[\n', ROWS, "\n]},\n"), documents.Section(f'"netlist":{own},"ports":[\n', ROWS, "\n],"), documents.Section('"nets":[\n', ROWS, "\n],"), documents.Section('"instances":[\n', ROWS, "\n]}}\n")]
    return rows, sections


def write_extraction(netlist: Netlist, module: str, path: str, overwrite: bool = False) -> None:
    documents.write_document(*document(netlist, module), path, overwrite)


def _number(c: str) -> Column:
    return F.lpad(F.col(c).cast("string"), 20, "0").alias("key")


def _objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects with a name, a line each, of the document at path."""
    lines = documents.read_lines(spark, path).select(F.regexp_replace("value", "^,", "").alias("v")).where(F.col("v").startswith('{"name":') & F.col("v").endswith("}"))
    return lines.select(F.from_json("v", schema).alias("r")).select("r.*")


def read_written_netlist(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """ports, nets, instances (name, cell) and pins (instance, pin, net) of the document that write_json_netlist() made."""
    row = _objects(spark, path, "name string, direction string, net string, kind string, cell string, pins map<string,string>")
    insts = row.where("cell IS NOT NULL")
    return {
        "ports": row.where("direction IS NOT NULL").select("name", "direction", "net"),
        "nets": row.where("kind IS NOT NULL").select("name", "kind"),
        "instances": insts.select("name", "cell"),
        "pins": insts.select(F.col("name").alias("instance"), F.explode("pins").alias("pin", "net")),
    }


def read_document(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """ports, nets, instances and pins (instance, pin, net) of the parts that document()'s lines were written to. Every line is parsed where it is."""
    row = _objects(spark, path, LINE)
    named = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    insts = row.where("cell IS NOT NULL")
    return {
        "ports": row.where("direction IS NOT NULL").select("name", "direction", named("net")),
        "nets": row.where("kind IS NOT NULL").select("name", "kind", "labelled", "bbox"),
        "instances": insts.select("name", "cell", "x", "y", "angle", F.col("mirror_x").alias("mirror"), "abutment"),
        "pins": insts.select(F.col("name").alias("instance"), F.explode("connections").alias("pin", "net")).select("instance", "pin", named("net")),
    }
