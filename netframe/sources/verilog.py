"""Structural Verilog: read into tables with text functions, and written from them.

A file is one row of text; statements are what semicolons separate, and every statement is parsed where it is, so files and
statements are spread over the cluster. Only the first module of a file is read; ranges in declarations are skipped.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netframe.functions.text import SUPPLY_GROUND, SUPPLY_POWER, escape_identifier, supply_kind
from netframe.operators.components import dealt
from netframe.sources import documents

TRIVIA = r"(?s)//[^\n]*|/\*.*?\*/|\(\*(?!\)).*?\*\)"
TOKEN = r"\\\S+|[A-Za-z_$][A-Za-z0-9_$]*|[0-9]+'[bodhBODH][0-9a-fA-FxXzZ_]+|[0-9]+|<=|\S"
_NAME = r"(?:\\\S+|[A-Za-z_$][A-Za-z0-9_$.]*)"


def _lit(pattern: str) -> Column:
    return F.lit(pattern)


def without_trivia(text: Column) -> Column:
    """Comments and attributes become a space."""
    return F.regexp_replace(text, TRIVIA, " ")


def tokens(text: Column) -> Column:
    """Escaped and plain identifiers, sized and plain numbers, and punctuation, in order."""
    return F.regexp_extract_all(without_trivia(text), _lit(TOKEN), F.lit(0))


def _unescaped(name: Column) -> Column:
    return F.regexp_replace(F.trim(name), r"^\\", "")


def statements(files: DataFrame) -> DataFrame:
    """(path, seq, text) of the first module's statements in files (path, value), the header first."""
    body = F.regexp_extract(without_trivia(F.col("value")), r"(?s)\bmodule\b(.*?)\bendmodule\b", 1)
    return files.select("path", F.posexplode(F.split(body, ";")).alias("seq", "text")).select("path", "seq", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text")).where("text <> ''")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


class StructuralVerilog:
    """Tables of the netlists in files (path, value)."""

    def __init__(self, files: DataFrame):
        self.statements = statements(files)

    def modules(self) -> DataFrame:
        """(path, module)."""
        return self.statements.where("seq = 0").select("path", _unescaped(F.regexp_extract("text", rf"^({_NAME})", 1)).alias("module"))

    def declarations(self) -> DataFrame:
        """(path, seq, kind, name): inputs, outputs, inouts and wires, in the body or in the header."""
        body = self.statements.select("path", "seq", F.regexp_extract("text", r"^(input|output|inout|wire|supply0|supply1)\b", 1).alias("kind"), F.regexp_replace("text", r"^\w+\s*(?:wire\s+|reg\s+)?(?:\[[^\]]*\])?", "").alias("names")).where("kind <> ''")
        head = self.statements.where("seq = 0").select("path", "seq", F.explode(F.regexp_extract_all("text", _lit(rf"\b(?:input|output|inout)\b[^,)]*"), F.lit(0))).alias("part"))
        head = head.select("path", "seq", F.regexp_extract("part", r"^(\w+)", 1).alias("kind"), F.regexp_replace("part", r"^\w+\s*(?:wire\s+|reg\s+)?(?:\[[^\]]*\])?", "").alias("names"))
        return body.unionByName(head).select("path", "seq", "kind", F.explode(F.split("names", ",")).alias("name")).select("path", "seq", "kind", _unescaped(F.col("name")).alias("name"))

    def ports(self) -> DataFrame:
        """(path, name, direction, net)."""
        own = self.declarations().where(F.col("kind").isin("input", "output", "inout"))
        return own.select("path", "name", F.col("kind").alias("direction"), F.col("name").alias("net")).distinct()

    def instances(self) -> DataFrame:
        """(path, inst_id, name, cell, pins): instances with named connections; `assign a = b` is an instance of $alias with A and X. Connections by position raise an error."""
        s = self.statements.where("seq > 0")
        found = s.select("path", "seq", "text", F.regexp_extract("text", rf"^({_NAME}) ({_NAME}) ?\(.*\)$", 1).alias("cell"), F.regexp_extract("text", rf"^({_NAME}) ({_NAME}) ?\((.*)\)$", 2).alias("name"), F.trim(F.regexp_extract("text", rf"^({_NAME}) ({_NAME}) ?\((.*)\)$", 3)).alias("held")).where("cell <> ''")
        named = F.when((F.col("held") != "") & ~F.col("held").startswith("."), F.raise_error(F.concat(F.lit("connections by position: "), F.col("name")))).otherwise(F.regexp_extract_all("held", _lit(r"\.\s*((?:\\\S+ |[A-Za-z_$][\w$]*))\s*\(([^()]*)\)"), F.lit(0)))
        gates = found.select("path", "seq", _unescaped(F.col("name")).alias("name"), _unescaped(F.col("cell")).alias("cell"), named.alias("pins"))
        alias = s.where(F.col("text").startswith("assign ")).select("path", "seq", F.concat(F.lit("$alias_"), F.col("seq").cast("string")).alias("name"), F.lit("$alias").alias("cell"), F.array(F.concat(F.lit(".A("), F.regexp_extract("text", r"=\s*(.*)$", 1), F.lit(")")), F.concat(F.lit(".X("), F.regexp_extract("text", r"^assign\s+(.*?)\s*=", 1), F.lit(")"))).alias("pins"))
        number = F.row_number().over(Window.partitionBy("path").orderBy("seq")) - 1
        return dealt(gates.unionByName(alias), "path").select("path", number.cast("long").alias("inst_id"), "name", "cell", "pins")

    def pins(self) -> DataFrame:
        """(path, inst_id, pin, net): null for unconnected pins; what is more than one name becomes the net $first."""
        each = self.instances().select("path", "inst_id", F.explode("pins").alias("p"))
        net = F.trim(F.regexp_extract("p", r"\(([^()]*)\)$", 1))
        own = F.regexp_extract_all(net, _lit(TOKEN), F.lit(0))
        return each.select("path", "inst_id", _unescaped(F.regexp_extract("p", r"^\.\s*(\\\S+|[\w$]+)", 1)).alias("pin"), F.when(net == "", None).when(F.size(own) == 1, _unescaped(net)).otherwise(F.concat(F.lit("$"), _unescaped(F.get(own, F.lit(0))))).alias("net"))

    def nets(self) -> DataFrame:
        """(path, name, kind): declared or connected nets; supplies by name."""
        named = self.declarations().select("path", "name").union(self.pins().where("net is not null").select("path", "net")).distinct()
        return named.select("path", "name", supply_kind(F.col("name")).alias("kind"))


def read_structural_verilog(spark: SparkSession, path: str) -> StructuralVerilog:
    return StructuralVerilog(read_text(spark, path))


def _kept(insts: DataFrame, pins: DataFrame, ports: DataFrame, power: bool, physical: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    if not power:
        supplies = SUPPLY_POWER + SUPPLY_GROUND
        pins, ports = pins.where(~F.col("pin").isin(*supplies)), ports.where(~F.col("name").isin(*supplies))
    if physical is not None:
        insts = insts.join(physical.select("cell").distinct(), "cell", "left_anti")
    return insts, pins, ports


def to_verilog(insts: DataFrame, pins: DataFrame, ports: DataFrame, module: str, power: bool = False, physical: DataFrame | None = None, header: str | None = None) -> DataFrame:
    """(part, key, text): a module's lines, to be written in that order. insts: (inst_id, name, cell); pins: (inst_id, pin, net); ports: (name, direction). Supply pins go unless power; instances of the cells in physical go."""
    insts, pins, ports = _kept(insts, pins, ports, power, physical)
    name, spark = escape_identifier(F.lit(module)), insts.sparkSession
    head = ports.agg(F.array_join(F.array_sort(F.collect_list(escape_identifier(F.col("name")))), ", ").alias("p")).select(F.lit(0).alias("part"), F.lit("").alias("key"), F.concat(F.lit(f"// {header}\n" if header else ""), F.lit("module "), name, F.lit(" ("), F.coalesce("p", F.lit("")), F.lit(");")).alias("text"))
    end = spark.range(1).select(F.lit(4).alias("part"), F.lit("").alias("key"), F.lit("endmodule").alias("text"))
    return head.unionByName(_body(insts, pins, ports)).unionByName(end)


def _body(insts: DataFrame, pins: DataFrame, ports: DataFrame) -> DataFrame:
    """(part, key, text): lines of declared ports (1), wires (2) and instances (3)."""
    declared = ports.select(F.lit(1).alias("part"), F.col("name").alias("key"), F.concat(F.lit("  "), F.col("direction"), F.lit(" "), escape_identifier(F.col("name")), F.lit(";")).alias("text"))
    wires = pins.where("net is not null").select(F.col("net").alias("name")).distinct().join(ports, "name", "left_anti").select(F.lit(2).alias("part"), F.col("name").alias("key"), F.concat(F.lit("  wire "), escape_identifier(F.col("name")), F.lit(";")).alias("text"))
    held = pins.groupBy("inst_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pin", "net"))), lambda p: F.concat(F.lit("."), escape_identifier(p["pin"]), F.lit("("), F.coalesce(escape_identifier(p["net"]), F.lit("")), F.lit(")"))), ", ").alias("held"))
    gates = insts.join(held, "inst_id", "left").select(F.lit(3).alias("part"), F.lpad(F.col("inst_id").cast("string"), 20, "0").alias("key"), F.concat(F.lit("  "), escape_identifier(F.col("cell")), F.lit(" "), escape_identifier(F.col("name")), F.lit(" ("), F.coalesce("held", F.lit("")), F.lit(");")).alias("text"))
    return declared.unionByName(wires).unionByName(gates)


def write_verilog(insts: DataFrame, pins: DataFrame, ports: DataFrame, module: str, path: str, power: bool = False, physical: DataFrame | None = None, header: str | None = None, overwrite: bool = False) -> None:
    """to_verilog's text as the document at path. No list of it, the ports in the module's head included, is gathered anywhere."""
    insts, pins, ports = _kept(insts, pins, ports, power, physical)
    name = f"\\{module} " if re.fullmatch("[A-Za-z_$][A-Za-z0-9_$]*", module) is None else module
    head = documents.Section(f"// {header}\nmodule {name} (" if header else f"module {name} (", ", ", ");\n")
    own = escape_identifier(F.col("name"))
    listed = ports.select(F.lit(0).alias("section"), own.alias("key"), own.alias("text"))
    body = _body(insts, pins, ports).select(F.col("part").alias("section"), "key", F.concat("text", F.lit("\n")).alias("text"))
    plain = documents.Section()
    documents.write_document(listed.unionByName(body), [head, plain, plain, documents.Section(closing="endmodule\n")], path, overwrite)


def read_written(spark: SparkSession, path: str) -> StructuralVerilog:
    """Tables of the document at path that write_verilog() made, each statement parsed where it is; a path for each part of it."""
    documents.whole(path)
    read = StructuralVerilog.__new__(StructuralVerilog)
    line, head = F.col("line"), F.col("line").startswith("module ")
    own = read_text(spark, path).select("path", F.posexplode(F.split("value", "\n")).alias("seq", "line")).where(head | (line.startswith("  ") & line.endswith(";")))
    text = F.regexp_replace(F.regexp_replace("line", "^module |;$", ""), r"\s+", " ")
    read.statements = own.select("path", F.when(head, 0).otherwise(F.col("seq") + 1).alias("seq"), F.trim(text).alias("text"))
    return read
