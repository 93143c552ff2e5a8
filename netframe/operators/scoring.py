"""Scores of an extraction against a routed database."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netframe.operators import graphs
from netframe.operators.components import written
from netframe.operators.extract import Netlist
from netframe.sources.defdb import RoutedDatabase


def placements_found(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(n, n_found): expected rows (cell, x, y) that found has too; a found row may serve several."""
    keys = ["cell", "x", "y"]
    hit = expected.join(found.select(*keys).distinct().withColumn("hit", F.lit(1)), keys, "left")
    return hit.agg(F.count("*").alias("n"), F.count("hit").alias("n_found"))


def placements_missing(expected: DataFrame, found: DataFrame, n: int = 10) -> DataFrame:
    """The first n expected placements that weren't found."""
    return expected.join(found, ["cell", "x", "y"], "left_anti").orderBy("cell", "x", "y").limit(n)


def _pin_kinds(pins: DataFrame) -> DataFrame:
    """(net_id, kinds): the sorted (cell.pin, how often) of a net. Equal ones are counted first, partly before the shuffle: a net gathers a row for each kind of pin, not for each pin."""
    named = pins.where("net_id is not null").select("net_id", F.concat_ws(".", "cell", F.col("pin").cast("string")).alias("p"))
    kinds = named.groupBy("net_id", "p").agg(F.count("*").cast("int").alias("n"))
    return kinds.groupBy("net_id").agg(F.array_sort(F.collect_list(F.struct("p", "n"))).alias("kinds"))


def net_signatures(pins: DataFrame) -> DataFrame:
    """(net_id, signature): the sorted cell.pin of a net, each as often as it is there, joined by bars: text to show. pins: (net_id, cell, pin)."""
    return _pin_kinds(pins).select("net_id", F.array_join(F.flatten(F.transform("kinds", lambda x: F.array_repeat(x["p"], x["n"]))), "|").alias("signature"))


def counted_signatures(pins: DataFrame) -> DataFrame:
    """(net_id, signature): each cell.pin of a net once, with how often it is there. Equal where net_signatures are, and as long as a net has kinds of pins."""
    return _pin_kinds(pins).select("net_id", F.to_json("kinds").alias("signature"))


def nets_matched(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(n_matched): signatures in both, each as often as both have it."""
    return expected.select("signature").intersectAll(found.select("signature")).agg(F.count("*").alias("n_matched"))


def nets_matched_exactly(expected: DataFrame, found: DataFrame, bits: int = 64) -> DataFrame:
    """(n_matched): as nets_matched, from pins (net_id, cell, pin) of both. Nets are numbered by their kinds of pins; a net with very many of them is never one value."""
    named = lambda side, pins: pins.where("net_id is not null").select(F.lit(side).alias("side"), F.col("net_id").cast("string").alias("node"), F.concat_ws(".", "cell", F.col("pin").cast("string")).alias("f"))
    kinds = named("expected", expected).unionByName(named("found", found)).groupBy("side", "node", "f").agg(F.count("*").alias("n"))
    kinds = written(kinds, "kinds")
    classes = graphs.signature_classes(kinds.select("side", "node").distinct(), kinds, bits)
    sizes = classes.groupBy("colour").agg(F.count_if(F.col("side") == "expected").alias("a"), F.count_if(F.col("side") == "found").alias("b"))
    return sizes.agg(F.coalesce(F.sum(F.least("a", "b")), F.lit(0)).alias("n_matched"))


def nets_unmatched(expected: DataFrame, found: DataFrame, n: int = 5) -> DataFrame:
    return expected.join(found, "signature", "left_anti").orderBy("signature", "net_id").limit(n)


def database_pins(database: RoutedDatabase) -> DataFrame:
    """(net_id, cell, pin) of a database's signal nets; the design's own pins have no cell, pins of instances that it lacks the cell ?."""
    own = database.net_pins().where("not special").select("net", "instance", "pin").distinct()
    cells = database.components().select(F.col("name").alias("instance"), "cell")
    cell = F.when(F.col("instance").isNotNull(), F.coalesce("cell", F.lit("?")))
    return own.join(cells, "instance", "left").select(F.col("net").alias("net_id"), cell.alias("cell"), F.when(F.col("instance").isNull(), F.concat(F.lit("PIN:"), "pin")).otherwise(F.col("pin")).alias("pin"))


def extracted_pins(netlist: Netlist) -> DataFrame:
    """(net_id, cell, pin) of an extraction's signal nets, ports as pins without a cell."""
    pins = netlist.pins.join(netlist.instances.select("inst_id", "cell"), "inst_id").select("net_id", "cell", "pin")
    ports = netlist.ports.select("net_id", F.lit(None).cast("string").alias("cell"), F.concat(F.lit("PIN:"), "name").alias("pin"))
    return pins.unionByName(ports).join(netlist.nets.where("kind = 'signal'"), "net_id", "left_semi")


def database_check(netlist: Netlist, database: RoutedDatabase) -> DataFrame:
    """One row (n_components, n_placed, n_nets, n_matched): components whose cell's abutment box has its lower left corner where the
    database places it, and signal nets whose pins, by cell, an extracted net has too. Extract with keep_physical to find fillers."""
    placed = placements_found(database.components().select("cell", "x", "y"), netlist.instances.select("cell", F.col("xlo").alias("x"), F.col("ylo").alias("y")))
    expected, found = database_pins(database), extracted_pins(netlist)
    counts = placed.select(F.col("n").alias("n_components"), F.col("n_found").alias("n_placed"), F.lit(0).cast("long").alias("n_nets"), F.lit(0).cast("long").alias("n_matched"))
    zero = F.lit(0).cast("long")
    nets = expected.agg(F.count_distinct("net_id").alias("n")).select(zero, zero, "n", zero)
    matched = nets_matched_exactly(expected, found).select(zero, zero, zero, "n_matched")
    return counts.union(nets).union(matched).agg(*(F.sum(c).alias(c) for c in counts.columns))
