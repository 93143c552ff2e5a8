"""Netlist assembly: names, kinds, ports and pins, from pin tables (inst_id, pin, net_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netframe.functions.text import instance_base_name, supply_kind
from netframe.operators.components import dealt, dealt_by_range, written


def pin_nets(hits: DataFrame, parts: int | None = None) -> DataFrame:
    """(inst_id, pin, net_id, n_nets): a pin's smallest net; several nets mark a split pin. parts: that hits are dealt in; by default, those of a shuffle."""
    return dealt(hits, "inst_id", "pin", parts=parts).groupBy("inst_id", "pin").agg(F.min("net_id").alias("net_id"), F.count_distinct("net_id").alias("n_nets"))


def instance_names(insts: DataFrame) -> DataFrame:
    """(inst_id, name): base name and a running number within it.

    All instances are numbered by (base, inst_id) in range partitions; a base's first number is taken off. So the instances of
    one cell, however many, are dealt to several tasks."""
    base = instance_base_name(F.col("cell"))
    all_numbers = numbered(insts.select("inst_id", base.alias("base")), ["base", "inst_id"], "k")
    first = all_numbers.groupBy("base").agg(F.min("k").alias("first"))  # a row for each cell of the library
    return all_numbers.join(F.broadcast(first), "base").select("inst_id", F.concat("base", F.lit("_"), (F.col("k") - F.col("first")).cast("string")).alias("name"))


def net_names(pins: DataFrame, prefix: str = "n") -> DataFrame:
    """(net_id, name): nets in the order of their first pin, numbered.

    The numbers run over all nets. They are counted in range partitions (a count for each partition goes to the driver), so
    no task sees more than its own."""
    first = pins.where("net_id is not null").groupBy("net_id").agg(F.min(F.struct("inst_id", "pin")).alias("first"))
    return numbered(first, ["first"], "k").select("net_id", F.concat(F.lit(prefix), F.col("k").cast("string")).alias("name"))


def numbered(df: DataFrame, order: list[str], name: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """df with its rows' numbers, from 0, in an order without ties. Sorted rows get their partition and their place in it as one number, which is written with them, so nothing is sorted or moved again."""
    ranged = written(dealt_by_range(df, *order).sortWithinPartitions(*order).drop(*drop).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    ranged = ranged.withColumn("_part", F.shiftright("_at", 33))
    sizes = ranged.groupBy("_part").count()
    starts = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_start"))  # a row for each partition
    within = F.col("_at") - F.shiftleft("_part", 33)
    return ranged.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + within).drop("_part", "_start", "_at")


def supply_roots(pins: DataFrame) -> DataFrame:
    """(net_id, kind): nets that a supply pin with exactly one net is on."""
    return pins.where("n_nets = 1").withColumn("kind", supply_kind(F.col("pin"))).where("kind <> 'signal'").select("net_id", "kind").distinct()


def inferred_body_pins(pins: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """(inst_id, pin, net_id) of the unbound body pins, on the rail of their instance. pairs: body pin to rail pin."""
    wanted = F.create_map(*(F.lit(x) for kv in pairs.items() for x in reversed(kv)))
    rails = pins.where(F.col("pin").isin(*pairs.values())).select("inst_id", wanted[F.col("pin")].alias("pin"), "net_id")
    return rails.join(pins, ["inst_id", "pin"], "left_anti")


def body_pins(pins: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """pins with the unbound body pins."""
    return pins.select("inst_id", "pin", "net_id").unionByName(inferred_body_pins(pins, pairs))


def net_kinds(nets: DataFrame, labels: DataFrame, roots: DataFrame) -> DataFrame:
    """(net_id, kind): a label's kind first, then what supply pins say."""
    by_label = labels.select("net_id", supply_kind(F.col("name")).alias("by_label"))
    by_root = roots.groupBy("net_id").agg(F.max("kind").alias("by_root"))  # power before ground
    joined = nets.select("net_id").distinct().join(by_label, "net_id", "left").join(by_root, "net_id", "left")
    return joined.select("net_id", F.when(F.col("by_label") != "signal", F.col("by_label")).otherwise(F.coalesce("by_root", F.lit("signal"))).alias("kind"))


def driven_nets(pins: DataFrame, directions: DataFrame) -> DataFrame:
    """Nets with an output pin. directions: (cell, pin, direction)."""
    return pins.join(F.broadcast(directions.where("direction = 'output'")), ["cell", "pin"], "left_semi").where("net_id is not null").select("net_id").distinct()


def ports(labels: DataFrame, kinds: DataFrame, driven: DataFrame) -> DataFrame:
    """(name, direction, net_id): a port for each named net."""
    joined = labels.join(kinds, "net_id", "left").join(driven.withColumn("driven", F.lit(True)), "net_id", "left")
    return joined.select("name", F.when(F.col("kind").isin("power", "ground"), "inout").when(F.col("driven"), "output").otherwise("input").alias("direction"), "net_id").orderBy("name", "net_id")


def all_nets(pins: DataFrame, labels: DataFrame) -> DataFrame:
    """Nets with a pin or a label; floating metal is neither."""
    return pins.where("net_id is not null").select("net_id").union(labels.select("net_id")).distinct()


def cell_histogram(insts: DataFrame) -> DataFrame:
    return insts.groupBy("cell").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cell")


def free_inputs(readers: DataFrame, drivers: DataFrame) -> DataFrame:
    """Nets that are read and not driven."""
    return readers.select("net_id").distinct().join(drivers.select("net_id").distinct(), "net_id", "left_anti")


def multiple_drivers(drivers: DataFrame) -> DataFrame:
    """(net_id, n, last): nets with several drivers; the last one counts."""
    return drivers.groupBy("net_id").agg(F.count("*").alias("n"), F.max("inst_id").alias("last")).where("n > 1")
