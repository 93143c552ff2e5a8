"""Are two netlists the same circuit? Colour refinement over both together, then pairing of what is left tied.

Ties are first paired many at a time. Tied classes that no edge joins, directly or through other tied classes, don't concern each other; in
each such group of classes the nodes of the smallest are paired in their order, all groups in the same jobs, and colours are refined again. Where
nodes are tied because they are alike, this ends with a mapping. If it leads to classes of different sizes, or to a mapping that
doesn't keep every pin, all of it is taken back and a search begins that misses no pairing: one node of a tied class is tried with all
candidates of the other side, TRIALS of them in the same jobs, and what agrees is followed further, the first candidate first.

A netlist is (insts: inst_id, name, cell; pins: inst_id, pin, net; kinds: net, kind). Input pins aren't interchangeable."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from netframe.functions.cells import is_physical
from netframe.operators import graphs
from netframe.operators.components import connected_components, written
from netframe.operators.netlist import numbered

#: Candidates of a tied node that are refined in the same jobs.
TRIALS = 8


@dataclass
class Side:
    insts: DataFrame
    pins: DataFrame
    kinds: DataFrame | None = None


@dataclass
class Comparison:
    """equal; differences (message); mapping (kind, left, right) by name, of all nodes where equal."""

    equal: bool
    differences: DataFrame
    mapping: DataFrame


def _kept(side: Side, ignore_physical: bool, ignore_power: bool) -> Side:
    insts, pins = side.insts, side.pins.where("net is not null")
    if ignore_physical:
        insts = insts.where(~is_physical(F.col("cell")))
    if ignore_power and side.kinds is not None:
        pins = pins.join(side.kinds.where("kind <> 'signal'"), "net", "left_anti")
    return Side(insts, pins.join(insts, "inst_id", "left_semi"), side.kinds)


def _keyed(name: str, side: Side) -> tuple[DataFrame, DataFrame]:
    """Nodes (side, key, kind, label) and edges (side, key, pin, other), by name."""
    named = side.pins.join(side.insts.select("inst_id", F.concat(F.lit("i:"), "name").alias("i")), "inst_id").select("i", "pin", F.concat(F.lit("n:"), "net").alias("n"))
    nodes = side.insts.select(F.lit(name).alias("side"), F.concat(F.lit("i:"), "name").alias("key"), F.lit("inst").alias("kind"), F.col("cell").alias("label"))
    nets = named.select("n").distinct().select(F.lit(name).alias("side"), F.col("n").alias("key"), F.lit("net").alias("kind"), F.lit(None).cast("string").alias("label"))
    return nodes.unionByName(nets), named.select(F.lit(name).alias("side"), F.col("i").alias("key"), "pin", F.col("n").alias("other"))


def compare(left: Side, right: Side, ignore_physical: bool = True, ignore_power: bool = True, pin_equal_names: bool = True, max_ties: int | None = None) -> Comparison:
    """Counts and cells first; where they agree, colours, and then pairings of what is tied. Equal is only what a mapping of all nodes proves, by keeping every pin. Pairings are the nodes paired in order and the candidates tried; more than max_ties of them are an error."""
    sides = {n: _kept(s, ignore_physical, ignore_power) for n, s in (("left", left), ("right", right))}
    parts = {n: _keyed(n, s) for n, s in sides.items()}
    nodes = parts["left"][0].unionByName(parts["right"][0])
    if pin_equal_names:
        both = parts["left"][0].where("kind = 'net'").select("key").intersect(parts["right"][0].where("kind = 'net'").select("key")).withColumn("pinned", F.lit(True))
        nodes = nodes.join(both, "key", "left").select("side", "key", "kind", F.when((F.col("kind") == "net") & F.col("pinned"), F.col("key")).otherwise(F.col("label")).alias("label"))
    nodes = written(nodes, "nodes")
    cells = graphs.histogram_difference(sides["left"].insts, sides["right"].insts).select(F.format_string("cell %s: %d more on the left", "cell", "n").alias("message"))
    sizes = nodes.groupBy("kind").agg(F.count_if(F.col("side") == "left").alias("l"), F.count_if(F.col("side") == "right").alias("r")).where("l <> r").select(F.format_string("%s nodes: %d and %d", "kind", "l", "r").alias("message"))
    found = written(sizes.unionByName(cells), "differences")
    none = nodes.sparkSession.createDataFrame([], "kind string, left string, right string")
    if not found.isEmpty():
        return Comparison(False, found, none)

    pin_rank = graphs.ranked(parts["left"][1].select(F.col("pin").alias("key")).union(parts["right"][1].select("pin"))).withColumnRenamed("key", "pin").withColumnRenamed("colour", "p")
    edges = parts["left"][1].unionByName(parts["right"][1]).join(pin_rank, "pin").select("side", F.col("key").alias("node"), F.col("p").alias("pin"), "other")
    edges = written(edges.unionByName(edges.select("side", F.col("other").alias("node"), "pin", F.col("node").alias("other"))), "edges")
    colours = graphs.refine_until_stable(graphs.seed_colours(nodes.select("side", F.col("key").alias("node"), "kind", "label")), edges)
    odd = graphs.class_sizes(colours)
    if not odd.isEmpty():
        return Comparison(False, odd.select(F.format_string("a class of %d and %d nodes", "n_left", "n_right").alias("message")), none)
    paired = Pairings(max_ties)
    colours = _paired_in_order(colours, edges, paired) or _searched(colours, edges, paired)
    if colours is None:
        return Comparison(False, nodes.sparkSession.createDataFrame([("colours agree, but no pairing of the tied nodes keeps all pins",)], "message string"), none)
    pairs = graphs.mapping(colours).select(F.when(F.col("left").startswith("i:"), "inst").otherwise("net").alias("kind"), F.expr("substring(left, 3)").alias("left"), F.expr("substring(right, 3)").alias("right"))
    return Comparison(True, found, written(pairs, "mapping"))


class Pairings:
    def __init__(self, most: int | None):
        self.most, self.n = most, 0

    def add(self, n: int) -> None:
        self.n += n
        if self.most is not None and self.n > self.most:
            raise RuntimeError(f"ties not settled after {self.most} pairings")


def _tied(colours: DataFrame) -> DataFrame:
    """(colour, n, l): classes of more than one node a side, with the left side's first node."""
    return colours.groupBy("colour").agg(F.count("*").alias("n"), F.min(F.when(F.col("side") == "left", F.col("node"))).alias("l")).where("n > 2")


def _apart(tied: DataFrame, colours: DataFrame, edges: DataFrame) -> DataFrame:
    """(colour): the smallest class of each group of tied classes that edges join."""
    own = colours.join(tied.select("colour"), "colour").where("side = 'left'").select("side", "node", "colour")
    ends = edges.join(own, ["side", "node"]).select("side", F.col("other").alias("node"), F.col("colour").alias("a")).join(own, ["side", "node"]).select("a", F.col("colour").alias("b")).distinct()
    groups = connected_components(ends)
    each = tied.join(groups, tied.colour == groups.node, "left").select("colour", "n", F.coalesce("component", "colour").alias("group"))
    return each.groupBy("group").agg(F.min_by("colour", F.struct("n", "colour")).alias("colour")).select("colour")


def _paired_in_order(colours: DataFrame, edges: DataFrame, paired: Pairings) -> DataFrame | None:
    """Colours of a mapping that keeps every pin, or None where pairing in order doesn't lead to one."""
    while True:
        tied = written(_tied(colours), "tied")
        if tied.isEmpty():
            return colours if _same_edges(colours, edges) else None
        chosen = written(_apart(tied, colours, edges), "tied")
        paired.add(int(tied.join(chosen, "colour", "left_semi").agg(F.sum("n")).first()[0]) // 2)
        ranked = numbered(colours.join(chosen, "colour", "left_semi").select("side", "colour", "node"), ["side", "colour", "node"], "k")
        first = ranked.groupBy("side", "colour").agg(F.min("k").alias("first"))  # a row for each chosen class and side
        told = ranked.join(first, ["side", "colour"]).select("side", "node", (F.col("k") - F.col("first")).alias("rank"))
        set_apart = colours.join(told, ["side", "node"], "left").select("side", "node", F.when(F.col("rank").isNotNull(), F.xxhash64("colour", "rank")).otherwise(F.col("colour")).alias("colour"))
        colours = graphs.refine_until_stable(set_apart, edges)
        if not graphs.class_sizes(colours).isEmpty():
            return None


def _trials(colours: DataFrame, edges: DataFrame, tied: Row, paired: Pairings) -> Iterator[DataFrame]:
    """Refined colours for each candidate of a tied class's left node whose classes agree, in the candidates' order."""
    candidates = colours.where((F.col("side") == "right") & (F.col("colour") == tied.colour)).select("node").orderBy("node").toLocalIterator()
    while batch := list(itertools.islice(candidates, TRIALS)):
        paired.add(len(batch))
        each = F.explode(F.array(*(F.struct(F.lit(k).alias("trial"), F.lit(r.node).alias("candidate")) for k, r in enumerate(batch))))
        mine = colours.select("side", "node", "colour", each.alias("t")).select("side", "node", "colour", "t.*")
        apart = ((F.col("side") == "left") & (F.col("node") == tied.l)) | ((F.col("side") == "right") & (F.col("node") == F.col("candidate")))
        of_trial = F.concat_ws("#", "side", "trial").alias("side")
        # the trial is in the colour, so trials don't mix and the number of colours is that of all of them
        seeds = mine.select(of_trial, "node", F.xxhash64("trial", F.when(apart, F.lit(-1).cast("long")).otherwise(F.col("colour"))).alias("colour"))
        own_edges = written(edges.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(len(batch) - 1)))).select(of_trial, "node", "pin", "other"), "edges")
        done = graphs.refine_until_stable(seeds, own_edges)
        sizes = done.groupBy("colour").agg(F.sum(F.when(F.col("side").startswith("left"), 1).otherwise(-1)).alias("more"), F.min(F.substring_index("side", "#", -1)).alias("trial"))
        wrong = {r.trial for r in sizes.where("more <> 0").select("trial").distinct().collect()}  # TRIALS rows at most
        for k in range(len(batch)):
            if str(k) not in wrong:
                yield done.where(F.col("side").endswith(f"#{k}")).select(F.substring_index("side", "#", 1).alias("side"), "node", "colour")


def _searched(colours: DataFrame, edges: DataFrame, paired: Pairings) -> DataFrame | None:
    """Colours of a mapping that keeps every pin, or None if there is none: every tied class's first node with every candidate, and what follows from it."""
    open_trials: list[Iterator[DataFrame]] = []
    while True:
        tied = _tied(colours).orderBy("n", "colour").first()
        if tied is not None:
            open_trials.append(_trials(colours, edges, tied, paired))
        elif _same_edges(colours, edges):
            return colours
        while open_trials and (found := next(open_trials[-1], None)) is None:
            open_trials.pop()
        if not open_trials:
            return None
        colours = found


def _same_edges(colours: DataFrame, edges: DataFrame) -> bool:
    """Whether the mapping of equal colours takes the left's edges to the right's, each as often: the proof that they are the same."""
    of = colours.select("side", "node", "colour")
    ends = edges.join(of, ["side", "node"]).select("side", F.col("colour").alias("a"), "pin", F.col("other").alias("node")).join(of, ["side", "node"]).select("side", "a", "pin", F.col("colour").alias("b"))
    return ends.groupBy("a", "pin", "b").agg(F.sum(F.when(F.col("side") == "left", 1).otherwise(-1)).alias("more")).where("more <> 0").isEmpty()


def renamed(insts: DataFrame, pins: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The left netlist's tables under the right one's names; what the mapping lacks keeps its own."""
    of = lambda kind: mapping.where(F.col("kind") == kind).select(F.col("left").alias("_l"), F.col("right").alias("_r"))
    i, n = of("inst"), of("net")
    return (
        insts.join(i, insts.name == i._l, "left").select("inst_id", F.coalesce("_r", "name").alias("name"), "cell"),
        pins.join(n, pins.net == n._l, "left").select("inst_id", "pin", F.coalesce("_r", "net").alias("net")),
    )
