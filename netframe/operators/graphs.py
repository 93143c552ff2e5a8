"""Graph questions about netlists: levels, support, colour refinement and what comparison makes of it."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netframe.operators.components import SALTS, dealt, n_parts, parts_for, written
from netframe.operators.netlist import numbered


#: Parts of a union that are written as one, so that plans of long loops stay short.
MAX_PARTS = 50
#: Edges of a node from which on its colour is broadcast to them, where they are; and one of how many edges shows it.
HUB, SHOWN = 200_000, 100
#: Edges of a node from which on exact rounds broadcast its colour, and nodes that are broadcast so at most (about 100 MB).
BUSY, KNOWN = 200, 1_000_000


def rounds(limit: int | None, what: str):
    """0, 1, ... for as long as the loop needs; an error where it needs more than limit rounds."""
    for at in itertools.count():
        if limit is not None and at > limit:
            raise RuntimeError(f"{what} not settled after {limit} rounds")
        yield at


def levels(nodes: DataFrame, edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(node, level): one more than the highest level that feeds a node; null on a loop and behind one. edges: (a, b), a feeds b.

    A round places the nodes whose feeders are all placed; a join and a group for each level of the circuit."""
    edges = written(edges.select("a", "b").distinct(), "edges")
    waiting = edges.groupBy("b").agg(F.count("*").alias("open"))
    state = written(nodes.join(waiting, nodes.node == waiting.b, "left").select("node", F.coalesce("open", F.lit(0).cast("long")).alias("open")), "levels")
    done = []
    for at in rounds(max_rounds, "levels"):
        placed = state.where("open = 0")
        if placed.isEmpty():
            break
        done.append(placed.select("node", F.lit(at).alias("level")))
        if len(done) > MAX_PARTS:
            done = [written(union(done), "levels")]
        fed = edges.join(placed, edges.a == placed.node, "left_semi").groupBy(F.col("b").alias("node")).agg(F.count("*").alias("fed"))
        state = written(state.where("open > 0").join(fed, "node", "left").select("node", (F.col("open") - F.coalesce("fed", F.lit(0))).alias("open")), "levels")
    if not done:
        return nodes.select("node", F.lit(None).cast("int").alias("level"))
    return nodes.select("node").join(union(done), "node", "left")


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def support(edges: DataFrame, start: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Nodes that reach start (node) along edges (a, b), start included."""
    seen = frontier = written(start.select("node").distinct(), "support")
    for at in rounds(max_rounds, "support"):
        frontier = written(edges.join(frontier, edges.b == frontier.node, "left_semi").select(F.col("a").alias("node")).distinct().join(seen, "node", "left_anti"), "support")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if at % MAX_PARTS == MAX_PARTS - 1:
            seen = written(seen, "support")
    return seen


def ranked(keys: DataFrame) -> DataFrame:
    """keys (key) with dense numbers (colour) from 0 in their order. Only distinct keys are ranked."""
    return numbered(keys.select("key").distinct(), ["key"], "colour")


def seed_colours(nodes: DataFrame) -> DataFrame:
    """(side, node, colour) of nodes (side, node, kind, label): instances by cell, pinned nets by name, other nets alike. A colour is a 64-bit hash, so both sides have the same ones without being ranked together."""
    key = F.when(F.col("kind") == "inst", F.concat(F.lit("I:"), F.col("label"))).when(F.col("label").isNotNull(), F.concat(F.lit("P:"), F.col("label"))).otherwise("N")
    return nodes.select("side", "node", F.xxhash64(key).alias("colour"))


def _hubs(edges: DataFrame) -> DataFrame | None:
    """(side, other) of the nodes that very many edges lead to, as a sample shows them; None where there are none."""
    shown = edges.where(F.pmod(F.xxhash64("node", "pin"), F.lit(SHOWN)) == 0).groupBy("side", "other").agg(F.count("*").alias("n"))
    hubs = written(shown.where(F.col("n") > HUB / SHOWN).select("side", "other"), "hubs")
    return None if hubs.isEmpty() else F.broadcast(hubs)


def _seen(colours: DataFrame, edges: DataFrame, hubs: DataFrame | None, parts: int | None) -> DataFrame:
    """edges with c, the colour of other. Edges to a hub stay where they are, others are dealt in parts."""
    known = colours.select("side", F.col("node").alias("other"), F.col("colour").alias("c"))
    keys = ["side", "other"]
    plain = lambda e: dealt(e, *keys, parts=parts).join(dealt(known, *keys, parts=parts), keys)
    if hubs is None:
        return plain(edges)
    return plain(edges.join(hubs, keys, "left_anti")).unionByName(edges.join(F.broadcast(known.join(hubs, keys)), keys))


def _sums(mixed: DataFrame, hubs: DataFrame | None, parts: int | None) -> DataFrame:
    """(side, node, low, high): sums of the halves of h, which can't overflow below 2^31 neighbours.

    They are taken before the shuffle as well, so a net that a third of all pins are on is one row from each task. A group has as many partitions as a shuffle of the session;
    where more parts are wanted, nodes are dealt and only hubs' sums (edges go both ways, so a hub has as many as lead to it) are taken before."""
    keys = ["side", "node"]
    halves = F.sum(F.col("h").bitwiseAND(0xFFFFFFFF)).alias("low"), F.sum(F.shiftrightunsigned("h", 32)).alias("high")
    sums = lambda m: m.groupBy(*keys).agg(*halves)
    if parts is None or parts == n_parts(mixed.sparkSession):
        return sums(mixed)
    if hubs is None:
        return sums(dealt(mixed, *keys, parts=parts))
    own = hubs.withColumnRenamed("other", "node")
    return sums(dealt(mixed.join(own, keys, "left_anti"), *keys, parts=parts)).unionByName(sums(mixed.join(own, keys, "left_semi")))


def refine(colours: DataFrame, edges: DataFrame, parts: int | None = None) -> DataFrame:
    """One round: a node's new colour is the hash of its colour with the sums of the hashes of its neighbours' (pin, colour). edges: (side, node, pin, other), both ways.

    parts: that edges are dealt in, as parts_for() has it; by default, those of a shuffle."""
    keys, hubs = ["side", "node"], _hubs(edges)
    around = _sums(_seen(colours, edges, hubs, parts).select(*keys, F.xxhash64("pin", "c").alias("h")), hubs, parts)
    return dealt(colours, *keys, parts=parts).join(dealt(around, *keys, parts=parts), keys, "left").select(*keys, F.xxhash64("colour", "low", "high").alias("colour"))


def refine_until_stable(colours: DataFrame, edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Rounds until the number of colours stops growing: at most one for each node."""
    colours, n, parts = written(colours, "colours"), -1, parts_for(edges.sparkSession, edges.count())
    for _ in rounds(max_rounds, "colours"):
        now = colours.agg(F.count_distinct("colour")).first()[0]
        if now == n:
            break
        n, colours = now, written(refine(colours, edges, parts), "colours")
    return colours


def _mixed(features: DataFrame, bits: int) -> DataFrame:
    """(side, node, h): the last bits of a hash of all that a node has; nodes that have nothing have no row."""
    each = dealt(features.select("side", "node", F.xxhash64("f", "n").alias("h")), "side", "node")
    halves = F.sum(F.col("h").bitwiseAND(0xFFFFFFFF)).alias("low"), F.sum(F.shiftrightunsigned("h", 32)).alias("high")
    return each.groupBy("side", "node").agg(*halves).select("side", "node", F.shiftrightunsigned(F.xxhash64("low", "high"), 64 - bits).alias("h"))


def _uneven(classes: DataFrame, features: DataFrame) -> DataFrame:
    """(colour, f): of each class whose members don't all have the same, the first f that tells some apart. Rows are dealt by what is counted, and counted as they come: no class is gathered."""
    sizes = classes.groupBy("colour").agg(F.count("*").alias("size"))
    own = dealt(features, "side", "node").join(dealt(classes, "side", "node"), ["side", "node"])
    held = dealt(own.select("colour", "f", "n"), "colour", "f", "n").groupBy("colour", "f", "n").agg(F.count("*").alias("have"))
    return held.join(dealt(sizes, "colour"), "colour").where("have < size").groupBy("colour").agg(F.min("f").alias("f"))


def exact_classes(classes: DataFrame, features: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(side, node, colour): classes (side, node, colour) divided until all members of one have the same features (side, node, f, n), each n of f.

    f is of any type that has an order; a node has an f once. A class that came of a hash is right as it is, and one job shows it: each (f, n) is had by
    as many as the class has members. What a collision has joined is divided by one feature a round, for all such classes in the same jobs. Numbers
    are dense, in an order of no meaning; classes that were right are never joined. A node without features is in a class of such nodes."""
    features, classes = written(features.select("side", "node", "f", "n"), "features"), written(classes.select("side", "node", "colour"), "classes")
    for _ in rounds(max_rounds, "classes"):
        uneven = written(_uneven(classes, features), "uneven")
        if uneven.isEmpty():
            break
        mine = classes.join(uneven, "colour")
        told = mine.join(features, ["side", "node", "f"], "left").select("side", "node", "colour", F.coalesce("n", F.lit(0)).alias("n"))
        kept = classes.join(uneven, "colour", "left_anti").select("side", "node", "colour", F.lit(-1).cast("long").alias("n"))
        divided = written(told.unionByName(kept), "classes")
        numbers = numbered(divided.select("colour", "n").distinct(), ["colour", "n"], "number")
        classes = written(divided.join(numbers, ["colour", "n"]).select("side", "node", F.col("number").alias("colour")), "classes")
    numbers = numbered(classes.select("colour").distinct(), ["colour"], "number")
    return dealt(classes, "colour").join(dealt(numbers, "colour"), "colour").select("side", "node", F.col("number").alias("colour"))


def signature_classes(nodes: DataFrame, features: DataFrame, bits: int = 64) -> DataFrame:
    """(side, node, colour): nodes (side, node) numbered by all that they have, exactly: equal numbers if and only if equal features (side, node, f, n). No
    signature is put together as one value. bits: of the hash that proposes the classes."""
    proposed = dealt(nodes.select("side", "node"), "side", "node").join(_mixed(features, bits), ["side", "node"], "left").select("side", "node", F.coalesce("h", F.lit(0)).alias("colour"))
    return exact_classes(proposed, features)


def exact_seeds(nodes: DataFrame, bits: int = 64) -> DataFrame:
    """seed_colours() in exact classes: the hashes themselves where no two keys share one."""
    key = F.when(F.col("kind") == "inst", F.concat(F.lit("I:"), F.col("label"))).when(F.col("label").isNotNull(), F.concat(F.lit("P:"), F.col("label"))).otherwise("N")
    proposed = nodes.select("side", "node", key.alias("key"), _bits(F.xxhash64(key), bits).alias("colour"))
    if _shared(proposed, "colour", "key").isEmpty():
        return proposed.drop("key")
    return signature_classes(nodes, nodes.select("side", "node", key.alias("f"), F.lit(1).cast("long").alias("n")), bits)


def _bits(value: Column, bits: int) -> Column:
    """The first bits of a hash."""
    return F.shiftrightunsigned(value, 64 - bits)


def _shared(df: DataFrame, proposed: str, *own: str, parts: int | None = None) -> DataFrame:
    """(proposed): values that rows (side, node and more) with different values of own have. Rows are dealt by proposed; what very many have, as a sample shows it, is made distinct where it is."""
    shown = df.where(F.pmod(F.xxhash64("side", "node"), F.lit(SHOWN)) == 0).groupBy(proposed).agg(F.count(F.lit(1)).alias("n"))
    common, rows = written(shown.where(F.col("n") > HUB / SHOWN).select(proposed), "common"), df.select(proposed, *own)
    kinds = lambda rows: rows.distinct().groupBy(proposed).agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select(proposed)
    if common.isEmpty():
        return kinds(dealt(rows, proposed, parts=parts))
    few = rows.join(F.broadcast(common), proposed, "left_anti")
    return kinds(dealt(few, proposed, parts=parts)).unionByName(kinds(rows.join(F.broadcast(common), proposed, "left_semi")))


def _counted(seen: DataFrame, parts: int | None) -> DataFrame:
    """(side, node, f, n): how many neighbours of a colour a node has on a pin, of (side, node, pin, c)."""
    return dealt(seen.select("side", "node", F.struct("pin", "c").alias("f")), "side", "node", "f", parts=parts).groupBy("side", "node", "f").agg(F.count("*").alias("n"))


def neighbour_features(colours: DataFrame, edges: DataFrame, parts: int | None = None) -> DataFrame:
    """(side, node, f, n): how many neighbours of a colour a node has on a pin. edges: (side, node, pin, other), both ways."""
    return _counted(_seen(colours, edges, _hubs(edges), parts), parts)


def _often(edges: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """(side, other) of busy nodes, KNOWN at most, and of hubs, as a sample shows them; None where there are none."""
    shown = edges.where(F.pmod(F.xxhash64("node", "pin"), F.lit(SHOWN)) == 0).groupBy("side", "other").agg(F.count("*").alias("n"))
    least = min(BUSY, HUB) / SHOWN
    shown = written(shown.where(F.col("n") >= least), "hubs")
    while (n := shown.where(F.col("n") >= least).count()) > KNOWN:
        least *= 2
    hubs = shown.where(F.col("n") > HUB / SHOWN).select("side", "other")
    return F.broadcast(shown.where(F.col("n") >= least).select("side", "other")) if n else None, None if hubs.isEmpty() else F.broadcast(hubs)


def _halves(f: Column, n: Column) -> list[Column]:
    """What n of f add to the sums of a node's halves of hashes."""
    h = F.xxhash64(f)
    return [n * h.bitwiseAND(0xFFFFFFFF), n * F.shiftrightunsigned(h, 32)]


def exact_refine(colours: DataFrame, edges: DataFrame, bits: int = 64, parts: int | None = None) -> DataFrame:
    """One round as refine() does it, with exact classes: equal colours if and only if the colours were equal and so is what is around.

    A node's neighbours are put in order as one value, but for hubs, so this is at most some HUB of them. A hash of it and of the colour is the new colour, if no two values share
    one: all different ones are compared, once, and what very many nodes have is a row of each task. A hub is counted by rows, and so are the nodes that have its
    hash. What a collision has joined is divided as exact_classes() does it. parts: as in refine()."""
    keys, (busy, hubs) = ["side", "node"], _often(edges)
    seen, held = _seen(colours, edges, busy, parts), None
    own = dealt(colours.select(*keys, "colour"), *keys, parts=parts)
    if hubs is not None:
        hubs = hubs.withColumnRenamed("other", "node")
        seen, held = seen.join(hubs, keys, "left_anti"), written(_counted(seen.join(hubs, keys, "left_semi"), parts), "around")
    # numbers without structs between them, half as many bytes where they are moved
    lists = dealt(seen.select(*keys, "pin", "c"), *keys, parts=parts).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pin", "c"))).alias("around"))
    lists = lists.select(*keys, F.transform("around", lambda f: f["pin"]).alias("pins"), F.transform("around", lambda f: f["c"]).alias("around"))
    own = own.join(lists, keys, "left")
    if held is None:
        own = own.withColumn("h", F.xxhash64("colour", "pins", "around"))
    else:  # sums, which are the same however a node was counted
        zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
        sums = held.groupBy(*keys).agg(*(F.sum(c).alias(f"s{k}") for k, c in enumerate(_halves(F.col("f"), F.col("n")))))
        of = lambda k: F.coalesce(F.aggregate(F.arrays_zip(F.col("pins").alias("pin"), F.col("around").alias("c")), zero, lambda done, f: done + _halves(f, one)[k]), F.col(f"s{k}"))
        own = own.join(F.broadcast(sums), keys, "left").withColumn("h", F.xxhash64("colour", of(0), of(1))).withColumn("hub", F.col("s0").isNotNull()).drop("s0", "s1")
    own = written(own.withColumn("h", _bits(F.col("h"), bits)), "classes")
    each = lambda df: df.select(*keys, F.explode(F.arrays_zip(F.col("pins").alias("pin"), F.col("around").alias("c"))).alias("f")).groupBy(*keys, "f").agg(F.count("*").alias("n"))
    if held is None:
        right = _shared(own, "h", "colour", "pins", "around", parts=parts).isEmpty()
    else:
        mixed = written(own.where("hub").select("h").distinct(), "mixed")
        beside = own.join(F.broadcast(mixed), "h", "left_semi")
        right = _shared(own.join(F.broadcast(mixed), "h", "left_anti"), "h", "colour", "pins", "around", parts=parts).isEmpty() and _shared(beside, "h", "colour", parts=parts).isEmpty()
        right = right and _uneven(beside.select(*keys, F.col("h").alias("colour")), each(beside).unionByName(held)).isEmpty()
    if right:
        return own.select(*keys, F.col("h").alias("colour"))
    pairs = numbered(dealt(own.select("colour", "h"), "colour", "h").distinct(), ["colour", "h"], "number")
    around = each(own) if held is None else each(own).unionByName(held)
    return exact_classes(dealt(own, "colour", "h").join(dealt(pairs, "colour", "h"), ["colour", "h"]).select(*keys, F.col("number").alias("colour")), around)


def _classes(colours: DataFrame, parts: int | None) -> DataFrame:
    """(colour, n_left, n_right, left, right): how many nodes of each side have a colour, and the smallest of them.

    Both sides are counted at once, by a part of the nodes first: a colour that very many have is SALTS tasks', and very many colours are dealt to all."""
    part = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("part")
    own = [F.count_if(F.col("side") == s).alias(f"n_{s}") for s in ("left", "right")] + [F.min(F.when(F.col("side") == s, F.col("node"))).alias(s) for s in ("left", "right")]
    each = dealt(colours.select("colour", part, "side", "node"), "colour", "part", parts=parts).groupBy("colour", "part").agg(*own).drop("part")
    return dealt(each, "colour", parts=parts).groupBy("colour").agg(*(F.sum(c).alias(c) for c in ("n_left", "n_right")), *(F.min(c).alias(c) for c in ("left", "right")))


def class_sizes(colours: DataFrame, parts: int | None = None) -> DataFrame:
    """(colour, n_left, n_right) of the colours whose classes differ in size between the sides."""
    return _classes(colours, parts).where("n_left <> n_right").select("colour", "n_left", "n_right")


def mapping(colours: DataFrame, parts: int | None = None) -> DataFrame:
    """(left, right): nodes that are alone in their colour on both sides."""
    return _classes(colours, parts).where("n_left = 1 AND n_right = 1").select("left", "right")


def histogram_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """(cell, n): how many more instances of a cell the left has."""
    signed = left.select("cell", F.lit(1).alias("d")).unionByName(right.select("cell", F.lit(-1).alias("d")))
    return signed.groupBy("cell").agg(F.sum("d").alias("n")).where("n <> 0")
