"""From a layout to a netlist: flatten, cut, connect, bind and name, as one chain of DataFrame jobs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netframe.functions import cells as library
from netframe.functions.geometry import bounding_box, place, ring_box
from netframe.functions.text import SUPPLY_GROUND, SUPPLY_POWER
from netframe.operators import hierarchy, netlist
from netframe.operators.classify import CONDUCTORS, abutment_boxes, conductor_shapes, layer_stack, placed_boxes
from netframe.operators.components import dealt, parts_for, written
from netframe.operators.decompose import decompose, path_rects
from netframe.operators.graphs import union
from netframe.operators.nets import net_boxes, wired_labels
from netframe.sources.gds import Layout, LayoutTables

BODY_TIES = {"VPB": "VPWR", "VNB": "VGND"}
PLACE = ("ox", "oy", "angle", "mirror", "mag")


@dataclass
class Netlist:
    """The extracted tables.

    instances (inst_id, name, cell, x, y, angle, mirror, and the box that a placer puts down as xlo, ylo, xhi, yhi); pins (inst_id, pin, net_id);
    nets (net_id, name, named_in_layout, kind, edges of the box); ports (name, direction, net_id); rects (rect_id, level, edges, net);
    stats, one row of counts; warnings (warning); unknown_cells (cell): placed cells without a model.

    The counts: instances are all placed standard cells, whatever is kept of them; polygons all shapes of all layers in all placements; labels all
    texts on label layers, unbound the ones of them on no metal; rectangles those of conductors."""

    instances: DataFrame
    pins: DataFrame
    nets: DataFrame
    ports: DataFrame
    rects: DataFrame
    stats: DataFrame
    warnings: DataFrame
    unknown_cells: DataFrame


class Extracted(Netlist):
    """A netlist whose tables are made when they are first asked for: what numbers nets or instances takes jobs of its own.

    One more table: places (inst_id, cell, x, y, angle, mirror), the instances without what their names and boxes take."""

    def __init__(self, **made: Callable[[], DataFrame]):
        self._made = made

    def __getattr__(self, name: str) -> DataFrame:
        made = self.__dict__.get("_made", {})
        if name not in made:
            raise AttributeError(name)
        setattr(self, name, made[name]())
        return self.__dict__[name]


def _flat(layout: Layout | LayoutTables, top: str) -> DataFrame:
    """Every placement, top itself included, with its place."""
    refs = layout.references().select("parent", "child", "ref_id", *PLACE, "n_cols", "n_rows", F.col("col_dx").alias("dx"), "col_dy", "row_dx", F.col("row_dy").alias("dy"))
    below = hierarchy.flatten(refs, top)
    zero = F.lit(0).cast("long")
    own = refs.sparkSession.range(1).select(F.lit("").alias("path"), F.lit(top).alias("cell"), F.lit(0).alias("depth"), zero.alias("ox"), zero.alias("oy"), zero.cast(refs.schema["angle"].dataType).alias("angle"), F.lit(False).alias("mirror"), F.lit(1.0).alias("mag"))
    return own.unionByName(below)


def _shapes(layout: Layout | LayoutTables) -> DataFrame:
    """(cell, seq, part, layer, datatype, ring): boundaries, and a ring for each segment of a path that has a width."""
    drawn = layout.boundaries().select("cell", "seq", F.lit(0).alias("part"), "layer", "datatype", "ring")
    paths = layout.paths().withColumn("path_id", F.struct("path", "cell", "seq", "layer", "datatype"))
    corner = lambda x, y: F.struct(F.col(x).cast("long").alias("x"), F.col(y).cast("long").alias("y"))
    ring = F.array(corner("xlo", "ylo"), corner("xhi", "ylo"), corner("xhi", "yhi"), corner("xlo", "yhi"), corner("xlo", "ylo"))
    wires = path_rects(paths).select("path_id.cell", "path_id.seq", (F.col("i") + 1).alias("part"), "path_id.layer", "path_id.datatype", ring.alias("ring"))
    return drawn.unionByName(wires)


def _moved(ring: str) -> Column:
    """A cell's ring under its placement."""
    at = {c: F.col(c) for c in PLACE}
    return F.transform(ring, lambda p: F.struct(*(c.alias(n) for c, n in zip(place(p["x"], p["y"], **at), ("x", "y"), strict=True)))).alias("ring")


def _box_of(at: dict[str, Column]) -> list[Column]:
    """A row's rectangle under a placement in right angles."""
    (x0, y0), (x1, y1) = (place(F.col(x), F.col(y), **at) for x, y in (("xlo", "ylo"), ("xhi", "yhi")))
    return [F.least(x0, x1).alias("xlo"), F.least(y0, y1).alias("ylo"), F.greatest(x0, x1).alias("xhi"), F.greatest(y0, y1).alias("yhi")]


#: Placements of a cell that are joined with its shapes in one task.
PLACED_TOGETHER = 20_000


def _lattice() -> Column:
    """Placed in right angles, and no larger or smaller than drawn."""
    return (F.col("angle") % 90 == 0) & (F.col("mag") == 1)


class Placements:
    """Placements (k, cell, place and more; quarter: turned by one or three quarters), joined with what is drawn in their cells.

    A cell that is placed more than PLACED_TOGETHER times is several keys: its placements are dealt to parts, and what is drawn in it, a few
    rows, is repeated for each. counts is a row for each cell: n_placed, n_parts, and whether it is placed in right angles as drawn (upright) or turned by a quarter (quarters)."""

    def __init__(self, placed: DataFrame):
        own = placed.withColumn("quarter", F.col("angle") % 180 != 0)
        ways = F.max(_lattice() & ~F.col("quarter")).alias("upright"), F.max(_lattice() & F.col("quarter")).alias("quarters"), F.max(~_lattice()).alias("odd")
        self.counts = written(own.groupBy("cell").agg(F.count(F.lit(1)).alias("n_placed"), *ways).withColumn("n_parts", F.ceil(F.col("n_placed") / PLACED_TOGETHER).cast("int")), "cells")
        self.rows = own.join(self.counts.select("cell", "n_parts"), "cell").withColumn("cell_part", F.pmod(F.xxhash64("k"), F.col("n_parts")).cast("int")).drop("n_parts")
        self.alone = written(self.rows.join(self.counts.where("n_placed = 1"), "cell", "left_semi"), "alone")
        self.odd = not self.counts.where("odd").isEmpty()

    def join(self, drawn: DataFrame, *keys: str, only: Column | None = None) -> DataFrame:
        """Each placement (those of only) with each row of its cell; keys: further columns that both have."""
        each = drawn.join(self.counts.select("cell", "n_parts", "n_placed"), "cell").withColumn("cell_part", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1))).drop("n_parts")
        each = written(each, "drawn")
        # of a known size: what is drawn in few cells goes to where the placements are, and a cell that is placed once goes to where its many shapes are
        often, parts = written(each.where("n_placed > 1"), "drawn"), []
        for rows, own in ((self.rows, often), (self.alone, each.where("n_placed = 1"))):
            parts.append((rows if only is None else rows.where(only)).join(own.drop("n_placed"), ["cell", "cell_part", *keys]))
        return union(parts).drop("cell_part")


def _placed_rects(shapes: DataFrame, placed: Placements) -> DataFrame:
    """(role, level, edges, diagonal): every shape (cell, role, level, ring) of conductors and cuts, cut into rectangles where it is placed.

    Rectangles stay rectangles in right angles, and the cut doesn't change under half turns and mirrors. So a cell's shapes are cut once as they
    are and once turned by a quarter, as far as it is placed so, and only rectangles are placed. Placements at odd angles or scales take the rings along."""
    ways = F.filter(F.array(F.when(F.col("upright"), F.lit(False)), F.when(F.col("quarters"), F.lit(True))), lambda q: q.isNotNull())
    needed = placed.counts.select("cell", F.explode(ways).alias("quarter"))
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = F.when(F.col("quarter"), F.transform("ring", lambda p: corner(-p["y"], p["x"]))).otherwise(F.transform("ring", lambda p: corner(p["x"], p["y"])))
    own = shapes.join(needed, "cell").select(F.struct("cell", "quarter", "role", "level").alias("poly_id"), ring.alias("ring"))
    q = F.col("poly_id.quarter")
    back = [F.when(q, F.col("ylo")).otherwise(F.col("xlo")), F.when(q, -F.col("xhi")).otherwise(F.col("ylo")), F.when(q, F.col("yhi")).otherwise(F.col("xhi")), F.when(q, -F.col("xlo")).otherwise(F.col("yhi"))]
    cut = decompose(own).select("poly_id.*", *(c.alias(n) for c, n in zip(back, ("xlo", "ylo", "xhi", "yhi"), strict=True)), "diagonal")
    at = {c: F.col(c) for c in PLACE}
    straight = placed.join(cut, "quarter", only=_lattice()).select("role", "level", *_box_of(at), "diagonal")
    if not placed.odd:
        return straight
    odd = placed.join(shapes, only=~_lattice()).select(F.struct("role", "level").alias("poly_id"), _moved("ring"))
    return straight.unionByName(decompose(odd).select("poly_id.role", "poly_id.level", "xlo", "ylo", "xhi", "yhi", "diagonal"))


def _instance_boxes(insts: Placements, shapes: DataFrame) -> DataFrame:
    """(inst_id, edges): the abutment box of each instance's cell where it lies, or the box of all of the instance's shapes where the cell has none. A cell without shapes has no box."""
    # a path isn't an abutment box: parts of paths are numbered from 1
    boxes = abutment_boxes(shapes.where("part = 0").select("cell", "layer", "datatype", *ring_box("ring")))
    without = shapes.join(boxes, "cell", "left_anti").select("cell", "ring")
    drawn = without.select("cell", *ring_box("ring")).groupBy("cell").agg(*bounding_box())
    rows = insts.rows.where("NOT inner").withColumn("inst_id", F.col("k"))
    edges = ("xlo", "ylo", "xhi", "yhi")
    known = written(boxes.unionByName(drawn), "boxes")  # a row for each cell
    out = placed_boxes(rows.where(_lattice()).withColumns({f"f_{n}": F.lit(None).cast("long") for n in edges}), known)
    if insts.odd:
        odd = insts.join(without, only=~_lattice() & ~F.col("inner")).select(F.col("k").alias("inst_id"), _moved("ring")).select("inst_id", *ring_box("ring"))
        own = odd.groupBy("inst_id").agg(*(c.alias(f"f_{n}") for c, n in zip(bounding_box(), edges, strict=True)))
        out = out.unionByName(placed_boxes(rows.where(~_lattice()).join(own, "inst_id", "left"), boxes))
    return out.select("inst_id", *(F.col(f"p_{n}").alias(n) for n in edges))


def extract(layout: Layout | LayoutTables, top: str | None = None, keep_physical: bool = False, keep_power: bool = False, infer_body_pins: bool = True, prefix: str = "n") -> Extracted:
    """The netlist of a layout whose standard cells are placed cells without placements of their own that carry labels of conductors.

    Cells are looked up in the models by the name behind their library's prefix. Cells without logic go unless keep_physical; cells
    without a model stay and are listed. With power pins kept, body pins that a model has and no label binds go to their rail.

    One layout file at a time: names mean cells of that file, so a layout read from several is an error."""
    files = [r.path for r in layout.cells().select("path").distinct().limit(2).collect()]
    if len(files) > 1:
        raise ValueError(f"a layout of several files can't be extracted as one: {', '.join(sorted(files))}")
    spark = layout.cells().sparkSession
    refs = layout.references()
    if top is None:
        top = hierarchy.pick_top(layout.cells(), refs).first()[0]
    stack = layer_stack(spark).where("role = 'label'").select("layer", F.col("datatype").alias("texttype"), "level")
    texts = layout.texts().drop("path").join(stack, ["layer", "texttype"])
    leaves = written(hierarchy.leaf_cells(layout.cells(), refs, texts.select("cell")).select("cell", F.lit(False).alias("inner")), "leaves")
    flat = _flat(layout, top).join(leaves, "cell", "left").withColumn("inner", F.coalesce("inner", F.lit(True)))
    models = F.broadcast(library.models(spark).withColumnRenamed("cell", "model"))  # as many as the library has
    known = lambda df: df.withColumn("model", library.model_name(F.col("cell"))).join(models, "model", "left").drop("model")
    # leaves are numbered before all else, so their numbers are those among leaves
    places = written(known(netlist.numbered(flat.select("cell", "path", "inner", *PLACE), ["inner", "path"], "k", drop=("path",))).select("k", "cell", "inner", "base", "kind", *PLACE), "placements")
    insts, placed = places.where("NOT inner").withColumnRenamed("k", "inst_id"), Placements(places)
    unknown = insts.where("kind is null").select("cell").distinct()
    logic = F.lit(True) if keep_physical else F.expr("kind is null or kind <> 'physical'")

    drawn = written(_shapes(layout), "shapes")
    # numbers are those of the written rows: they tell rectangles apart, and which is which doesn't matter
    sized = _placed_rects(conductor_shapes(drawn), placed).select("role", "level", "xlo", "ylo", (F.col("xhi") - F.col("xlo")).alias("w"), (F.col("yhi") - F.col("ylo")).alias("h"), "diagonal")
    cut = written(sized.withColumn("rect_id", F.monotonically_increasing_id()), "rects").withColumns({"xhi": F.col("xlo") + F.col("w"), "yhi": F.col("ylo") + F.col("h")})
    metal = cut.where("role <> 'cut'").select("rect_id", "level", "xlo", "ylo", "xhi", "yhi")
    cuts = cut.where("role = 'cut'").select(F.col("rect_id").alias("cut_id"), F.col("level").alias("lower"), "xlo", "ylo", "xhi", "yhi")

    # a label's number says which text it is, and of which placement, so nothing else of it is carried to where it is bound
    told = known(netlist.numbered(texts.where("value <> ''").select("cell", "seq", "level", "x", "y", "value"), ["cell", "seq"], "t").join(leaves, "cell", "left"))
    texts = written(told.select("t", "cell", "seq", "level", "x", "y", "value", F.coalesce("inner", F.lit(True)).alias("inner"), logic.alias("logic")), "texts")
    n_texts = max(texts.count(), 1)
    # as many labels as are placed, counted by cells
    n_labels = placed.counts.join(texts.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "cell").agg(F.sum(F.col("n_placed") * F.col("n"))).first()[0] or 0
    parts = parts_for(spark, n_labels)
    x, y = place(F.col("x"), F.col("y"), **{c: F.col(c) for c in PLACE})
    labels = placed.join(texts.select("cell", "t", "level", "x", "y")).select((F.col("k") * n_texts + F.col("t")).alias("text_id"), "level", x.alias("x"), y.alias("y"))
    rects, nets_under = wired_labels(metal, cuts, labels, n_levels=6)
    nets_under = nets_under.withColumn("k", F.expr(f"text_id div {n_texts}")).withColumn("t", F.col("text_id") % n_texts)
    bound = nets_under.where("net is not null").join(texts.select("t", "seq", "value", "inner", "logic"), "t")
    unbound = nets_under.where("net is null")
    top_labels = bound.where("inner").groupBy(F.col("net").alias("net_id")).agg(F.min_by("value", F.struct("k", "seq")).alias("name"), F.count_distinct("value").alias("n_names"))

    kept = insts.where(logic)
    hits = bound.where("NOT inner").select(F.col("k").alias("inst_id"), F.col("value").alias("pin"), F.col("net").alias("net_id"), "logic")
    roots = netlist.supply_roots(netlist.pin_nets(hits.where(F.col("pin").isin(*SUPPLY_POWER, *SUPPLY_GROUND))))
    own_hits = hits.where("logic")
    if not keep_power:
        own_hits = own_hits.where(~F.col("pin").isin(*SUPPLY_POWER, *SUPPLY_GROUND))
    own_pins = netlist.pin_nets(own_hits, parts)
    inferred = netlist.inferred_body_pins(own_pins, BODY_TIES).withColumn("n_nets", F.lit(1).cast("long"))
    known_pins = F.broadcast(library.pins(spark))
    inferred = inferred.join(kept.select("inst_id", "base"), "inst_id").join(known_pins, ["base", "pin"], "left_semi").drop("base")
    if not (keep_power and infer_body_pins):
        inferred = inferred.limit(0)
    pins = written(own_pins.withColumn("inferred", F.lit(False)).unionByName(inferred.withColumn("inferred", F.lit(True))), "pins")
    ids = written(netlist.all_nets(pins, top_labels), "nets")
    kinds = netlist.net_kinds(ids, top_labels.select("net_id", "name"), roots)
    driven = netlist.driven_nets(pins.join(kept.select("inst_id", F.col("base").alias("cell")), "inst_id"), known_pins.select(F.col("base").alias("cell"), "pin", "direction"))
    ports = netlist.ports(top_labels.select("net_id", "name"), kinds, driven)
    names = cache(lambda: netlist.instance_names(kept))

    def nets() -> DataFrame:
        named = dealt(ids, "net_id").join(top_labels.select("net_id", F.col("name").alias("label")), "net_id", "left").join(netlist.net_names(pins, prefix), "net_id", "left").select("net_id", F.coalesce("label", "name").alias("name"), F.col("label").isNotNull().alias("named_in_layout"))
        boxes = net_boxes(rects).withColumnRenamed("net", "net_id").drop("n_rects")
        return named.join(kinds, "net_id").join(boxes, "net_id", "left")

    own_places = dealt(kept.select("inst_id", "cell", F.col("ox").alias("x"), F.col("oy").alias("y"), "angle", "mirror"), "inst_id", parts=parts)

    def instances() -> DataFrame:
        return own_places.join(names(), "inst_id").join(_instance_boxes(placed, drawn), "inst_id", "left").select("inst_id", "name", "cell", "x", "y", "angle", "mirror", "xlo", "ylo", "xhi", "yhi")

    diagonal = cut.where("diagonal")
    split = pins.where("n_nets > 1")

    @cache
    def warnings() -> DataFrame:
        missed = unbound.join(labels.select("text_id", "level", "x", "y"), "text_id").join(texts.select("t", "value"), "t")
        return (
            top_labels.where("n_names > 1").select(F.format_string("net %s has several labels", F.col("name")).alias("warning"))
            .unionByName(missed.select(F.format_string("label %s at (%d, %d) on %s is on no metal", "value", "x", "y", F.element_at(F.array(*map(F.lit, CONDUCTORS)), F.col("level") + 1)).alias("warning")))
            .unionByName(split.join(names(), "inst_id").select(F.format_string("pin %s.%s is on %d nets", "name", "pin", "n_nets").alias("warning")))
            .unionByName(diagonal.agg(F.count("*").alias("n")).where("n > 0").select(F.format_string("%d polygons with diagonal edges are taken as their boxes", "n").alias("warning")))
            .unionByName(unknown.select(F.format_string("cell %s has no model", "cell").alias("warning")))
        )

    def stats() -> DataFrame:
        counts = {
            "instances": insts, "logic_instances": kept.where("kind is null or kind <> 'physical'"), "rectangles": metal, "labels": nets_under, "unbound": unbound,
            "split_pins": split, "inferred_body_pins": pins.where("inferred"), "diagonal": diagonal, "unknown_cells": unknown, "nets": ids, "signal_nets": kinds.where("kind = 'signal'"), "warnings": warnings(),
        }
        each = union([df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in counts.items()])
        # shapes of every placement: a row for each cell, so nothing is placed to be counted
        drawn_each = placed.counts.join(drawn.groupBy("cell").agg(F.count("*").alias("n_shapes")), "cell")
        each = each.unionByName(drawn_each.agg(F.coalesce(F.sum(F.col("n_placed") * F.col("n_shapes")), F.lit(0)).alias("n")).select(F.lit("polygons").alias("name"), "n"))
        counts["polygons"] = None
        return each.agg(*(F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in counts))

    own = (("pins", pins.select("inst_id", "pin", "net_id")), ("ports", ports), ("rects", rects), ("unknown_cells", unknown), ("places", own_places))
    return Extracted(instances=instances, nets=nets, stats=stats, warnings=warnings, **{name: lambda df=df: df for name, df in own})
