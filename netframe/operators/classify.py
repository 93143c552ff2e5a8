"""The layer stack as a small dimension, and what it says about shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netframe.functions.geometry import RECT, bounding_box, place

# fixed values of the layer stack: conductors and the cuts above them, from the bottom; purposes of a layer
CONDUCTORS = ("li1", "met1", "met2", "met3", "met4", "met5")
CUTS = ("mcon", "via", "via2", "via3", "via4")
FIRST_LAYER, DRAWING, PIN, LABEL, CUT = 67, 20, 16, 5, 44
ABUTMENT = (81, 4)


def layer_stack(spark: SparkSession) -> DataFrame:
    """(layer, datatype, role, level, name): what each layer and purpose means; a row for each of a few dozen."""
    rows = [(FIRST_LAYER + k, d, role, k, name) for k, name in enumerate(CONDUCTORS) for d, role in ((DRAWING, "drawing"), (PIN, "pin"), (LABEL, "label"))]
    rows += [(FIRST_LAYER + k, CUT, "cut", k, name) for k, name in enumerate(CUTS)]
    return F.broadcast(spark.createDataFrame(rows, "layer int, datatype int, role string, level int, name string"))


def classified(shapes: DataFrame) -> DataFrame:
    """shapes (layer, datatype) with role, level and name, null where the stack doesn't know the layer."""
    return shapes.join(layer_stack(shapes.sparkSession), ["layer", "datatype"], "left")


def conductor_shapes(shapes: DataFrame) -> DataFrame:
    """Only shapes of conductors (drawn or pins) and of cuts: what is worth decomposing."""
    return shapes.join(layer_stack(shapes.sparkSession).where("role <> 'label'"), ["layer", "datatype"])


def abutment_boxes(shapes: DataFrame, layer: int = ABUTMENT[0], datatype: int = ABUTMENT[1]) -> DataFrame:
    """(cell, box): the union of a cell's shapes (cell, layer, datatype, edges) on the abutment layer."""
    return shapes.where((F.col("layer") == layer) & (F.col("datatype") == datatype)).groupBy("cell").agg(*bounding_box())


def placed_boxes(placements: DataFrame, boxes: DataFrame) -> DataFrame:
    """placements (inst_id, cell, ox, oy, angle, mirror, mag if scaled, and an own box as f_xlo...) with the box around their cell's box under the placement, or their own box where the cell has none."""
    joined = placements.join(boxes, "cell", "left")
    at = {c: F.col(c) for c in ("ox", "oy", "angle", "mirror", "mag") if c in placements.columns}
    xs, ys = zip(*(place(F.col(x), F.col(y), **at) for x in ("xlo", "xhi") for y in ("ylo", "yhi")), strict=True)
    made = dict(zip(RECT, (F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)), strict=True))
    return joined.select("inst_id", "cell", *(F.coalesce(made[c], F.col(f"f_{c}")).alias(f"p_{c}") for c in RECT))
