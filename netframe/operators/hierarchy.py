"""Placement hierarchies: top cells, leaves, and flattening by one join for each depth.

References are (parent, child, ref_id, ox, oy, angle, mirror, n_cols, n_rows, dx, dy): an array's columns lie dx apart and its rows dy.
They may also have col_dy and row_dx, the other axis of these steps (of turned or skewed arrays), and mag, their scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netframe.functions.geometry import compose
from netframe.operators.components import written
from netframe.operators.graphs import MAX_PARTS, rounds, union


def _once(df: DataFrame, name: str) -> DataFrame:
    """(cell): a column's values, once each, so that a cell with very many placements is one row of each task."""
    return df.select(F.col(name).alias("cell")).distinct()


def top_cells(cells: DataFrame, refs: DataFrame) -> DataFrame:
    """Cells that nothing places."""
    return cells.join(_once(refs, "child"), "cell", "left_anti").select(*cells.columns)


def pick_top(cells: DataFrame, refs: DataFrame) -> DataFrame:
    """The one top cell; an error if there is none or more than one."""
    found = top_cells(cells, refs).agg(F.count("*").alias("n"), F.min("cell").alias("cell"), F.concat_ws(", ", F.slice(F.sort_array(F.collect_set("cell")), 1, 10)).alias("names"))
    return found.select(F.when(F.col("n") == 1, F.col("cell")).otherwise(F.raise_error(F.concat(F.lit("top cells found: "), F.col("n").cast("string"), F.lit(" "), F.col("names")))).alias("cell"))


def leaf_cells(cells: DataFrame, refs: DataFrame, labels: DataFrame) -> DataFrame:
    """Cells that are placed, place nothing themselves, and have a label (labels: cell)."""
    return cells.join(_once(refs, "child"), "cell", "left_semi").join(_once(refs, "parent"), "cell", "left_anti").join(_once(labels, "cell"), "cell", "left_semi").select(*cells.columns)


def missing_children(cells: DataFrame, refs: DataFrame) -> DataFrame:
    """Placed cells that there are no cells for; flattening skips them."""
    return refs.select(F.col("child").alias("cell")).distinct().join(cells, "cell", "left_anti")


def expand_arrays(refs: DataFrame) -> DataFrame:
    """A row for each copy of an array, moved to its place, with row and column. Less than one row or column is one."""
    copies = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col(n).cast("long"), F.lit(1).cast("long")) - 1))
    step = lambda n: F.col(n) if n in refs.columns else F.lit(0).cast("long")
    each = refs.withColumn("row", copies("n_rows")).withColumn("col", copies("n_cols"))
    return each.withColumn("ox", F.col("ox") + F.col("col") * F.col("dx") + F.col("row") * step("row_dx")).withColumn("oy", F.col("oy") + F.col("row") * F.col("dy") + F.col("col") * step("col_dy"))


def flatten(refs: DataFrame, top: str, max_depth: int | None = None) -> DataFrame:
    """(path, cell, depth, ox, oy, angle, mirror, and mag if references have it) of every placement below top, by its composed transform.

    The frontier is joined with the references once for each depth; placed cells in a path that they are part of raise an
    error. References are written once, so a deep hierarchy doesn't read its source again and again."""
    place = ("ox", "oy", "angle", "mirror", *(["mag"] if "mag" in refs.columns else []))
    each = written(expand_arrays(refs), "references").select(
        "parent",
        F.col("child").alias("r_cell"),
        *(F.col(c).alias(f"r_{c}") for c in place),
        F.concat(F.col("child"), F.lit("#"), F.col("ref_id").cast("string"), F.when((F.col("n_rows") > 1) | (F.col("n_cols") > 1), F.concat(F.lit("["), F.col("row").cast("string"), F.lit("]["), F.col("col").cast("string"), F.lit("]"))).otherwise("")).alias("step"),
    )
    zero = F.lit(0).cast("long")
    start = {"ox": zero, "oy": zero, "angle": zero.cast(refs.schema["angle"].dataType), "mirror": F.lit(False), "mag": F.lit(1.0)}
    frontier = refs.sparkSession.range(1).select(F.lit("").alias("path"), F.lit(top).alias("cell"), F.array(F.lit(top)).alias("above"), F.lit(0).alias("depth"), *(start[c].alias(c) for c in place))
    levels = []
    for at_depth in rounds(max_depth, "placements"):
        depth = at_depth + 1
        at = compose({c: F.col(c) for c in place}, {c: F.col(f"r_{c}") for c in place})
        # what is placed in the frontier's cells, of a known size: few rows of few cells go to where the placements are, however many a cell has
        mine = written(each.join(F.broadcast(frontier.select(F.col("cell").alias("parent")).distinct()), "parent", "left_semi"), "below") if at_depth else each
        nxt = frontier.join(mine, frontier.cell == mine.parent).select(
            F.concat_ws("/", F.nullif(F.col("path"), F.lit("")), F.col("step")).alias("path"),
            F.when(F.array_contains("above", F.col("r_cell")), F.raise_error(F.concat(F.lit("a cell places itself: "), F.col("r_cell")))).otherwise(F.col("r_cell")).alias("cell"),
            F.concat(F.col("above"), F.array("r_cell")).alias("above"),
            F.lit(depth).alias("depth"),
            *(at[c].alias(c) for c in place),
        )
        frontier = written(nxt, "frontier")
        if frontier.isEmpty():
            break
        levels.append(frontier.drop("above"))
        if len(levels) > MAX_PARTS:
            levels = [written(union(levels), "placements")]
    return union(levels or [frontier.drop("above")])
