"""Spatial joins as bucketed equi-joins on grids that fit the rectangles.

Rectangles are told apart by size: those of a class are at most half as wide and high as the class's cells, and classes are STEP times
apart. A rectangle is listed in the few cells of its own class that it reaches, however long or small it is. To meet it, a rectangle of the same
or a finer class looks into the cells of that class that it reaches itself; coarser classes are few, and only those that there are
count. The join is on (level, class, cell), with the exact predicate behind it. A pair that shares several cells is kept only in the one
that owns the pair's lower left corner, so nothing has to be made distinct. A rail across the chip is one row; a crowd of tiny shapes
lies in tiny cells. Cells that hold more than DENSE rectangles all the same (piles of them) are split: the listed rectangles are dealt to
parts, and those that look into the cell look into each part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netframe.functions.geometry import contains, overlaps, touches
from netframe.operators.components import dealt

#: Cells of class k are BASE * STEP ** k wide and high; STEP is a power of two.
BASE, STEP = 64, 4
#: Listed rectangles of a cell from which on it is split, and about how many a part has; and the part of the rectangles that shows which cells are so crowded.
DENSE, SHOWN = 2048, 0.05
RECT = ("xlo", "ylo", "xhi", "yhi")
_KEYS = ("level", "cls", "bx", "by")


def side(cls: Column) -> Column:
    """A class's cells' width and height."""
    return F.lit(BASE).cast("long") * F.pow(F.lit(float(STEP)), cls).cast("long")


def size_class(xlo: str = "xlo", ylo: str = "ylo", xhi: str = "xhi", yhi: str = "yhi") -> Column:
    """The first class whose cells are at least twice as wide and high as the rectangle."""
    size = F.greatest(F.col(xhi) - F.col(xlo), F.col(yhi) - F.col(ylo), F.lit(BASE // 2)) * 2
    return F.ceil(F.log2(size / BASE) / (STEP.bit_length() - 1)).cast("int")


def classes_of(rects: DataFrame) -> list[int]:
    """The classes that there are: about 30 at most, as coordinates are longs."""
    return sorted(rects.select(size_class().alias("cls")).agg(F.collect_set("cls")).first()[0])


def _cells(df: DataFrame) -> DataFrame:
    """Rows once for each cell (bx, by) of their class cls that they reach."""
    along = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / side(F.col("cls"))), F.floor(F.col(hi) / side(F.col("cls")))))
    return df.withColumn("bx", along("xlo", "xhi")).withColumn("by", along("ylo", "yhi"))


def listed(rects: DataFrame) -> DataFrame:
    """rects in the cells of their own class."""
    return _cells(rects.withColumn("cls", size_class()).withColumn("own", F.col("cls")))


def looking(rects: DataFrame, classes: list[int], coarser_only: bool = False) -> DataFrame:
    """rects in the cells that they look into: those of their own class and of the coarser ones among classes."""
    there, own = F.array(*(F.lit(k) for k in classes)), F.col("own")
    least = own + 1 if coarser_only else own
    return _cells(rects.withColumn("own", size_class()).withColumn("cls", F.explode(F.filter(there, lambda k: k >= least))))


def _renamed(df: DataFrame, prefix: str, keys: tuple[str, ...]) -> DataFrame:
    return df.select(*keys, *(F.col(c).alias(f"{prefix}{c}") for c in df.columns if c not in keys))


def _owner() -> Column:
    """Whether the cell is that of the pair's common lower left corner."""
    at = side(F.col("cls"))
    return (F.col("bx") == F.floor(F.greatest("a_xlo", "b_xlo") / at)) & (F.col("by") == F.floor(F.greatest("a_ylo", "b_ylo") / at))


def _split(looks: DataFrame, there: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with a part of their cell, 0 where it isn't crowded. A sample only says into how many parts a cell goes; every rectangle is in one of them. If no cell is crowded, both stay as they are."""
    shown = there.where(F.pmod(F.xxhash64("rect_id"), F.lit(10_000)) < int(10_000 * SHOWN)).groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("n"))
    crowded = shown.where(F.col("n") > most * SHOWN).select(*_KEYS, F.ceil(F.col("n") / (most * SHOWN)).cast("int").alias("n_parts"))
    if crowded.isEmpty():
        return looks.withColumn("part", F.lit(0)), there.withColumn("part", F.lit(0))
    every = F.explode(F.sequence(F.lit(0), F.coalesce("n_parts", F.lit(1)) - 1))
    return (
        looks.join(crowded, list(_KEYS), "left").withColumn("part", every).drop("n_parts"),
        there.join(crowded, list(_KEYS), "left").withColumn("part", F.pmod(F.xxhash64("rect_id"), F.coalesce("n_parts", F.lit(1))).cast("int")).drop("n_parts"),
    )


def touch_pairs(rects: DataFrame, dense: int = DENSE, listed_only: Column | None = None) -> DataFrame:
    """(a, b), a < b: rectangles of the same level that touch. rects: rect_id, level and edges. listed_only: pairs that none of the large rectangles, of which this is true, is in are left out; larger ones must be among them."""
    own = rects.select("rect_id", "level", *RECT).withColumn("held", F.lit(True) if listed_only is None else listed_only)
    held = own.where("held")
    looks, there = _split(looking(own, classes_of(held)), listed(held), dense)
    keys = (*_KEYS, "part")
    pairs = _renamed(looks, "a_", keys).join(_renamed(there, "b_", keys), list(keys))
    once = (F.col("a_own") < F.col("b_own")) | (F.col("a_rect_id") < F.col("b_rect_id")) | ~F.col("a_held")
    return pairs.where(once & touches("a_", "b_") & _owner()).select(F.least("a_rect_id", "b_rect_id").alias("a"), F.greatest("a_rect_id", "b_rect_id").alias("b"))


def cut_hits(cuts: DataFrame, rects: DataFrame, n_levels: int) -> DataFrame:
    """(cut_id, rect_id): rectangles of the two levels beside a cut that share area with it. Cuts above the stack have none.

    A cut and a rectangle meet in the cells of the coarser of their classes: one of them is listed there, the other looks into it."""
    each = cuts.where(F.col("lower") + 1 < n_levels).withColumn("level", F.explode(F.array(F.col("lower"), F.col("lower") + 1))).drop("lower")
    own = rects.select("rect_id", "level", *RECT)
    tag = lambda df, name: df.withColumn("tag", F.lit(name))
    a = tag(listed(each), "cut").unionByName(tag(looking(each, classes_of(own), coarser_only=True), "rect"))
    b = tag(listed(own), "rect").unionByName(tag(looking(own, classes_of(each)), "cut"))
    keys = (*_KEYS, "tag")
    met = _renamed(a, "a_", keys).join(_renamed(b, "b_", keys), list(keys)).where(overlaps("a_", "b_") & _owner())
    return met.select(F.col("a_cut_id").alias("cut_id"), F.col("b_rect_id").alias("rect_id"))


def cut_edges(hits: DataFrame) -> DataFrame:
    """(a, b): each cut ties all rectangles it hits to the smallest of them, whatever their levels. Other columns of hits stay."""
    least = hits.groupBy("cut_id").agg(F.min("rect_id").alias("a"))
    more = [c for c in hits.columns if c not in ("cut_id", "rect_id")]
    made = hits.join(least, "cut_id").where("a < rect_id").select("a", F.col("rect_id").alias("b"), *more)
    return made if more else made.distinct()


def _point_rows(points: DataFrame, rects: DataFrame, value: str) -> DataFrame:
    """points with a column of the rectangles of their level that hold them. A point looks into one cell of each class, and has a row without it for each in which it finds none."""
    own = rects.select(value, "level", *RECT)
    held = F.struct(*points.columns).alias("_point")
    probe = points.select(held, "level", F.col("x").alias("px"), F.col("y").alias("py"), F.explode_outer(F.array(*(F.lit(k) for k in classes_of(own))).cast("array<int>")).alias("cls"))
    probe = probe.withColumn("bx", F.floor(F.col("px") / side(F.col("cls")))).withColumn("by", F.floor(F.col("py") / side(F.col("cls"))))
    there = _renamed(listed(own), "r_", _KEYS)
    on = [probe[k] == there[k] for k in _KEYS] + [contains(probe.px, probe.py, "r_")]
    return probe.join(there, on, "left").select("_point", F.col(f"r_{value}").alias(value))


def point_hits(points: DataFrame, rects: DataFrame) -> DataFrame:
    """points (told apart by a column of theirs) left-joined with the rectangles of their level that hold them: one row with a null rect_id where none does."""
    first = Window.partitionBy("_point").orderBy(F.col("rect_id").asc_nulls_last())
    rows = _point_rows(points, rects, "rect_id").withColumn("n", F.row_number().over(first))
    return rows.where("rect_id IS NOT NULL OR n = 1").select("_point.*", "rect_id")


def points_held(points: DataFrame, rects: DataFrame) -> DataFrame:
    """points with rect_id, a row for each rectangle of their level that holds them."""
    return _point_rows(points, rects, "rect_id").where("rect_id IS NOT NULL").select("_point.*", "rect_id")


def points_bound(points: DataFrame, rects: DataFrame, key: str) -> DataFrame:
    """points, told apart by key, with net: the smallest net of the rectangles (with net) that hold a point, null where there are none."""
    more = [c for c in points.columns if c != key]
    rows = _point_rows(points, rects, "net").select("_point.*", "net")
    return dealt(rows, key).groupBy(key).agg(*(F.first(c).alias(c) for c in more), F.min("net").alias("net"))


def in_window(rects: DataFrame, xlo: int, ylo: int, xhi: int, yhi: int, max_level: int) -> DataFrame:
    """Rectangles up to a level that touch a window."""
    return rects.where((F.col("level") <= max_level) & (F.col("xlo") <= xhi) & (F.col("xhi") >= xlo) & (F.col("ylo") <= yhi) & (F.col("yhi") >= ylo))
