"""Polygons cut into disjoint rectangles, row by row: no shuffle.

Rectangles and rings of few vertices are cut by array functions. These look at every edge for every height, so rings of more than SMALL_RING
vertices go, in Arrow batches, to a sweep: edges are sorted once, and each height only takes out the edges that end there and puts in those that begin."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from netframe.functions.geometry import is_manhattan, is_rectangle, open_ring, ring_box


#: Vertices of a ring up to which it is cut by array functions.
SMALL_RING = 16


def sweep(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(xlo, ylo, xhi, yhi) of an opened ring in right angles: the stretches between its upright edges, two by two, from each height to the next; neighbouring heights with the same stretches are one."""
    below, above = np.minimum(y, np.roll(y, -1)), np.maximum(y, np.roll(y, -1))
    upright = (x == np.roll(x, -1)) & (below < above)
    ex, below, above = x[upright], below[upright], above[upright]
    starts, ends = np.argsort(below, kind="stable"), np.argsort(above, kind="stable")
    heights = np.unique(y).tolist()
    start_x, start_y, end_x, end_y = ex[starts].tolist(), below[starts].tolist(), ex[ends].tolist(), above[ends].tolist()
    active: list[int] = []
    out, spans, since, s, e = [], [], heights[0] if heights else 0, 0, 0
    for at in heights:
        changed = False
        while e < len(end_y) and end_y[e] == at:
            del active[bisect.bisect_left(active, end_x[e])]
            e, changed = e + 1, True
        while s < len(start_y) and start_y[s] == at:
            bisect.insort(active, start_x[s])
            s, changed = s + 1, True
        if changed:
            now = [(lo, hi) for lo, hi in zip(active[::2], active[1::2], strict=False) if hi > lo]
            if now != spans:
                out += [(lo, since, hi, at) for lo, hi in spans]
                spans, since = now, at
    return out


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rectangles of rings (poly_id, ring)."""
    for batch in batches:
        rings, ids = batch.column("ring"), batch.column("poly_id")
        points = rings.flatten()
        xs, ys = (points.field(c).to_numpy(zero_copy_only=False) for c in "xy")
        cuts = np.concatenate([[0], np.cumsum(rings.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        rows, of = [], []
        for k in range(batch.num_rows):
            found = sweep(xs[cuts[k] : cuts[k + 1]], ys[cuts[k] : cuts[k + 1]])
            rows += found
            of += [k] * len(found)
            if len(rows) > 100_000 or k == batch.num_rows - 1:
                edges = np.array(rows, np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(of, pa.int32())), *(pa.array(edges[:, c]) for c in range(4)), pa.array(np.zeros(len(of), bool))], ["poly_id", "xlo", "ylo", "xhi", "yhi", "diagonal"])
                rows, of = [], []


def _spans(ring: Column, y0: Column, y1: Column) -> Column:
    """The stretches of x inside the ring between two neighbouring heights: its upright edges there, in order, two by two. Empty stretches and an odd edge are dropped."""
    turned = F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))
    upright = F.filter(
        F.zip_with(ring, turned, lambda a, b: F.when((a["x"] == b["x"]) & (F.least(a["y"], b["y"]) <= y0) & (F.greatest(a["y"], b["y"]) >= y1), a["x"])),
        lambda x: x.isNotNull(),
    )
    xs = F.array_sort(upright)
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(xs) / 2).cast("int")), lambda k: F.struct(F.get(xs, 2 * k).alias("lo"), F.get(xs, 2 * k + 1).alias("hi")))
    return F.filter(pairs, lambda p: p["hi"] > p["lo"])


def _slabs(ring: Column) -> Column:
    """(ylo, yhi, spans) between all neighbouring heights."""
    ys = F.array_sort(F.array_distinct(F.transform(ring, lambda p: p["y"])))
    between = F.zip_with(F.slice(ys, 1, F.size(ys) - 1), F.slice(ys, 2, F.size(ys) - 1), lambda a, b: F.struct(a.alias("ylo"), b.alias("yhi")))
    return F.transform(between, lambda s: F.struct(s["ylo"].alias("ylo"), s["yhi"].alias("yhi"), _spans(ring, s["ylo"], s["yhi"]).alias("spans")))


def _merged(slabs: Column) -> Column:
    """Neighbouring slabs with the same stretches become one."""
    kind = "array<struct<ylo:bigint,yhi:bigint,spans:array<struct<lo:bigint,hi:bigint>>>>"

    def add(done: Column, slab: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        same = (F.size(done) > 0) & last["spans"].eqNullSafe(slab["spans"]) & last["yhi"].eqNullSafe(slab["ylo"])
        longer = F.struct(last["ylo"].alias("ylo"), slab["yhi"].alias("yhi"), slab["spans"].alias("spans"))
        return F.when(same, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(done, F.array(slab)))

    return F.aggregate(slabs, F.array().cast(kind), add)


def ring_flags(polygons: DataFrame) -> DataFrame:
    """polygons (ring) with the opened ring, is_manhattan and is_rectangle."""
    return polygons.withColumn("ring", open_ring(F.col("ring"))).withColumn("is_manhattan", is_manhattan(F.col("ring"))).withColumn("is_rectangle", is_rectangle(F.col("ring")))


def decompose(polygons: DataFrame) -> DataFrame:
    """(poly_id, xlo, ylo, xhi, yhi, diagonal) of polygons (poly_id, ring).

    Rectangles are kept as they are; rings of fewer than three vertices have none; a ring with a diagonal edge is its bounding
    box, marked so; other rings are cut at every height and joined again where the cut changes nothing. poly_id may be of any type."""
    # a column that comes out of explode is made once for a row, where a plain one would be made again at each use in a lambda
    opened = polygons.select("poly_id", F.explode(F.array(open_ring(F.col("ring")))).alias("ring")).where(F.size("ring") >= 3)
    flagged = opened.withColumn("is_manhattan", is_manhattan(F.col("ring"))).withColumn("is_rectangle", is_rectangle(F.col("ring")))
    whole = flagged.where(F.col("is_rectangle") | ~F.col("is_manhattan")).select("poly_id", *ring_box("ring"), (~F.col("is_manhattan")).alias("diagonal"))
    inner = flagged.where(F.col("is_manhattan") & ~F.col("is_rectangle"))
    slabs = inner.where(F.size("ring") <= SMALL_RING).select("poly_id", F.explode(F.array(_slabs(F.col("ring")))).alias("slabs"))
    slabs = slabs.select("poly_id", F.explode(_merged(F.col("slabs"))).alias("slab"))
    cut = slabs.select("poly_id", "slab.ylo", "slab.yhi", F.explode("slab.spans").alias("span")).select("poly_id", F.col("span.lo").alias("xlo"), "ylo", F.col("span.hi").alias("xhi"), "yhi", F.lit(False).alias("diagonal"))
    schema = StructType([polygons.schema["poly_id"], *(StructField(c, LongType()) for c in ("xlo", "ylo", "xhi", "yhi")), StructField("diagonal", BooleanType())])
    point = F.transform("ring", lambda p: F.struct(p["x"].cast("long").alias("x"), p["y"].cast("long").alias("y")))
    swept = inner.where(F.size("ring") > SMALL_RING).select("poly_id", point.alias("ring")).mapInArrow(_swept, schema)
    return whole.unionByName(cut).unionByName(swept)


def path_rects(paths: DataFrame) -> DataFrame:
    """(path_id, i, xlo, ylo, xhi, yhi): a rectangle for each segment of paths (path_id, width, path_type, pts).

    Every segment of types 1 and 2 reaches half a width beyond both of its ends, so bends are filled; a diagonal segment is its box, padded; paths without a width or with fewer than two points have none."""
    half = F.expr("width div 2")
    drawn = paths.where((F.col("width") > 0) & (F.size("pts") >= 2))
    seg = drawn.select("path_id", half.alias("half"), F.when(F.col("path_type").isin(1, 2), half).otherwise(F.lit(0)).alias("reach"), F.posexplode(F.zip_with(F.slice("pts", 1, F.size("pts") - 1), F.slice("pts", 2, F.size("pts") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("i", "s"))
    ax, ay, bx, by = (F.col(f"s.{p}.{c}") for p in "ab" for c in "xy")
    across = F.when(ay == by, F.col("reach")).otherwise(F.col("half"))
    along = F.when((ax == bx) & (ay != by), F.col("reach")).otherwise(F.col("half"))
    return seg.select("path_id", "i", (F.least(ax, bx) - across).alias("xlo"), (F.least(ay, by) - along).alias("ylo"), (F.greatest(ax, bx) + across).alias("xhi"), (F.greatest(ay, by) + along).alias("yhi"))
