"""Rectangles, rings and placements as Column expressions. All coordinates are integers, all edges belong to the rectangle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RECT = ("xlo", "ylo", "xhi", "yhi")


def rect_of_corners(x1: Column, y1: Column, x2: Column, y2: Column) -> list[Column]:
    """The four edges of the rectangle that two opposite corners span."""
    return [F.least(x1, x2).alias("xlo"), F.least(y1, y2).alias("ylo"), F.greatest(x1, x2).alias("xhi"), F.greatest(y1, y2).alias("yhi")]


def width(r: str = "") -> Column:
    return F.col(f"{r}xhi") - F.col(f"{r}xlo")


def height(r: str = "") -> Column:
    return F.col(f"{r}yhi") - F.col(f"{r}ylo")


def is_empty(r: str = "") -> Column:
    """No area."""
    return (F.col(f"{r}xhi") <= F.col(f"{r}xlo")) | (F.col(f"{r}yhi") <= F.col(f"{r}ylo"))


def contains(x: Column, y: Column, r: str = "") -> Column:
    return x.between(F.col(f"{r}xlo"), F.col(f"{r}xhi")) & y.between(F.col(f"{r}ylo"), F.col(f"{r}yhi"))


def touches(a: str, b: str) -> Column:
    """Corners and edges count."""
    return (F.col(f"{a}xlo") <= F.col(f"{b}xhi")) & (F.col(f"{b}xlo") <= F.col(f"{a}xhi")) & (F.col(f"{a}ylo") <= F.col(f"{b}yhi")) & (F.col(f"{b}ylo") <= F.col(f"{a}yhi"))


def overlaps(a: str, b: str) -> Column:
    """The common area is positive."""
    return (F.col(f"{a}xlo") < F.col(f"{b}xhi")) & (F.col(f"{b}xlo") < F.col(f"{a}xhi")) & (F.col(f"{a}ylo") < F.col(f"{b}yhi")) & (F.col(f"{b}ylo") < F.col(f"{a}yhi"))


def bounding_box() -> list[Column]:
    """Aggregates that expand to hold every rectangle of the group; nulls don't count."""
    return [F.min("xlo").alias("xlo"), F.min("ylo").alias("ylo"), F.max("xhi").alias("xhi"), F.max("yhi").alias("yhi")]


def ring_box(ring: str) -> list[Column]:
    xs, ys = F.col(f"{ring}.x"), F.col(f"{ring}.y")
    return [F.array_min(xs).alias("xlo"), F.array_min(ys).alias("ylo"), F.array_max(xs).alias("xhi"), F.array_max(ys).alias("yhi")]


def open_ring(ring: Column) -> Column:
    """The ring without closing vertices at its end, however often the first one is repeated."""
    last_other = F.array_max(F.transform(F.sequence(F.lit(1), F.greatest(F.size(ring), F.lit(1))), lambda i: F.when((i == 1) | (F.get(ring, i - 1) != F.get(ring, F.lit(0))), i)))
    return F.when(F.size(ring) > 0, F.slice(ring, 1, last_other)).otherwise(ring)


def _steps(ring: Column) -> Column:
    """Each vertex with the next one, the last with the first."""
    turned = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, turned, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def is_manhattan(ring: Column) -> Column:
    """At least four vertices, and every edge runs along an axis. ring: open."""
    return (F.size(ring) >= 4) & F.forall(_steps(ring), lambda e: (e["a"]["x"] == e["b"]["x"]) | (e["a"]["y"] == e["b"]["y"]))


def is_rectangle(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return (F.size(ring) == 4) & (F.size(F.array_distinct(xs)) == 2) & (F.size(F.array_distinct(ys)) == 2) & is_manhattan(ring)


def twice_area(ring: Column) -> Column:
    """Twice the area inside, by the shoelace sum."""
    return F.abs(F.aggregate(_steps(ring), F.lit(0).cast("long"), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]))


def place(x: Column, y: Column, ox: Column, oy: Column, angle: Column, mirror: Column, mag: Column | None = None) -> tuple[Column, Column]:
    """A point under a placement: scale, mirror in the x axis, turn, move. Quarter turns without a scale stay exact; all else is rounded once, half away from zero."""
    sx, sy = (x, y) if mag is None else (x * mag, y * mag)
    my = F.when(mirror, -sy).otherwise(sy)
    turn = F.pmod(angle, F.lit(360))
    rad = F.radians(turn.cast("double"))
    odd_x = F.round(sx * F.cos(rad) - my * F.sin(rad)).cast("long")
    odd_y = F.round(sx * F.sin(rad) + my * F.cos(rad)).cast("long")
    px = F.when(turn == 0, sx).when(turn == 90, -my).when(turn == 180, -sx).when(turn == 270, my).otherwise(odd_x)
    py = F.when(turn == 0, my).when(turn == 90, sx).when(turn == 180, -my).when(turn == 270, -sx).otherwise(odd_y)
    if mag is not None:
        px, py = F.round(px).cast("long"), F.round(py).cast("long")
    return ox + px, oy + py


def compose(outer: dict[str, Column], inner: dict[str, Column]) -> dict[str, Column]:
    """The placement (ox, oy, angle, mirror, and mag if both have it) of something placed within a placed cell; a mirrored outer turns the inner angle round, scales multiply."""
    ox, oy = place(inner["ox"], inner["oy"], **outer)
    angle = F.pmod(outer["angle"] + F.when(outer["mirror"], -inner["angle"]).otherwise(inner["angle"]), F.lit(360))
    scale = {"mag": outer["mag"] * inner["mag"]} if "mag" in outer else {}
    return {"ox": ox, "oy": oy, "angle": angle, "mirror": outer["mirror"] != inner["mirror"], **scale}
