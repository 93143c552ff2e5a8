"""Layout pictures: viewport, colours and the SVG text of each rectangle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netframe.operators.classify import CONDUCTORS
from netframe.sources import documents

# fixed values of the pictures: colours of the levels from the bottom; background; the highlighted net and all else beside it; dimmed supplies; metal of no net; outlines of instances and of rectangles
PALETTE = ("#c0392b", "#2e86c1", "#28b463", "#f39c12", "#8e44ad", "#16a085")
BACKGROUND = "#ffffff"
HIGHLIGHT, CONTEXT = "#d62828", "#e8ebee"
DIMMED, NO_NET = "#e4e7ea", "#d5d8dc"
OUTLINE, OUTLINE_WIDTH, STROKE = "#b9c2cc", 0.7, "#333"
# fixed values of the colours of nets: a step round the circle in hundred-millionths of a degree; saturation, value of the lowest level and what each level takes from it, in hundredths
HUE_STEP, CIRCLE = 13_750_776_405, 36_000_000_000
SATURATION, VALUE, VALUE_STEP = 68, 95, 6


def _pixels_high(width: Column, height: Column, width_px: int) -> Column:
    return F.greatest(F.round(F.greatest(height, F.lit(1)) * F.lit(float(width_px)) / F.greatest(width, F.lit(1))).cast("long"), F.lit(1))


def viewport(rects: DataFrame, width_px: int = 1600) -> DataFrame:
    """One row: bounding box of all rectangles and pixels of the picture."""
    box = rects.agg(F.min("xlo").alias("xlo"), F.min("ylo").alias("ylo"), F.max("xhi").alias("xhi"), F.max("yhi").alias("yhi"))
    return box.withColumn("width_px", F.lit(width_px)).withColumn("height_px", _pixels_high(F.col("xhi") - F.col("xlo"), F.col("yhi") - F.col("ylo"), width_px))


def hue(net: Column) -> Column:
    """Steps round the circle, in hundred-millionths of a degree; integers, so that no net is too large."""
    return (net.cast("decimal(38,0)") * F.lit(HUE_STEP).cast("decimal(12,0)") % F.lit(CIRCLE).cast("decimal(12,0)")).cast("long")


def net_colour(net: Column, level: Column) -> Column:
    """#rrggbb: a hue for the net, and darker for each level. In integers: parts of ten thousand times the sixth of the circle."""
    turn, sixth = hue(net), CIRCLE // 6
    value = F.lit(VALUE) - VALUE_STEP * level
    chroma = value * SATURATION  # in ten-thousandths
    sector, within = F.floor(turn / sixth).cast("int"), (turn % sixth).cast("double") / sixth
    rising = F.when(sector % 2 == 0, within).otherwise(1 - within)
    c, x = chroma / 10_000.0, chroma / 10_000.0 * rising
    m = value / 100.0 - c
    part = lambda full, ramp: F.round((F.when(sector.isin(*full), c).when(sector.isin(*ramp), x).otherwise(0.0) + m) * 255).cast("int")
    return F.format_string("#%02x%02x%02x", part((0, 5), (1, 4)), part((1, 2), (0, 3)), part((3, 4), (2, 5)))


def colours(rects: DataFrame, by: str = "net", highlight: int | None = None, dim_power: bool = False) -> DataFrame:
    """rects (level, net, kind) with colour. With a highlighted net all else is context; else supplies are dimmed if asked for, and the rest is coloured by level or by net."""
    if highlight is not None:
        return rects.withColumn("colour", F.when(F.col("net") == highlight, HIGHLIGHT).otherwise(CONTEXT))
    own = F.element_at(F.array(*map(F.lit, PALETTE)), (F.col("level") % len(PALETTE) + 1).cast("int")) if by == "layer" else F.when(F.col("net").isNull(), NO_NET).otherwise(net_colour(F.col("net"), F.col("level")))
    if dim_power and "kind" in rects.columns:
        own = F.when(F.col("net").isNotNull() & (F.col("kind") != "signal"), DIMMED).otherwise(own)
    return rects.withColumn("colour", own)


def _scaled(width_px: int) -> tuple[list[Column], Column]:
    """A rectangle's x, y, width and height in pixels, and the scale; y points down. Columns v_xlo, v_yhi, v_xhi of the view."""
    scale = F.lit(float(width_px)) / F.greatest(F.col("v_xhi") - F.col("v_xlo"), F.lit(1))
    return [(v * scale).cast("double") for v in (F.col("xlo") - F.col("v_xlo"), F.col("v_yhi") - F.col("yhi"), F.col("xhi") - F.col("xlo"), F.col("yhi") - F.col("ylo"))], scale


def _viewed(rects: DataFrame, box: DataFrame) -> DataFrame:
    return rects.crossJoin(F.broadcast(box.select(*(F.col(c).alias(f"v_{c}") for c in ("xlo", "ylo", "xhi", "yhi")))))  # one row


def svg_elements(rects: DataFrame, box: DataFrame, width_px: int = 1600, stroke: float = 0.0) -> DataFrame:
    """(level, rect_id, text) of rects with colour. box: one row of viewport; stroke: width of outlines in the layout's units, none at 0."""
    at, scale = _scaled(width_px)
    edge = F.format_string(f' stroke="{STROKE}" stroke-width="%.2f"', (F.lit(stroke) * scale).cast("double")) if stroke > 0 else F.lit("")
    return _viewed(rects, box).select("level", "rect_id", F.format_string('<rect x="%.2f" y="%.2f" width="%.2f" height="%.2f" fill="%s"%s/>', *at, F.col("colour"), edge).alias("text"))


def to_svg(
    rects: DataFrame,
    by: str = "net",
    width_px: int = 1600,
    clip: tuple[int, int, int, int] | None = None,
    max_level: int = 5,
    highlight: int | None = None,
    dim_power: bool = False,
    instances: DataFrame | None = None,
    stroke: float = 0.0,
    background: str = BACKGROUND,
) -> DataFrame:
    """(part, key, text): a picture's lines, to be written in that order. rects: rect_id, level, edges, net (and kind); levels are groups, from the bottom. instances: edges of boxes to outline.

    The view is the clip or the box of all rectangles, drawn or not; a picture of no rectangles has no lines."""
    spark = rects.sparkSession
    if clip:
        box = spark.createDataFrame([clip], "xlo long, ylo long, xhi long, yhi long").withColumn("width_px", F.lit(width_px)).withColumn("height_px", _pixels_high(F.col("xhi") - F.col("xlo"), F.col("yhi") - F.col("ylo"), width_px))
        box = box.join(rects.select(F.lit(1)).limit(1), F.lit(True), "left_semi")
    else:
        box = viewport(rects, width_px).where("xlo IS NOT NULL")

    def seen(df: DataFrame) -> DataFrame:
        return df.where((F.col("xlo") <= clip[2]) & (F.col("xhi") >= clip[0]) & (F.col("ylo") <= clip[3]) & (F.col("yhi") >= clip[1])) if clip else df

    line = lambda df, part, key, text: df.select(F.lit(part).alias("part"), key.alias("key"), text.alias("text"))
    no_key, digits = F.lit(""), lambda c, n: F.lpad(F.col(c).cast("string"), n, "0")
    out = line(box, 0, no_key, F.format_string('<svg xmlns="http://www.w3.org/2000/svg" width="%d" height="%d" viewBox="0 0 %d %d">', "width_px", "height_px", "width_px", "height_px"))
    out = out.unionByName(line(box, 1, no_key, F.format_string('<rect width="100%%" height="100%%" fill="%s"/>', F.lit(background))))
    if instances is not None:
        at, _ = _scaled(width_px)
        boxes = _viewed(seen(instances.where("xlo IS NOT NULL")), box)
        out = out.unionByName(line(box, 2, no_key, F.lit(f'<g fill="none" stroke="{OUTLINE}" stroke-width="{OUTLINE_WIDTH}">')))
        out = out.unionByName(line(boxes, 3, F.concat_ws("_", *(digits(c, 20) for c in ("xlo", "ylo", "xhi", "yhi"))), F.format_string('<rect x="%.2f" y="%.2f" width="%.2f" height="%.2f"/>', *at)))
        out = out.unionByName(line(box, 4, no_key, F.lit("</g>")))
    drawn = seen(rects.where(F.col("level") <= F.least(F.lit(max_level), F.lit(len(CONDUCTORS) - 1))))
    level = digits("level", 4)
    groups = drawn.select("level").distinct()
    name = F.element_at(F.array(*map(F.lit, CONDUCTORS)), F.col("level").cast("int") + 1)
    out = out.unionByName(line(groups, 5, level, F.format_string('<g id="%s">', name)))
    body = svg_elements(colours(drawn, by, highlight, dim_power), box, width_px, stroke)
    out = out.unionByName(line(body, 5, F.concat(level, F.lit("a"), digits("rect_id", 20)), F.col("text")))
    out = out.unionByName(line(groups, 5, F.concat(level, F.lit("b")), F.lit("</g>")))
    return out.unionByName(line(box, 6, no_key, F.lit("</svg>")))


def write_svg(rects: DataFrame, path: str, overwrite: bool = False, **picture) -> None:
    """to_svg's lines as the document at path; picture: what to_svg takes."""
    documents.write_lines(to_svg(rects, **picture), path, overwrite)
