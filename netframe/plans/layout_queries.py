"""Queries over layouts: spatial joins, nets, decomposition, hierarchy, classification and pictures, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netframe.functions.geometry import RECT, bounding_box, place, ring_box
from netframe.operators import classify, components, decompose, hierarchy, inspect, nets, render, spatial
from netframe.plans.bridge import ctes, rings, view

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


TOUCH = "SELECT a.rect_id AS a, b.rect_id AS b FROM v_rect a JOIN v_rect b ON a.level = b.level AND a.rect_id < b.rect_id AND a.xlo <= b.xhi AND b.xlo <= a.xhi AND a.ylo <= b.yhi AND b.ylo <= a.yhi"
HITS = "SELECT c.cut_id, r.rect_id FROM v_cut c JOIN v_rect r ON r.level IN (c.lower, c.lower + 1) AND c.xlo < r.xhi AND r.xlo < c.xhi AND c.ylo < r.yhi AND r.ylo < c.yhi WHERE c.lower + 1 < 4"
REACH = "both_ways AS (SELECT a AS u, b AS v FROM edges UNION SELECT b, a FROM edges), reach AS (SELECT u, u AS v FROM both_ways UNION SELECT r.u, e.v FROM reach r JOIN both_ways e ON r.v = e.u), root AS (SELECT u, MIN(v) AS net FROM reach GROUP BY u), nets AS (SELECT rect_id, COALESCE(net, rect_id) AS net FROM v_rect LEFT JOIN root ON u = rect_id)"
NETS = f"WITH RECURSIVE {ctes('v_rect')}, edges AS ({TOUCH}), {REACH} "


def _rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_rect")


def _nets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.written(nets.wired(_rects(spark, sf_dir)), "nets")


@query(f"WITH {ctes('v_rect')} {TOUCH}")
def q_touch_pairs(spark, sf_dir):
    return spatial.touch_pairs(_rects(spark, sf_dir))


@query(f"WITH {ctes('v_rect', 'v_cut')} {HITS}")
def q_overlap_cut(spark, sf_dir):
    return spatial.cut_hits(view(spark, sf_dir, "v_cut"), _rects(spark, sf_dir), 4)


@query(f"WITH {ctes('v_rect', 'v_label')} SELECT text_id, MIN(value) AS value, MIN(rect_id) AS rect_id, CAST(COUNT(rect_id) AS BIGINT) AS n_hits FROM v_label l LEFT JOIN v_rect r ON l.level = r.level AND l.x BETWEEN r.xlo AND r.xhi AND l.y BETWEEN r.ylo AND r.yhi GROUP BY text_id")
def q_point_bind(spark, sf_dir):
    hits = spatial.point_hits(view(spark, sf_dir, "v_label"), _rects(spark, sf_dir))
    return hits.groupBy("text_id").agg(F.min("value").alias("value"), F.min("rect_id").alias("rect_id"), F.count("rect_id").alias("n_hits"))


@query(f"WITH {ctes('v_rect', 'v_label')} SELECT value, COUNT(*) AS n_unbound, CONCAT('unbound label ', value) AS warning FROM v_label l WHERE NOT EXISTS (SELECT 1 FROM v_rect r WHERE l.level = r.level AND l.x BETWEEN r.xlo AND r.xhi AND l.y BETWEEN r.ylo AND r.yhi) GROUP BY value")
def q_unbound(spark, sf_dir):
    hits = spatial.point_hits(view(spark, sf_dir, "v_label"), _rects(spark, sf_dir))
    return hits.where("rect_id is null").groupBy("value").agg(F.count("*").alias("n_unbound")).withColumn("warning", F.format_string("unbound label %s", F.col("value")))


@query(NETS + "SELECT rect_id, net FROM nets")
def q_nets(spark, sf_dir):
    return nets.rect_nets(_rects(spark, sf_dir))


@query(NETS + ", sizes AS (SELECT net, COUNT(*) AS size FROM nets GROUP BY net) SELECT size, COUNT(*) AS n_nets FROM sizes GROUP BY size")
def q_net_sizes(spark, sf_dir):
    return nets.rect_nets(_rects(spark, sf_dir)).groupBy("net").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n_nets"))


@query(NETS + "SELECT net, COUNT(*) AS n_rects, MIN(xlo) AS xlo, MIN(ylo) AS ylo, MAX(xhi) AS xhi, MAX(yhi) AS yhi FROM nets JOIN v_rect USING (rect_id) GROUP BY net")
def q_net_bbox(spark, sf_dir):
    rects = _rects(spark, sf_dir)
    return nets.net_boxes(nets.wired(rects))


@query(NETS + "SELECT COUNT(DISTINCT net) AS n_nets FROM nets")
def q_net_count(spark, sf_dir):
    return nets.rect_nets(_rects(spark, sf_dir)).agg(F.count_distinct("net").alias("n_nets"))


@query(f"WITH RECURSIVE {ctes('v_rect', 'v_cut')}, hits AS ({HITS}), edges AS ({TOUCH} UNION SELECT m.a, h.rect_id FROM hits h JOIN (SELECT cut_id, MIN(rect_id) AS a FROM hits GROUP BY cut_id) m USING (cut_id) WHERE m.a < h.rect_id), {REACH} SELECT rect_id, net FROM nets")
def q_nets_via(spark, sf_dir):
    return nets.rect_nets(_rects(spark, sf_dir), view(spark, sf_dir, "v_cut"))


BOUND = NETS + f", {ctes('v_label')}, bound AS (SELECT text_id, MIN(value) AS value, MIN(net) AS net FROM v_label l JOIN v_rect r ON l.level = r.level AND l.x BETWEEN r.xlo AND r.xhi AND l.y BETWEEN r.ylo AND r.yhi JOIN nets USING (rect_id) GROUP BY text_id) "


@query(BOUND + "SELECT net, arg_min(value, text_id) AS name, COUNT(DISTINCT value) AS n_names FROM bound GROUP BY net HAVING COUNT(DISTINCT value) > 1")
def q_conflict_labels(spark, sf_dir):
    bound = nets.bind_labels(view(spark, sf_dir, "v_label"), _nets(spark, sf_dir))
    return nets.net_labels(bound).where("n_names > 1")


RINGS = f"WITH {ctes('v_ring')} "


@query(RINGS + "SELECT poly_id, COUNT(*) AS n_vertices, shape <> 3 AS is_manhattan, shape = 0 AS is_rectangle FROM v_ring JOIN v_box USING (poly_id) GROUP BY poly_id, shape")
def q_ring_flags(spark, sf_dir):
    closed = rings(spark, sf_dir).withColumn("ring", F.concat("ring", F.slice("ring", 1, 1)))
    return decompose.ring_flags(closed).select("poly_id", F.size("ring").cast("long").alias("n_vertices"), "is_manhattan", "is_rectangle")


#: The pieces follow from how the rings are drawn.
PIECES = (
    "SELECT poly_id, x0 AS xlo, CAST(0 AS BIGINT) AS ylo, x0 + w AS xhi, h AS yhi, shape = 3 AS diagonal FROM v_box WHERE shape IN (0, 3) "
    "UNION ALL SELECT poly_id, x0, 0, x0 + w, h1, false FROM v_box WHERE shape IN (1, 2) "
    "UNION ALL SELECT poly_id, x0, h1, x0 + w1, h, false FROM v_box WHERE shape IN (1, 2) "
    "UNION ALL SELECT poly_id, x0 + w - w1, h1, x0 + w, h, false FROM v_box WHERE shape = 2"
)


@query(f"WITH {ctes('v_box')} {PIECES}")
def q_decompose(spark, sf_dir):
    return decompose.decompose(rings(spark, sf_dir))


@query(RINGS + ", steps AS (SELECT poly_id, x, y, LEAD(x, 1, first_x) OVER w AS nx, LEAD(y, 1, first_y) OVER w AS ny FROM (SELECT *, FIRST_VALUE(x) OVER (PARTITION BY poly_id ORDER BY i) AS first_x, FIRST_VALUE(y) OVER (PARTITION BY poly_id ORDER BY i) AS first_y FROM v_ring) WINDOW w AS (PARTITION BY poly_id ORDER BY i)) SELECT poly_id, CAST(ABS(SUM(x * ny - nx * y)) // 2 AS BIGINT) AS area FROM steps JOIN v_box USING (poly_id) WHERE shape <> 3 GROUP BY poly_id")
def q_decompose_area(spark, sf_dir):
    cut = decompose.decompose(rings(spark, sf_dir)).where("not diagonal")
    return cut.groupBy("poly_id").agg(F.sum((F.col("xhi") - F.col("xlo")) * (F.col("yhi") - F.col("ylo"))).alias("area"))


@query(f"WITH {ctes('v_box')} SELECT CASE shape WHEN 3 THEN 'diagonal' ELSE 'manhattan' END AS kind, CAST(SUM(CASE shape WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 1 END) AS BIGINT) AS n_pieces FROM v_box GROUP BY ALL")
def q_islands(spark, sf_dir):
    return decompose.decompose(rings(spark, sf_dir)).groupBy(F.when(F.col("diagonal"), "diagonal").otherwise("manhattan").alias("kind")).agg(F.count("*").alias("n_pieces"))


@query(RINGS + "SELECT poly_id, MIN(x) AS xlo, MIN(y) AS ylo, MAX(x) AS xhi, MAX(y) AS yhi FROM v_ring GROUP BY poly_id")
def q_ring_boxes(spark, sf_dir):
    return rings(spark, sf_dir).select("poly_id", *ring_box("ring"))


@query(
    "WITH p AS (SELECT p_partkey AS path_id, CAST(10 + p_size % 7 AS BIGINT) // 2 AS half, p_partkey % 3 AS kind, CAST(p_size AS BIGINT) AS s FROM part), e AS (SELECT *, CASE WHEN kind IN (1, 2) THEN half ELSE 0 END AS r FROM p) "
    "SELECT path_id, CAST(0 AS INT) AS i, -r AS xlo, -half AS ylo, 100 + s + r AS xhi, half AS yhi FROM e UNION ALL SELECT path_id, 1, 100 + s - half, -r, 100 + s + half, 50 + s + r FROM e UNION ALL SELECT path_id, 2, 60 - half, 50 + s - half, 100 + s + half, 90 + s + half FROM e"
)
def q_path_rects(spark, sf_dir):
    s = F.col("p_size").cast("long")
    zero = F.lit(0).cast("long")
    pts = F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in ((zero, zero), (100 + s, zero), (100 + s, 50 + s), (zero + 60, 90 + s))))
    paths = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("path_id"), (10 + s % 7).alias("width"), (F.col("p_partkey") % 3).alias("path_type"), pts.alias("pts"))
    return decompose.path_rects(paths)


# -- hierarchy ------------------------------------------------------------------------------------------------------

CELLS = "cells AS (SELECT DISTINCT parent AS cell FROM v_ref UNION SELECT DISTINCT child FROM v_ref WHERE child <> 'cell_3')"


def _cells(refs: DataFrame) -> DataFrame:
    """All cells of the placements; one is missing."""
    return refs.select(F.col("parent").alias("cell")).union(refs.where("child <> 'cell_3'").select("child")).distinct()


@query(f"WITH {ctes('v_ref')}, {CELLS} SELECT cell FROM cells WHERE NOT EXISTS (SELECT 1 FROM v_ref WHERE child = cell)")
def q_top_cells(spark, sf_dir):
    refs = view(spark, sf_dir, "v_ref")
    return hierarchy.pick_top(_cells(refs), refs)


@query(f"WITH {ctes('v_ref')}, {CELLS} SELECT cell FROM cells WHERE EXISTS (SELECT 1 FROM v_ref WHERE child = cell) AND NOT EXISTS (SELECT 1 FROM v_ref WHERE parent = cell) AND EXISTS (SELECT 1 FROM customer WHERE CONCAT('cell_', c_custkey % 5) = cell)")
def q_std_cells(spark, sf_dir):
    refs = view(spark, sf_dir, "v_ref")
    labels = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("cell_"), (F.col("c_custkey") % 5).cast("string")).alias("cell"))
    return hierarchy.leaf_cells(_cells(refs), refs, labels)


@query(f"WITH {ctes('v_ref')}, {CELLS} SELECT DISTINCT child AS cell FROM v_ref WHERE NOT EXISTS (SELECT 1 FROM cells WHERE cell = child)")
def q_missing_refs(spark, sf_dir):
    refs = view(spark, sf_dir, "v_ref")
    return hierarchy.missing_children(_cells(refs), refs)


COPIES = "copies AS (SELECT parent, child, ref_id, c.g AS col, r.g AS \"row\", ox + c.g * dx AS ox, oy + r.g * dy AS oy, angle, mirror, n_rows, n_cols FROM v_ref JOIN range(0, 4) c(g) ON c.g < n_cols JOIN range(0, 4) r(g) ON r.g < n_rows)"


@query(f"WITH {ctes('v_ref')}, {COPIES} SELECT parent, child, ref_id, \"row\", col, ox, oy FROM copies")
def q_array_expand(spark, sf_dir):
    return hierarchy.expand_arrays(view(spark, sf_dir, "v_ref")).select("parent", "child", "ref_id", "row", "col", "ox", "oy")


FLAT = (
    f"WITH RECURSIVE {ctes('v_ref')}, {COPIES}, flat AS (SELECT CAST('' AS VARCHAR) AS path, CAST('top' AS VARCHAR) AS cell, CAST(0 AS INT) AS depth, CAST(0 AS BIGINT) AS ox, CAST(0 AS BIGINT) AS oy, CAST(0 AS BIGINT) AS angle, false AS mirror "
    "UNION ALL SELECT CASE WHEN f.path = '' THEN '' ELSE f.path || '/' END || c.child || '#' || c.ref_id || CASE WHEN n_rows > 1 OR n_cols > 1 THEN '[' || \"row\" || '][' || col || ']' ELSE '' END, c.child, f.depth + 1, "
    "f.ox + CASE f.angle WHEN 0 THEN c.ox WHEN 90 THEN -(CASE WHEN f.mirror THEN -c.oy ELSE c.oy END) WHEN 180 THEN -c.ox ELSE CASE WHEN f.mirror THEN -c.oy ELSE c.oy END END, "
    "f.oy + CASE f.angle WHEN 0 THEN CASE WHEN f.mirror THEN -c.oy ELSE c.oy END WHEN 90 THEN c.ox WHEN 180 THEN -(CASE WHEN f.mirror THEN -c.oy ELSE c.oy END) ELSE -c.ox END, "
    "(f.angle + CASE WHEN f.mirror THEN -c.angle ELSE c.angle END + 720) % 360, f.mirror <> c.mirror FROM flat f JOIN copies c ON c.parent = f.cell) "
)


@query(FLAT + "SELECT path, cell, depth, ox, oy, angle, mirror FROM flat WHERE depth > 0")
def q_flatten(spark, sf_dir):
    return hierarchy.flatten(view(spark, sf_dir, "v_ref"), "top")


@query(FLAT + "SELECT cell, MIN(ox) AS xlo, MIN(oy) AS ylo, MAX(ox) AS xhi, MAX(oy) AS yhi, COUNT(*) AS n FROM flat WHERE depth > 0 GROUP BY cell")
def q_instance_boxes(spark, sf_dir):
    flat = hierarchy.flatten(view(spark, sf_dir, "v_ref"), "top").select("cell", F.col("ox").alias("xlo"), F.col("oy").alias("ylo"), F.col("ox").alias("xhi"), F.col("oy").alias("yhi"))
    return flat.groupBy("cell").agg(*bounding_box(), F.count("*").alias("n"))


@query(
    "WITH p AS (SELECT p_partkey AS id, CAST(p_partkey * 3 - p_size AS BIGINT) AS x, CAST(p_size * 7 - p_partkey AS BIGINT) AS y, p_partkey % 4 AS q, p_partkey % 8 >= 4 AS m FROM part), f AS (SELECT *, CASE WHEN m THEN -y ELSE y END AS my FROM p) "
    "SELECT id, 1000 + CASE q WHEN 0 THEN x WHEN 1 THEN -my WHEN 2 THEN -x ELSE my END AS px, -500 + CASE q WHEN 0 THEN my WHEN 1 THEN x WHEN 2 THEN -my ELSE -x END AS py FROM f"
)
def q_transform8(spark, sf_dir):
    p = F.col("p_partkey")
    size = F.col("p_size").cast("long")
    px, py = place(p * 3 - size, size * 7 - p, F.lit(1000).cast("long"), F.lit(-500).cast("long"), p % 4 * 90, p % 8 >= 4)
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(p.alias("id"), px.alias("px"), py.alias("py"))


# -- classification and inspection ----------------------------------------------------------------------------------

_NAMES = "CASE {0} WHEN 67 THEN 'li1' WHEN 68 THEN 'met1' WHEN 69 THEN 'met2' WHEN 70 THEN 'met3' WHEN 71 THEN 'met4' WHEN 72 THEN 'met5' END"
_CUTS = "CASE {0} WHEN 67 THEN 'mcon' WHEN 68 THEN 'via' WHEN 69 THEN 'via2' WHEN 70 THEN 'via3' WHEN 71 THEN 'via4' END"
ROLE = "CASE datatype WHEN 20 THEN 'drawing' WHEN 16 THEN 'pin' WHEN 5 THEN 'label' WHEN 44 THEN CASE WHEN layer < 72 THEN 'cut' END END"
NAME = f"CASE WHEN datatype = 44 THEN {_CUTS.format('layer')} ELSE {_NAMES.format('layer')} END"


@query(f"WITH {ctes('v_layer')} SELECT poly_id, {ROLE} AS role, CASE WHEN {ROLE} IS NOT NULL THEN CAST(layer - 67 AS INT) END AS level, {NAME} AS name FROM v_layer")
def q_classify_layers(spark, sf_dir):
    return classify.classified(view(spark, sf_dir, "v_layer")).select("poly_id", "role", "level", "name")


@query(f"WITH {ctes('v_layer')} SELECT {NAME} AS name, COUNT(*) AS n FROM v_layer WHERE {ROLE} <> 'label' GROUP BY ALL")
def q_conductor_shapes(spark, sf_dir):
    return classify.conductor_shapes(view(spark, sf_dir, "v_layer")).groupBy("name").agg(F.count("*").alias("n"))


@query(f"WITH {ctes('v_layer')} SELECT layer, datatype, COUNT(*) AS n, {ROLE} AS role, {NAME} AS name FROM v_layer GROUP BY layer, datatype")
def q_layer_hist(spark, sf_dir):
    return inspect.layer_histogram(view(spark, sf_dir, "v_layer"))


@query(f"WITH {ctes('v_ref')} SELECT child, CAST(SUM(n_rows * n_cols) AS BIGINT) AS n FROM v_ref GROUP BY child")
def q_ref_hist(spark, sf_dir):
    return inspect.reference_histogram(view(spark, sf_dir, "v_ref"))


@query(f"WITH {ctes('v_layer')} SELECT cell, COUNT(*) AS n, string_agg(DISTINCT CAST(size AS VARCHAR), ' ' ORDER BY CAST(size AS VARCHAR)) AS names FROM v_layer GROUP BY cell")
def q_labels_per_cell(spark, sf_dir):
    return inspect.labels_per_cell(view(spark, sf_dir, "v_layer").select("cell", F.col("size").cast("string").alias("value")))


@query("SELECT 'cuts' AS kind, (SELECT COUNT(*) FROM customer) AS n UNION ALL SELECT 'references', (SELECT COUNT(*) FROM region) + (SELECT COUNT(*) FROM nation) + (SELECT COUNT(*) FROM customer) UNION ALL SELECT 'rects', (SELECT COUNT(*) FROM orders)")
def q_element_totals(spark, sf_dir):
    return inspect.element_totals(cuts=view(spark, sf_dir, "v_cut"), references=view(spark, sf_dir, "v_ref"), rects=_rects(spark, sf_dir))


_ABUT = "boxes AS (SELECT 'cell_' || (p_partkey % 6) AS cell, MIN(p_partkey % 50) AS xlo, MIN(p_size) AS ylo, MAX(p_partkey % 50 + 40) AS xhi, MAX(p_size + 30) AS yhi FROM part WHERE p_partkey % 9 = 4 GROUP BY 1)"


@query(
    f"WITH {_ABUT}, p AS (SELECT c_custkey AS inst_id, 'cell_' || (c_custkey % 7) AS cell, c_custkey * 10 AS ox, c_custkey * 3 AS oy, c_custkey % 2 = 1 AS m FROM customer) "
    "SELECT inst_id, p.cell, COALESCE(ox + xlo, ox) AS p_xlo, COALESCE(oy + CASE WHEN m THEN -yhi ELSE ylo END, oy) AS p_ylo, COALESCE(ox + xhi, ox + 1) AS p_xhi, COALESCE(oy + CASE WHEN m THEN -ylo ELSE yhi END, oy + 1) AS p_yhi FROM p LEFT JOIN boxes USING (cell)"
)
def q_abutment(spark, sf_dir):
    part, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "customer"))
    key = F.col("p_partkey")
    shapes = part.select(
        F.concat(F.lit("cell_"), (key % 6).cast("string")).alias("cell"), F.when(key % 9 == 4, 81).otherwise(67).alias("layer"), F.lit(4).alias("datatype"),
        (key % 50).alias("xlo"), F.col("p_size").cast("long").alias("ylo"), (key % 50 + 40).alias("xhi"), (F.col("p_size") + 30).cast("long").alias("yhi"),
    )
    c = F.col("c_custkey")
    placed = customer.select(c.alias("inst_id"), F.concat(F.lit("cell_"), (c % 7).cast("string")).alias("cell"), (c * 10).alias("ox"), (c * 3).alias("oy"), F.lit(0).cast("long").alias("angle"), (c % 2 == 1).alias("mirror"), *(x.alias(f"f_{n}") for n, x in zip(RECT, (c * 10, c * 3, c * 10 + 1, c * 3 + 1), strict=True)))
    return classify.placed_boxes(placed, classify.abutment_boxes(shapes))


# -- pictures -------------------------------------------------------------------------------------------------------


@query(f"WITH {ctes('v_rect')} SELECT rect_id, level, xlo, ylo, xhi, yhi FROM v_rect WHERE level <= 2 AND xlo <= 20000 AND xhi >= 10000 AND ylo <= 15000 AND yhi >= 5000")
def q_svg_clip(spark, sf_dir):
    return spatial.in_window(_rects(spark, sf_dir), 10000, 5000, 20000, 15000, 2)


_VIEW = f"WITH {ctes('v_rect')}, v AS (SELECT MIN(xlo) AS xlo, MIN(ylo) AS ylo, MAX(xhi) AS xhi, MAX(yhi) AS yhi FROM v_rect)"


@query(_VIEW + " SELECT *, CAST(1600 AS INT) AS width_px, CAST(greatest(round(greatest(yhi - ylo, 1) * 1600.0::DOUBLE / greatest(xhi - xlo, 1)), 1) AS BIGINT) AS height_px FROM v")
def q_svg_viewport(spark, sf_dir):
    return render.viewport(_rects(spark, sf_dir))


def _hsv(net: str, level: str) -> str:
    """The colour of a net on a level: hue by the golden angle, saturation 0.68, value 0.95 and 0.06 less for each level."""
    c, x, m = "(v * 0.68::DOUBLE)", "(v * 0.68::DOUBLE * (1 - abs(h / 60.0::DOUBLE % 2 - 1)))", "(v - v * 0.68::DOUBLE)"
    part = lambda full, ramp: f"CAST(round((CASE WHEN CAST(floor(h / 60.0::DOUBLE) AS INT) IN {full} THEN {c} WHEN CAST(floor(h / 60.0::DOUBLE) AS INT) IN {ramp} THEN {x} ELSE 0 END + {m}) * 255) AS INT)"
    made = f"printf('#%02x%02x%02x', {part((0, 5), (1, 4))}, {part((1, 2), (0, 3))}, {part((3, 4), (2, 5))})"
    return f"(SELECT {made} FROM (SELECT CAST({net} * 13750776405::HUGEINT % 36000000000 AS DOUBLE) / 100000000 AS h, 0.95::DOUBLE - 0.06::DOUBLE * {level} AS v))"


_LAYER = "list_extract(['#c0392b', '#2e86c1', '#28b463', '#f39c12', '#8e44ad', '#16a085'], level + 1)"


@query(f"WITH {ctes('v_rect')} SELECT rect_id, {_hsv('rect_id', 'level')} AS by_net, {_LAYER} AS by_layer FROM v_rect")
def q_svg_colour(spark, sf_dir):
    rects = _rects(spark, sf_dir).withColumn("net", F.col("rect_id"))
    both = render.colours(render.colours(rects).withColumnRenamed("colour", "by_net"), by="layer")
    return both.select("rect_id", "by_net", F.col("colour").alias("by_layer"))


@query(
    f"WITH {ctes('v_rect')}, r AS (SELECT *, rect_id % 100 AS net, rect_id % 3 = 0 AS supply FROM v_rect) SELECT rect_id, CASE WHEN net = 7 THEN '#d62828' ELSE '#e8ebee' END AS highlighted, "
    f"CASE WHEN net % 10 = 9 THEN '#d5d8dc' WHEN supply THEN '#e4e7ea' ELSE {_hsv('net', 'level')} END AS dimmed FROM r"
)
def q_svg_highlight(spark, sf_dir):
    """One net in colour, all else grey; or supplies dimmed, and metal of no net."""
    rects = _rects(spark, sf_dir).withColumn("net", F.col("rect_id") % 100).withColumn("kind", F.when(F.col("rect_id") % 3 == 0, "power").otherwise("signal"))
    both = render.colours(rects, highlight=7).withColumnRenamed("colour", "highlighted").withColumn("net", F.when(F.col("net") % 10 != 9, F.col("net")))
    return render.colours(both, dim_power=True).select("rect_id", "highlighted", F.col("colour").alias("dimmed"))


_PX = "1600::DOUBLE / (20000 - 10000)"


@query(
    f"WITH {ctes('v_rect')}, r AS (SELECT * FROM v_rect WHERE level <= 2 AND xlo <= 20000 AND xhi >= 10000 AND ylo <= 15000 AND yhi >= 5000) "
    f"SELECT CAST(level AS VARCHAR) AS grp, printf('<rect x=\"%.2f\" y=\"%.2f\" width=\"%.2f\" height=\"%.2f\" fill=\"%s\" stroke=\"#333\" stroke-width=\"%.2f\"/>', (xlo - 10000) * ({_PX}), (15000 - yhi) * ({_PX}), (xhi - xlo) * ({_PX}), (yhi - ylo) * ({_PX}), {_LAYER}, 5 * ({_PX})) AS text FROM r "
    "UNION ALL SELECT CAST(level AS VARCHAR), printf('<g id=\"%s\">', list_extract(['li1', 'met1', 'met2'], level + 1)) FROM r GROUP BY level UNION ALL SELECT CAST(level AS VARCHAR), '</g>' FROM r GROUP BY level "
    f"UNION ALL SELECT '', printf('<rect x=\"%.2f\" y=\"%.2f\" width=\"%.2f\" height=\"%.2f\"/>', (xlo - 10000) * ({_PX}), (15000 - yhi) * ({_PX}), (xhi - xlo) * ({_PX}), (yhi - ylo) * ({_PX})) FROM v_rect WHERE rect_id % 9 = 0 AND xlo <= 20000 AND xhi >= 10000 AND ylo <= 15000 AND yhi >= 5000 "
    "UNION ALL SELECT '', unnest(['<svg xmlns=\"http://www.w3.org/2000/svg\" width=\"1600\" height=\"1600\" viewBox=\"0 0 1600 1600\">', '<rect width=\"100%\" height=\"100%\" fill=\"#ffffff\"/>', '<g fill=\"none\" stroke=\"#b9c2cc\" stroke-width=\"0.7\">', '</g>', '</svg>'])"
)
def q_svg_picture(spark, sf_dir):
    """Every line of a clipped picture with outlined instances and strokes, with its level's group."""
    rects = _rects(spark, sf_dir).withColumn("net", F.col("rect_id"))
    lines = render.to_svg(rects, by="layer", clip=(10000, 5000, 20000, 15000), max_level=2, instances=rects.where("rect_id % 9 = 0").select("xlo", "ylo", "xhi", "yhi"), stroke=5.0)
    return lines.select(F.when(F.col("part") == 5, F.substring("key", 1, 4).cast("int").cast("string")).otherwise("").alias("grp"), "text")
