"""Bridge views: the driver's tables read as rectangles, cuts, labels, rings, placements, layers, gates, pins and waves.

A view is one SQL text for both engines, in integers only; {div} is the engine's truncating division. The views are inputs;
the operators over them are written twice, as DataFrames and as DuckDB SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netframe.operators.components import dealt, parts_for

#: Side of the square in which rectangles lie.
SPAN = 40_000

VIEWS: dict[str, tuple[str, str]] = {
    "v_rect": (
        "orders",
        f"SELECT o_orderkey AS rect_id, CAST(o_orderkey % 4 AS INT) AS level, (o_orderkey * 7919) % {SPAN} AS xlo, (o_custkey * 104729 + o_orderkey * 31) % {SPAN} AS ylo, "
        f"(o_orderkey * 7919) % {SPAN} + 20 + o_orderkey % 181 AS xhi, (o_custkey * 104729 + o_orderkey * 31) % {SPAN} + 20 + o_custkey % 61 AS yhi FROM orders",
    ),
    "v_cut": (
        "customer",
        f"SELECT c_custkey AS cut_id, CAST(c_custkey % 3 AS INT) AS lower, (c_custkey * 6113) % {SPAN} AS xlo, (c_custkey * 2741 + 17) % {SPAN} AS ylo, "
        f"(c_custkey * 6113) % {SPAN} + 100 + c_custkey % 400 AS xhi, (c_custkey * 2741 + 17) % {SPAN} + 100 + c_custkey % 300 AS yhi FROM customer",
    ),
    "v_label": (
        "part orders",
        f"SELECT p_partkey AS text_id, CAST(p_partkey % 4 AS INT) AS level, (p_partkey * 7919) % {SPAN} + 10 AS x, (p_partkey * 3571 + p_size * 13) % {SPAN} AS y, p_brand AS value FROM part "
        f"UNION ALL SELECT 1000000 + o_orderkey, CAST(o_orderkey % 4 AS INT), (o_orderkey * 7919) % {SPAN} + 5 + o_orderkey % 7, (o_custkey * 104729 + o_orderkey * 31) % {SPAN} + 3, o_orderpriority FROM orders WHERE o_orderkey % 5 = 0",
    ),
    "v_box": (  # sizes of the rings that v_ring draws
        "part",
        "SELECT p_partkey AS poly_id, CAST(p_partkey % 4 AS INT) AS shape, p_partkey * 500 AS x0, CAST(40 + 4 * p_size AS BIGINT) AS w, CAST(40 + 3 * p_size AS BIGINT) AS h, "
        "CAST((40 + 4 * p_size) {div} 3 AS BIGINT) AS w1, CAST((40 + 3 * p_size) {div} 4 AS BIGINT) AS h1 FROM part",
    ),
    "v_layer": ("part", "SELECT p_partkey AS poly_id, CAST(67 + p_size % 6 AS INT) AS layer, CAST(CASE p_partkey % 4 WHEN 0 THEN 20 WHEN 1 THEN 16 WHEN 2 THEN 5 ELSE 44 END AS INT) AS datatype, p_brand AS cell, p_size AS size FROM part"),
    "v_gate": (
        "lineitem",
        "SELECT CASE CAST(l_quantity AS BIGINT) % 3 WHEN 0 THEN false WHEN 1 THEN true END AS b0, CASE l_linenumber % 3 WHEN 0 THEN false WHEN 1 THEN true END AS b1, "
        "CASE l_partkey % 3 WHEN 0 THEN false WHEN 1 THEN true END AS b2, CASE l_suppkey % 3 WHEN 0 THEN false WHEN 1 THEN true END AS b3, "
        "CASE l_orderkey % 3 WHEN 0 THEN false WHEN 1 THEN true END AS b4, CASE (l_partkey + l_linenumber) % 5 WHEN 0 THEN NULL WHEN 1 THEN true WHEN 3 THEN true ELSE false END AS b5 FROM lineitem",
    ),
    "v_pin": (
        "lineitem orders",
        "SELECT l_orderkey AS inst_id, o_orderpriority AS cell, l_linenumber AS pin, MIN(l_suppkey) AS net_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey, o_orderpriority, l_linenumber",
    ),
    "v_ref": (  # region > nation > customer: three levels of placements
        "region nation customer",
        "SELECT 'top' AS parent, CONCAT('region_', r_regionkey) AS child, CAST(r_regionkey AS BIGINT) AS ref_id, CAST(r_regionkey * 1000000 AS BIGINT) AS ox, CAST(r_regionkey * 700 AS BIGINT) AS oy, CAST(90 * (r_regionkey % 4) AS BIGINT) AS angle, r_regionkey % 2 = 1 AS mirror, CAST(1 AS BIGINT) AS n_cols, CAST(1 AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS dx, CAST(0 AS BIGINT) AS dy FROM region "
        "UNION ALL SELECT CONCAT('region_', n_regionkey), CONCAT('nation_', n_nationkey), CAST(n_nationkey AS BIGINT), CAST(n_nationkey * 10000 AS BIGINT), CAST(n_nationkey * 30 AS BIGINT), CAST(90 * ((n_nationkey + 1) % 4) AS BIGINT), n_nationkey % 3 = 1, CAST(1 + n_nationkey % 2 AS BIGINT), CAST(1 + n_nationkey % 3 AS BIGINT), CAST(333 AS BIGINT), CAST(444 AS BIGINT) FROM nation "
        "UNION ALL SELECT CONCAT('nation_', c_nationkey), CONCAT('cell_', c_custkey % 7), c_custkey, c_custkey * 10, c_custkey * 3, 90 * (c_custkey % 4), c_custkey % 2 = 1, CAST(1 AS BIGINT), CAST(1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM customer",
    ),
    "v_wave": (
        "events",
        "SELECT event_id, event_id {div} 3 AS t, event_type AS signal, CASE WHEN (event_id * 7 + user_id) % 5 = 0 THEN NULL ELSE (event_id * 7 + user_id) {div} 2 % 2 END AS value FROM events",
    ),
    "v_bits": ("events", "SELECT user_id, event_id, CAST((event_id * 11 + user_id) {div} 4 % 2 AS INT) AS bit FROM events"),
    "v_left": ("orders", "SELECT o_orderkey AS inst_id, CAST(o_orderkey % 5 AS INT) AS cell, o_custkey AS net_a, (o_orderkey * 7) % 997 AS net_b FROM orders WHERE o_orderkey % 3 = 0"),
}


#: Keys by which a view's tables are joined: all that follows for a key is one task's, a bounded part of the view.
KEYS = {"v_pin": {"lineitem": "l_orderkey", "orders": "o_orderkey"}}


def ring_sql() -> str:
    """DuckDB text of v_ring: the vertices of each ring, numbered."""
    shapes = {
        0: "[[0, 0], [w, 0], [w, h], [0, h]]",
        1: "[[0, 0], [w, 0], [w, h1], [w1, h1], [w1, h], [0, h]]",
        2: "[[0, 0], [w, 0], [w, h], [w - w1, h], [w - w1, h1], [w1, h1], [w1, h], [0, h]]",
        3: "[[0, 0], [w, 0], [0, h]]",
    }
    cases = " ".join(f"WHEN {k} THEN {v}" for k, v in shapes.items())
    return f"SELECT poly_id, unnest(range(0, len(ring))) AS i, x0 + unnest(ring)[1] AS x, unnest(ring)[2] AS y FROM (SELECT *, CASE shape {cases} END AS ring FROM v_box)"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables, text = VIEWS[name]
    return _sql(spark, sf_dir, tables.split(), text.format(div="div"), KEYS.get(name, {}))


def _sql(spark: SparkSession, sf_dir: str, tables: list[str], text: str, keys: dict[str, str]) -> DataFrame:
    """text over the tables, without registering anything in the session. Tables with a key are dealt by it, all in as many parts as their rows together ask for."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    if keys:
        parts = parts_for(spark, sum(frames[t].count() for t in keys))
        frames |= {t: dealt(frames[t], k, parts=parts) for t, k in keys.items()}
    return spark.sql(re.sub(rf"\b(FROM|JOIN) ({'|'.join(tables)})\b", r"\1 {\2}", text), **frames)


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(poly_id, ring): v_box drawn."""
    w, h, w1, h1, zero = F.col("w"), F.col("h"), F.col("w1"), F.col("h1"), F.lit(0).cast("long")
    points = {
        0: [(zero, zero), (w, zero), (w, h), (zero, h)],
        1: [(zero, zero), (w, zero), (w, h1), (w1, h1), (w1, h), (zero, h)],
        2: [(zero, zero), (w, zero), (w, h), (w - w1, h), (w - w1, h1), (w1, h1), (w1, h), (zero, h)],
        3: [(zero, zero), (w, zero), (zero, h)],
    }
    ring = None
    for k, own in points.items():
        drawn = F.array(*(F.struct((F.col("x0") + x).alias("x"), y.alias("y")) for x, y in own))
        ring = F.when(F.col("shape") == k, drawn) if ring is None else ring.when(F.col("shape") == k, drawn)
    return view(spark, sf_dir, "v_box").select("poly_id", "shape", "x0", "w", "h", "w1", "h1", ring.alias("ring"))


def ctes(*names: str) -> str:
    """DuckDB common table expressions of views (v_ring brings v_box along)."""
    out = []
    for name in names:
        if name == "v_ring":
            out += [f"v_box AS ({VIEWS['v_box'][1].format(div='//')})", f"v_ring AS ({ring_sql()})"]
        else:
            out.append(f"{name} AS ({VIEWS[name][1].format(div='//')})")
    return ", ".join(out)
