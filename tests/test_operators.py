"""Geometry, components, cells, circuits and comparison on small cases."""

import inspect
import itertools
import math
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from netframe.functions import cells, geometry, text
from netframe.operators import compare, components, decompose, graphs, hierarchy, netlist, nets, render, scoring, spatial, squares, waves
from netframe.plans import netlist_queries
from netframe.plans.bridge import view
from netframe.plans.netlist_queries import _by_name


def ring(*points):
    return [{"x": x, "y": y} for x, y in points]


RING = "poly_id long, ring array<struct<x:long,y:long>>"


def test_components_of_chains_and_stars(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(100)] + [(1000, k) for k in range(1001, 1050)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)] + [(7, 7), (None, 3)]
    part = {}

    def find(x):
        while part.setdefault(x, x) != x:
            x = part[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            part[y] = x
    out = components.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in out.collect()} == {n: find(n) for n in part}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_touch_and_overlap(spark):
    rects = spark.createDataFrame([(1, 0, 0, 0, 10, 10), (2, 0, 10, 10, 20, 20), (3, 0, 21, 0, 30, 10), (4, 1, 0, 0, 10, 10), (5, 0, -3000, -3000, 5000, 5000), (6, 1, 10, 0, 20, 10)], "rect_id long, level int, xlo long, ylo long, xhi long, yhi long")
    assert {tuple(r) for r in spatial.touch_pairs(rects, 1).collect()} == {(1, 2), (1, 5), (2, 5), (3, 5), (4, 6)}
    cuts = spark.createDataFrame([(1, 0, 5, 5, 15, 15), (2, 0, 10, 0, 12, 5), (3, 1, 0, 0, 1, 1), (4, 0, 30, 0, 31, 1)], "cut_id long, lower int, xlo long, ylo long, xhi long, yhi long")
    hits = spatial.cut_hits(cuts, rects, 2)
    assert {tuple(r) for r in hits.collect()} == {(1, 1), (1, 2), (1, 4), (1, 5), (1, 6), (2, 5), (2, 6), (4, 5)}
    assert {tuple(r) for r in spatial.cut_edges(hits).collect()} == {(1, 2), (1, 4), (1, 5), (1, 6), (5, 6)}
    points = spark.createDataFrame([(1, 0, 10, 10), (2, 1, 99, 99)], "text_id long, level int, x long, y long")
    assert {(r.text_id, r.rect_id) for r in spatial.point_hits(points, rects).collect()} == {(1, 1), (1, 2), (1, 5), (2, None)}


def sizes(seed, n):
    """Rectangles of all sizes, one across the chip, and a third of all in one place: some in a pile, the others side by side."""
    made = random.Random(seed)
    rows = []
    for k in range(n):
        w, h = (made.choice([0, 1, 7, 60, 64, 65, 500, 4000]) for _ in "wh")
        x, y = made.randrange(-30_000, 30_000), made.randrange(-30_000, 30_000)
        if k % 3 == 0:
            x, y, w, h = (5, 5, 20, 20) if k % 6 == 0 and k < n // 3 else (100 + 3 * (k % 40), 100 + 3 * (k // 40), 2, 2)
        rows.append((k, k % 2, x, y, x + w, y + h))
    return [*rows, (n, 0, -10**9, 50, 10**9, 60), (n + 1, 1, 7, -10**9, 7, 10**9), (n + 2, 0, -(10**12), -(10**12), -(10**12), -(10**12))]


def test_touching_whatever_the_size(spark):
    rows = sizes(4, 900)
    rects = spark.createDataFrame(rows, "rect_id long, level int, xlo long, ylo long, xhi long, yhi long")
    near = lambda a, b: a[2] <= b[4] and b[2] <= a[4] and a[3] <= b[5] and b[3] <= a[5]
    over = lambda a, b: a[2] < b[4] and b[2] < a[4] and a[3] < b[5] and b[3] < a[5]
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and near(a, b))
    for dense in (spatial.DENSE, 5):
        assert sorted(tuple(r) for r in spatial.touch_pairs(rects, dense).collect()) == want
    cuts = [(k, 0, *r[2:]) for k, r in enumerate(sizes(9, 200))]
    hits = spatial.cut_hits(spark.createDataFrame(cuts, "cut_id long, lower int, xlo long, ylo long, xhi long, yhi long"), rects, 2)
    assert sorted(tuple(r) for r in hits.collect()) == sorted((c[0], r[0]) for c in cuts for r in rows if over((*c[:2], *c[2:]), r))
    points = [(k, k % 2, r[2], r[3]) for k, r in enumerate(sizes(11, 200))]
    found = spatial.point_hits(spark.createDataFrame(points, "text_id long, level int, x long, y long"), rects)
    hit = {p[0]: [r[0] for r in rows if r[1] == p[1] and r[2] <= p[2] <= r[4] and r[3] <= p[3] <= r[5]] for p in points}
    assert sorted(((r.text_id, r.rect_id) for r in found.collect()), key=str) == sorted(((k, r) for k, v in hit.items() for r in v or [None]), key=str)
    listed = spatial.listed(rects).count() + spatial.looking(rects, spatial.classes_of(rects)).count()
    assert listed < len(rows) * (4 + 4 + 2 * len(spatial.classes_of(rects)))  # a rail across the chip is no row for each of a million cells


def test_empty_layers(spark):
    none = spark.createDataFrame([], "rect_id long, level int, xlo long, ylo long, xhi long, yhi long")
    one = spark.createDataFrame([(1, 0, 5, 5)], "text_id long, level int, x long, y long")
    assert spatial.touch_pairs(none).count() == 0
    assert [(r.text_id, r.rect_id) for r in spatial.point_hits(one, none).collect()] == [(1, None)]


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=60))
def test_roots(edges):
    part = {}

    def find(x):
        while part.setdefault(x, x) != x:
            x = part[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        part[y] = x
    node, root, size = components.roots(*(np.array(x) for x in zip(*edges, strict=True)))
    assert dict(zip(node.tolist(), root.tolist(), strict=True)) == {n: find(n) for n in part}
    assert size.tolist() == [sum(find(m) == find(n) for m in part) for n in node.tolist()]


def test_contracted_components(spark, monkeypatch):
    """A hub with a third of all edges, a long chain and pairs: as by rounds, and the hub is one row of each tree."""
    made = random.Random(6)
    edges = [(7, 1000 + k) for k in range(2000)] + [(10_000 + k, 10_001 + k) for k in range(2000)] + [(20_000 + 2 * k, 20_001 + 2 * k) for k in range(1990)] + [(5000, 7), (7, 7), (None, 3), (12, None), (12_000, 2999)]
    made.shuffle(edges)
    table = spark.createDataFrame(edges, "a long, b long").repartition(6)
    want = {r.node: r.component for r in components.connected_components(table).collect()}
    assert want[2500] == 7 and want[11_999] == 7
    for frame in (components.contracted_components(table), components.contracted_components(table, F.col("a").alias("place"))):
        rows = frame.collect()
        assert len(rows) == len(want) and {r.node: r.component for r in rows} == want
    trees = table.where("a <> b").mapInArrow(components._trees, "node long, root long, large boolean")
    assert trees.where("node = 7").count() <= 6
    assert components.contracted_components(table.limit(0)).count() == 0


def test_large_trees_look_up_in_parts(spark):
    """Roots of large trees have their component once for each salt, so that the nodes of one tree are no task's alone."""
    edges = spark.range(30_000).select(F.lit(5).alias("a"), (F.col("id") + 10).alias("b")).repartition(3).unionByName(spark.createDataFrame([(2, 29_000)], "a long, b long"))
    out = components.contracted_components(edges)
    assert out.agg(F.count("*"), F.min("component"), F.max("component")).first()[:] == (30_002, 2, 2)


def plain_cut(points):
    """The definition, slab by slab."""
    edges = list(zip(points, points[1:] + points[:1], strict=True))
    ys, out = sorted({y for _, y in points}), []
    for lo, hi in zip(ys, ys[1:], strict=False):
        xs = sorted(a[0] for a, b in edges if a[0] == b[0] and min(a[1], b[1]) <= lo and max(a[1], b[1]) >= hi)
        spans = [(a, b) for a, b in zip(xs[::2], xs[1::2], strict=False) if b > a]
        if out and out[-1][2] == spans and out[-1][1] == lo:
            out[-1] = (out[-1][0], hi, spans)
        else:
            out.append((lo, hi, spans))
    return [(a, lo, b, hi) for lo, hi, spans in out for a, b in spans]


def staircase(n, up=7):
    """A ring of about 2 n vertices: n steps up, and straight back."""
    steps = [p for k in range(n) for p in ((5 * k, up * k), (5 * k + 5, up * k))]
    return [*steps, (5 * n, up * n), (-3, up * n), (-3, 0)]


def comb(n):
    """Teeth of three lengths."""
    teeth = [p for k in range(n) for p in ((4 * k, 10 + k % 3), (4 * k + 2, 10 + k % 3), (4 * k + 2, 2), (4 * k + 4, 2))]
    return [(0, 0), *teeth, (4 * n, 0)]


@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=2, max_size=12))
def test_sweep_of_any_ring(corners):
    """Rings in right angles through any corners, crossing and touching themselves: as by definition."""
    points = [p for (x0, y0), (x1, _) in zip(corners, corners[1:] + corners[:1], strict=True) for p in ((x0, y0), (x1, y0))]
    x, y = (np.array(v) for v in zip(*points, strict=True))
    assert decompose.sweep(x, y) == plain_cut(points)


def test_rings_of_many_vertices(spark, monkeypatch):
    """Rings of 20,000 vertices take a sweep, and small ones give the same rectangles by either way."""
    began = time.time()
    big = staircase(10_000)
    x, y = (np.array(v) for v in zip(*big, strict=True))
    assert len(decompose.sweep(x, y)) == 10_000 and time.time() - began < 10
    rows = [((k, "a"), ring(*f(n))) for k, (f, n) in enumerate([(staircase, 5), (comb, 3), (comb, 40), (staircase, 300), (comb, 1)])]
    polygons = spark.createDataFrame(rows, "poly_id struct<k:int,s:string>, ring array<struct<x:long,y:long>>")
    want = sorted((k, *r) for k, (f, n) in enumerate([(staircase, 5), (comb, 3), (comb, 40), (staircase, 300), (comb, 1)]) for r in plain_cut(f(n)))
    for limit in (decompose.SMALL_RING, 0):
        monkeypatch.setattr(decompose, "SMALL_RING", limit)
        assert sorted((r.poly_id.k, r.xlo, r.ylo, r.xhi, r.yhi) for r in decompose.decompose(polygons).where("NOT diagonal").collect()) == want


def test_decompose(spark):
    polygons = [
        (1, ring((0, 0), (100, 0), (100, 50), (0, 50), (0, 0), (0, 0))),
        (2, ring((0, 0), (100, 0), (100, 40), (40, 40), (40, 100), (0, 100))),
        (3, ring((0, 0), (100, 0), (50, 90))),
        (4, ring((0, 0), (1, 1))),
        (5, ring((0, 0), (50, 0), (100, 0), (100, 50), (100, 100), (0, 100), (0, 50))),
        (6, []),
        (7, ring((0, 0), (100, 0), (100, 100), (70, 100), (70, 20), (30, 20), (30, 100), (0, 100))),
    ]
    out = {}
    for r in decompose.decompose(spark.createDataFrame(polygons, RING)).collect():
        out.setdefault(r.poly_id, []).append((r.xlo, r.ylo, r.xhi, r.yhi, r.diagonal))
    area = lambda k: sum((c - a) * (d - b) for a, b, c, d, _ in out[k])
    assert out[1] == [(0, 0, 100, 50, False)] and out[3] == [(0, 0, 100, 90, True)] and out[5] == [(0, 0, 100, 100, False)]
    assert area(2) == 6400 and area(7) == 100 * 20 + 2 * 30 * 80 and len(out[7]) == 3 and set(out) == {1, 2, 3, 5, 7}
    flags = {r.poly_id: (r.is_manhattan, r.is_rectangle) for r in decompose.ring_flags(spark.createDataFrame(polygons, RING)).collect()}
    assert flags[1] == (True, True) and flags[2] == (True, False) and flags[3] == (False, False)


def test_placements(spark):
    rng = random.Random(2)
    kinds = "x long, y long, ox long, oy long, angle long, mirror boolean"
    rows = [(rng.randint(-50, 50), rng.randint(-50, 50), rng.randint(-9, 9), rng.randint(-9, 9), 90 * rng.randrange(4), rng.random() < 0.5) for _ in range(60)]
    outer = (100, -7, 270, True)
    df = spark.createDataFrame(rows, kinds)
    at = {c: F.col(c) for c in ("ox", "oy", "angle", "mirror")}
    top = dict(zip(at, (F.lit(outer[0]).cast("long"), F.lit(outer[1]).cast("long"), F.lit(outer[2]).cast("long"), F.lit(outer[3])), strict=True))
    x, y = geometry.place(F.col("x"), F.col("y"), **at)
    twice = geometry.place(x, y, **top)
    once = geometry.place(F.col("x"), F.col("y"), **geometry.compose(top, at))
    assert df.where((twice[0] != once[0]) | (twice[1] != once[1])).count() == 0
    odd = spark.createDataFrame([(10, 0, 0, 0, 45, False), (1, 0, 0, 0, 60, False)], kinds).select(*geometry.place(F.col("x"), F.col("y"), **at)).collect()
    assert [tuple(r) for r in odd] == [(7, 7), (1, 1)]


def test_hierarchy_loops_are_errors(spark):
    refs = spark.createDataFrame([("top", "a", 1), ("a", "b", 2), ("b", "a", 3)], "parent string, child string, ref_id long")
    refs = refs.select("*", *(F.lit(v).cast("long").alias(c) for c, v in (("ox", 0), ("oy", 0), ("angle", 0), ("n_cols", 1), ("n_rows", 1), ("dx", 0), ("dy", 0))), F.lit(False).alias("mirror"))
    with pytest.raises(Exception, match="places itself"):
        hierarchy.flatten(refs, "top").collect()
    cells = spark.createDataFrame([("x",), ("y",)], "cell string")
    with pytest.raises(Exception, match="top cells found: 2"):
        hierarchy.pick_top(cells, refs).collect()


def test_cell_functions(spark):
    """All functions over all inputs of three values, against what their names say."""
    value = {None: 1, True: 2, False: 0}
    for _, name, inputs, output, _ in cells.functions():
        if name == "conb":
            continue
        rows = list(itertools.product((False, True, None), repeat=len(inputs)))
        df = spark.createDataFrame(rows, ", ".join(f"b{k} boolean" for k in range(len(inputs))))
        got = [r[0] for r in df.coalesce(1).select(F.expr(cells.expression(name, {p: f"b{k}" for k, p in enumerate(inputs)}, output))).collect()]
        scope = {"GREATEST": max, "LEAST": min}
        if name == "maj3":
            want = [sorted(value[v] for v in row)[1] for row in rows]
        else:
            want = [eval(_by_name(name), scope, {f"v{k}": value[v] for k, v in enumerate(row)}) for row in rows]
        assert [value[g] for g in got] == want, name


def test_models_and_stubs(spark):
    models = cells.models(spark)
    assert models.where("kind = 'comb'").count() == 77 * 7 and models.where("kind = 'seq'").count() == 49 and models.where("kind = 'physical'").count() == 15
    stubs = {r.cell: r.text for r in cells.stubs(spark, spark.createDataFrame([("a21oi_2",), ("dfrtp_1",), ("nothing",)], "cell string")).collect()}
    assert list(stubs) == ["a21oi_2", "dfrtp_1"]
    assert "assign Y = ~((A1 & A2) | B1);" in stubs["a21oi_2"] and "always @(posedge CLK or negedge RESET_B)" in stubs["dfrtp_1"]


def netlist_tables(spark, wires, side):
    rows = [(side, i * 2, pin, n * 2 + 1, cell) for i, (cell, pins) in enumerate(wires) for pin, n in pins.items()]
    df = spark.createDataFrame(rows, "side string, inst long, pin long, net long, cell string")
    nodes = df.select("side", F.col("inst").alias("node"), F.lit("inst").alias("kind"), F.col("cell").alias("label")).union(df.select("side", "net", F.lit("net"), F.lit(None).cast("string"))).distinct()
    edges = df.select("side", F.col("inst").alias("node"), "pin", F.col("net").alias("other"))
    return nodes, edges.unionByName(edges.select("side", F.col("other").alias("node"), "pin", F.col("node").alias("other")))


@pytest.mark.parametrize("right,equal", [([("inv", {1: 5, 2: 6}), ("nand", {1: 6, 2: 9, 3: 7}), ("inv", {1: 7, 2: 8})], True), ([("inv", {1: 5, 2: 6}), ("nand", {1: 9, 2: 6, 3: 7}), ("inv", {1: 7, 2: 8})], False), ([("inv", {1: 5, 2: 6}), ("nand", {1: 6, 2: 9, 3: 7}), ("inv", {1: 6, 2: 8})], False)])
def test_comparison(spark, right, equal):
    left = [("inv", {1: 1, 2: 2}), ("nand", {1: 2, 2: 4, 3: 3}), ("inv", {1: 3, 2: 0})]
    (n1, e1), (n2, e2) = netlist_tables(spark, left, "left"), netlist_tables(spark, right, "right")
    colours = graphs.refine_until_stable(graphs.seed_colours(n1.unionByName(n2)), e1.unionByName(e2))
    assert graphs.class_sizes(colours).isEmpty() == equal
    if equal:
        assert {tuple(r) for r in graphs.mapping(colours).collect()} >= {(1 * 2 + 1, 5 * 2 + 1), (2 * 2 + 1, 6 * 2 + 1), (0, 0), (2, 2)}


@pytest.mark.parametrize("bits", [0, 2, 64])
def test_signatures_that_collide(spark, bits):
    """Classes are those of whole signatures, whatever the hash that proposes them: here it has no, four or all values."""
    made = random.Random(5)
    own = {(side, k): {made.randrange(4): made.randrange(1, 3) for _ in range(made.randrange(4))} for side in ("left", "right") for k in range(60)}
    nodes = spark.createDataFrame(list(own), "side string, node long")
    features = spark.createDataFrame([(*who, f, n) for who, has in own.items() for f, n in has.items()], "side string, node long, f long, n long")
    found = {(r.side, r.node): r.colour for r in graphs.signature_classes(nodes, features, bits).collect()}
    assert found.keys() == own.keys()
    pairs = {(found[who], tuple(sorted(has.items()))) for who, has in own.items()}
    assert len(pairs) == len({c for c, _ in pairs}) == len({s for _, s in pairs}) and {c for c, _ in pairs} == set(range(len(pairs)))


def test_exact_rounds(spark):
    """Rounds with a hash of four values give the classes of the rounds that trust 64 bits; nothing to number gives nothing."""
    wires = [(made, {1: k % 7, 2: (k * 3) % 11}) for k, made in enumerate(["inv", "nand", "inv", "buf"] * 6)]
    nodes, edges = netlist_tables(spark, wires, "left")
    plain, exact = graphs.seed_colours(nodes), graphs.exact_seeds(nodes, 2)
    for _ in range(2):
        both = [{r.node: r.colour for r in df.collect()} for df in (plain, exact)]
        assert both[0].keys() == both[1].keys()
        assert len({(both[0][k], both[1][k]) for k in both[0]}) == len(set(both[0].values())) == len(set(both[1].values()))
        plain, exact = graphs.refine(plain, edges), graphs.exact_refine(exact, edges, 2)
    assert graphs.exact_refine(exact.limit(0), edges.limit(0)).count() == 0


def test_matched_exactly(spark):
    pins = lambda *rows: spark.createDataFrame(list(rows), "net_id long, cell string, pin string")
    a = pins((1, "i", "A"), (1, "i", "A"), (2, "i", "A"), (3, "i", "A"), (4, None, "PIN:x"), (None, "i", "A"))
    b = pins((7, "i", "A"), (7, "i", "A"), (8, "i", "A"), (9, "b", "A"))
    for bits in (0, 64):
        assert scoring.nets_matched_exactly(a, b, bits).first().n_matched == 2
    assert scoring.nets_matched_exactly(a, b.limit(0)).first().n_matched == 0 == scoring.nets_matched_exactly(a.limit(0), b.limit(0)).first().n_matched


def test_scores(spark):
    a = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "net_id long, signature string")
    b = spark.createDataFrame([(1, "x"), (2, "z")], "net_id long, signature string")
    assert scoring.nets_matched(a, b).first().n_matched == 1 and [r.net_id for r in scoring.nets_unmatched(a, b).collect()] == [3]


def test_waves(spark):
    w = spark.createDataFrame([("a", 0, 1, None), ("a", 1, 2, None), ("a", 1, 3, 1), ("a", 5, 4, 1), ("a", 6, 5, 0), ("b", 2, 6, 1)], "signal string, t long, seq long, value int")
    assert [(r.signal, r.t, r.value) for r in waves.changes(w).orderBy("signal", "seq").collect()] == [("a", 0, None), ("a", 1, 1), ("a", 6, 0), ("b", 2, 1)]
    asked = spark.createDataFrame([("a", 1), ("a", 6), ("b", 1), ("c", 1)], "signal string, t long")
    assert {(r.signal, r.t): r.value for r in waves.as_of(asked, w).collect()} == {("a", 1): 1, ("a", 6): 0, ("b", 1): None, ("c", 1): None}
    assert {(r.signal, r.t): r.value for r in waves.as_of(asked, w, True).collect()} == {("a", 1): None, ("a", 6): 1, ("b", 1): None, ("c", 1): None}


def test_names(spark):
    df = spark.createDataFrame([("lib__nand2_4",), ("inv",), ("a__",), ("1x",), ("a b",)], "n string")
    assert [r[0] for r in df.select(text.instance_base_name(F.col("n"))).collect()] == ["nand2", "inv", "a__", "1x", "a b"]
    assert [r[0] for r in df.select(text.escape_identifier(F.col("n"))).collect()] == ["lib__nand2_4", "inv", "a__", "\\1x ", "\\a b "]
    reals = spark.createDataFrame([("425A000000000000",), ("4010000000000000",), ("C110000000000000",)], "h string").select(text.ibm_real(F.col("h"))).collect()
    assert [r[0] for r in reals] == [90.0, 0.0625, -1.0]
    ranked = netlist.numbered(spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(7), ["k"], "i")
    assert ranked.where("k <> i").count() == 0 and ranked.count() == 1000


def side(spark, wires):
    insts = spark.createDataFrame([(i, n, c) for i, (n, c, _) in enumerate(wires)], "inst_id long, name string, cell string")
    pins = spark.createDataFrame([(i, p, n) for i, (_, _, pins) in enumerate(wires) for p, n in pins.items()], "inst_id long, pin string, net string")
    return compare.Side(insts, pins)


def test_compare_with_ties(spark):
    """Two equal branches: only pairing them one by one tells them apart."""
    left = [("a", "inv_1", {"A": "i", "Y": "x"}), ("b", "inv_1", {"A": "i", "Y": "y"}), ("c", "nand2_1", {"A": "x", "B": "y", "Y": "o"}), ("d", "inv_1", {"A": "o", "Y": "z1"}), ("e", "inv_1", {"A": "o", "Y": "z2"}), ("f", "decap_3", {})]
    right = [("r1", "inv_1", {"A": "q", "Y": "w"}), ("r2", "inv_1", {"A": "q", "Y": "v"}), ("r3", "nand2_1", {"A": "v", "B": "w", "Y": "u"}), ("r4", "inv_1", {"A": "u", "Y": "t"}), ("r5", "inv_1", {"A": "u", "Y": "s"})]
    found = compare.compare(side(spark, left), side(spark, right))
    names = {(r.kind, r.left): r.right for r in found.mapping.collect()}
    assert found.equal and names["inst", "a"] == "r2" and names["net", "x"] == "v" and len(names) == 5 + 6 and {names["inst", "d"], names["inst", "e"]} == {"r4", "r5"}
    insts, pins = compare.renamed(side(spark, left).insts, side(spark, left).pins, found.mapping)
    assert {r.name for r in insts.collect()} == {"r1", "r2", "r3", "r4", "r5", "f"} and {r.net for r in pins.collect()} == set("qwvuts")
    wrong = compare.compare(side(spark, left), side(spark, right[:4]))
    assert not wrong.equal and any("inv_1" in r.message for r in wrong.differences.collect())


def test_a_cap_that_is_hit_is_an_error(spark):
    """No result stands for what a cap left undone, and without a cap the loops have no end of their own."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(4)], "a long, b long")
    nodes = spark.range(5).select(F.col("id").alias("node"))
    with pytest.raises(RuntimeError, match="levels not settled"):
        graphs.levels(nodes, edges, max_rounds=2)
    with pytest.raises(RuntimeError, match="support not settled"):
        graphs.support(edges, nodes.where("node = 4"), max_rounds=1)
    refs = spark.createDataFrame([("top", "a", 1), ("a", "b", 2), ("b", "c", 3)], "parent string, child string, ref_id long")
    refs = refs.select("*", *(F.lit(v).cast("long").alias(c) for c, v in (("ox", 0), ("oy", 0), ("angle", 0), ("n_cols", 1), ("n_rows", 1), ("dx", 0), ("dy", 0))), F.lit(False).alias("mirror"))
    with pytest.raises(RuntimeError, match="placements not settled"):
        hierarchy.flatten(refs, "top", max_depth=1)
    left, right = ([(f"{p}{k}", "inv_1", {"A": f"{p}i", "Y": f"{p}y{k}"}) for k in range(3)] for p in "lr")
    with pytest.raises(RuntimeError, match="ties not settled"):
        compare.compare(side(spark, left), side(spark, right), max_ties=1)
    for f, cap in ((graphs.levels, "max_rounds"), (graphs.support, "max_rounds"), (graphs.refine_until_stable, "max_rounds"), (hierarchy.flatten, "max_depth"), (compare.compare, "max_ties")):
        assert inspect.signature(f).parameters[cap].default is None


def test_picture(spark):
    rects = spark.createDataFrame([(1, 0, 0, 0, 10, 20, 5), (2, 1, 5, 5, 30, 10, None), (3, 1, 0, 0, 1, 1, 1), (4, 5, 0, 0, 2, 2, 1)], "rect_id long, level int, xlo long, ylo long, xhi long, yhi long, net long")
    lines = lambda **options: [r.text for r in render.to_svg(rects, width_px=300, **options).orderBy("part", "key").collect()]
    drawn = lines(highlight=5, max_level=4)
    assert drawn[0].endswith('width="300" height="200" viewBox="0 0 300 200">') and drawn[1].endswith('fill="#ffffff"/>') and drawn[-1] == "</svg>"
    assert drawn[2:5] == ['<g id="li1">', '<rect x="0.00" y="0.00" width="100.00" height="200.00" fill="#d62828"/>', "</g>"]
    assert [x.rpartition("fill=")[2] for x in drawn[6:8]] == ['"#e8ebee"/>'] * 2 and len(drawn) == 10
    boxes = spark.createDataFrame([(0, 0, 30, 20), (500, 500, 501, 501)], "xlo long, ylo long, xhi long, yhi long")
    clipped = lines(clip=(0, 0, 3, 3), instances=boxes, stroke=0.5, background="#000000", by="layer")
    assert sum("stroke-width=\"50.00\"" in x for x in clipped) == 3 and clipped[2].startswith('<g fill="none"') and clipped[4] == "</g>" and clipped[1].endswith('fill="#000000"/>')
    assert [r.text for r in render.to_svg(rects.limit(0)).collect()] == []
    colours = {r.rect_id: r.colour for r in render.colours(rects.withColumn("kind", F.lit("ground")), dim_power=True).collect()}
    assert colours == {1: render.DIMMED, 2: render.NO_NET, 3: render.DIMMED, 4: render.DIMMED}


def test_id_codes(spark):
    n = [0, 93, 94, 94**4 - 1, 94**4, 94**5 + 7, 2**63 - 1]
    code = lambda v: chr(33 + v % 94) + (code(v // 94) if v >= 94 else "")
    assert [r.c for r in spark.createDataFrame([(v,) for v in n], "n long").select(text.id_code(F.col("n")).alias("c")).collect()] == [code(v) for v in n]


def test_rings_are_told_apart(spark):
    """Colours alone can't tell two rings of three inverters from one of six; the pairing does, and no budget makes them equal."""
    ring = lambda p, sizes: [(f"{p}{s}{k}", "inv_1", {"A": f"{p}{s}n{k}", "Y": f"{p}{s}n{(k + 1) % n}"}) for s, n in enumerate(sizes) for k in range(n)]
    assert not compare.compare(side(spark, ring("l", (3, 3))), side(spark, ring("r", (6,)))).equal
    same = compare.compare(side(spark, ring("l", (3, 3))), side(spark, ring("r", (3, 3))))
    assert same.equal and same.mapping.count() == 12


def test_many_ties_in_few_jobs(spark):
    """Forty pairs of branches that are alike, each at a place of its own, and a class of thirty twins: paired together, in a few rounds."""
    def circuit(p, flip):
        out = []
        for k in range(40):
            a, b = ("x", "y") if (k % 3 == 0) != flip else ("y", "x")
            out += [(f"{p}{k}a", "inv_1", {"A": f"{p}i{k}", "Y": f"{p}{a}{k}"}), (f"{p}{k}b", "inv_1", {"A": f"{p}i{k}", "Y": f"{p}{b}{k}"}), (f"{p}{k}c", "nand2_1", {"A": f"{p}x{k}", "B": f"{p}x{k}", "Y": f"{p}o{k}"})]
            out += [(f"{p}{k}d", "nand2_1", {"A": f"{p}y{k}", "B": f"{p}y{k}", "Y": f"{p}q{k}"}), (f"{p}{k}e", "buf_1", {"A": f"{p}i{k}", "X": f"{p}i{k + 1}"})]
        return out + [(f"{p}t{k}", "dfxtp_1", {"D": f"{p}i0", "CLK": f"{p}i40"}) for k in range(30)]

    rounds = []
    counted = compare.Pairings.add
    compare.Pairings.add = lambda self, n: (rounds.append(n), counted(self, n))[1]
    try:
        found = compare.compare(side(spark, circuit("l", False)), side(spark, circuit("r", True)))
    finally:
        compare.Pairings.add = counted
    assert found.equal and found.mapping.count() == 40 * 5 + 30 + 40 * 5 + 1 and len(rounds) <= 3 and max(rounds) >= 41


def test_waves_of_a_hot_signal(spark):
    rng = random.Random(4)
    rows = [(("hot" if rng.random() < 0.9 else rng.choice("abc")), rng.randint(0, 300), k, rng.choice((0, 1, None))) for k in range(2000)]
    w = spark.createDataFrame(rows, "signal string, t long, seq long, value int")
    by = {}
    for s, t, k, v in sorted(rows, key=lambda r: r[:3]):
        by.setdefault(s, []).append((t, k, v))
    changed = {(s, k) for s, own in by.items() for i, (_, k, v) in enumerate(own) if i == 0 or own[i - 1][2] != v}
    assert {(r.signal, r.seq) for r in waves.changes(w).collect()} == changed
    rising = {(s, k) for s, own in by.items() for i, (_, k, v) in enumerate(own) if i and own[i - 1][2] == 0 and v == 1}
    assert {(r.signal, r.seq) for r in waves.edges(w).collect()} == rising
    asked = [(s, t) for s in by for t in range(-1, 303, 7)]
    for strict in (False, True):
        want = {(s, t): next((v for u, _, v in reversed(by[s]) if u < t or u == t and not strict), None) for s, t in asked}
        assert {(r.signal, r.t): r.value for r in waves.as_of(spark.createDataFrame(asked, "signal string, t long"), w, strict).collect()} == want


@pytest.mark.parametrize("seed", range(6))
def test_swept_squares(seed):
    """Trees of a square against all its pairs: rectangles that only touch, piles, points, and cuts with and without area."""
    rng = np.random.default_rng(seed)
    n, span = 60 * (1 + seed), (30, 100, 400)[seed % 3]
    lo = rng.integers(0, span, (n, 2))
    box = np.concatenate([lo, lo + rng.integers(0, (4, 9, 60)[seed % 3], (n, 2))], axis=1)
    level, cut, node = rng.integers(0, 3, n), rng.random(n) < 0.3, rng.permutation(n).astype(np.int64)
    near = lambda a, b: a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]
    over = lambda a, b: a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3]
    ties = [(a, b) for a in range(n) for b in range(n) if a != b and not cut[b] and (over(box[a], box[b]) and level[b] - level[a] in (0, 1) if cut[a] else near(box[a], box[b]) and level[a] == level[b])]
    found = squares.swept(node, level, cut, box)
    if ties:
        want = components.roots(*(node[list(x)] for x in zip(*ties, strict=True)))
        assert all((a == b).all() for a, b in zip(found, want, strict=True))


def test_nets_of_a_pile(spark, monkeypatch):
    """Squares that are divided, rails beside them and cuts, against all pairs; a pile gives a row for each rectangle, not for each pair."""
    rng = random.Random(4)
    rows = [(k, rng.randrange(2), x := rng.randrange(-900, 900), y := rng.randrange(-900, 900), x + rng.randrange(1, 25), y + rng.randrange(1, 25)) for k in range(1500)]
    rows += [(2000 + k, 0, -1000, 100 * k, 1000, 100 * k + 3) for k in range(4)] + [(3000 + k, 1, 5, 5, 20, 20) for k in range(1000)]
    cuts = [(k, 0, x := rng.randrange(-900, 900), y := rng.randrange(-900, 900), x + 9, y + 9) for k in range(40)] + [(90, 0, -1000, 701, 1000, 704), (91, 1, 0, 0, 9, 9)]
    rects, made = spark.createDataFrame(rows, "rect_id long, level int, xlo long, ylo long, xhi long, yhi long"), spark.createDataFrame(cuts, "cut_id long, lower int, xlo long, ylo long, xhi long, yhi long")
    edges = spatial.touch_pairs(rects).unionByName(spatial.cut_edges(spatial.cut_hits(made, rects, 2)))
    parts = {r.node: r.component for r in components.connected_components(edges).collect()}
    monkeypatch.setattr(squares, "TOGETHER", 300)
    monkeypatch.setattr(squares, "CROWDED", 200)
    monkeypatch.setattr(squares, "SHOWN", 1)
    monkeypatch.setattr(squares, "LONG", 2)
    found = nets.rect_nets(rects, made, 2).collect()
    assert {r.rect_id: r.net for r in found} == {r[0]: parts.get(r[0], r[0]) for r in rows} and len(found) == len(rows)
    pile = rects.where("rect_id >= 3000")
    assert squares.square_trees(pile, None, 2).count() == 1000
    assert nets.rect_nets(rects.limit(0), made, 2).count() == 0


def test_labels_in_squares(spark, monkeypatch):
    """Labels are bound by the sweep as by the point join: on edges, on rails, in piles, on two rectangles that touch, inside of cuts without metal, and on nothing."""
    rng = random.Random(6)
    rows = [(k, rng.randrange(2), x := rng.randrange(-900, 900), y := rng.randrange(-900, 900), x + rng.randrange(1, 25), y + rng.randrange(1, 25)) for k in range(900)]
    rows += [(2000 + k, 0, -1000, 100 * k, 1000, 100 * k + 3) for k in range(4)]
    cuts = [(k, 0, x := rng.randrange(-900, 900), y := rng.randrange(-900, 900), x + 30, y + 30) for k in range(60)]
    points = [(l, *rng.choice([(x0, y0), (x1, y1), (x0, y1 + 1), (x0 - 1, y0), ((x0 + x1) // 2, y0)])) for _, l, x0, y0, x1, y1 in rng.sample(rows, 400)] + [(l, x + 15, y + 15) for _, _, x, y, _, _ in cuts for l in (0, 1)] + [(5, 0, 0), (0, 90_000, 7), (0, 90_000, 7)]
    rects, made = spark.createDataFrame(rows, "rect_id long, level int, xlo long, ylo long, xhi long, yhi long"), spark.createDataFrame(cuts, "cut_id long, lower int, xlo long, ylo long, xhi long, yhi long")
    labels = spark.createDataFrame([(k, *p) for k, p in enumerate(points)], "text_id long, level int, x long, y long")
    want = {r.text_id: r.net for r in nets.bind_labels(labels, nets.wired(rects, made, 2)).collect()}
    assert len(want) == len(points) and 50 < sum(net is None for net in want.values()) < len(points) - 50
    for long in (2, 10_000):  # with rails beside the squares and without
        monkeypatch.setattr(squares, "TOGETHER", 300)
        monkeypatch.setattr(squares, "LONG", long)
        held, bound = nets.wired_labels(rects, made, labels, 2)
        bound = bound.collect()
        assert {r.text_id: r.net for r in bound} == want and len(bound) == len(points)
        assert {r.rect_id: r.net for r in held.collect()} == {r.rect_id: r.net for r in nets.rect_nets(rects, made, 2).collect()}
    assert {(r.text_id, r.net) for r in nets.wired_labels(rects.limit(0), made, labels, 2)[1].collect()} == {(k, None) for k in range(len(points))}


def _moved(df) -> int:
    """Shuffles by a hash in df's plan."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_numbers_and_pins_move_rows_once(spark):
    """Numbered rows aren't dealt or sorted again to be counted, and a pin's nets are counted where its rows were dealt to."""
    rows = spark.range(400).select((F.col("id") * 7 % 400).alias("seq"), F.col("id").alias("more"))
    ranked = netlist.numbered(rows, ["seq"], "n", drop=("seq",))
    assert ranked.columns == ["more", "n"] and sorted(r.n for r in ranked.collect()) == list(range(400)) and ranked.where("n <> more * 7 % 400").count() == 0
    assert "Window [row_number" not in ranked._jdf.queryExecution().executedPlan().toString() and "seq" not in ranked._jdf.queryExecution().executedPlan().toString()
    hits = spark.range(400).select((F.col("id") % 50).alias("inst_id"), (F.col("id") % 4).cast("string").alias("pin"), (F.col("id") % 3).alias("net_id"))
    assert _moved(netlist.pin_nets(hits)) == 1


@pytest.mark.parametrize("what", ["pins", "as_of", "refined", "exact", "numbered", "bound"])
def test_tasks_stay_small(spark, what):
    """What is joined, sorted and counted is dealt to as many tasks as a shuffle has, however small it is: adaptive execution would join them."""
    rows = spark.range(400).select((F.col("id") % 7).cast("string").alias("signal"), F.col("id").alias("t"), F.col("id").alias("seq"), F.col("id").alias("value"))
    edges = spark.range(400).select(F.substring(F.col("id").cast("string"), 5, 1).alias("side"), F.col("id").alias("node"), F.lit(1).cast("long").alias("pin"), (F.col("id") * 7 % 400).alias("other"))
    colours = edges.select("side", "node", F.lit(0).cast("long").alias("colour"))
    rects = spark.range(50).select((F.col("id") * 9).alias("net"), F.lit(0).alias("level"), (F.col("id") * 50).alias("xlo"), F.lit(0).cast("long").alias("ylo"), (F.col("id") * 50 + 20).alias("xhi"), F.lit(20).cast("long").alias("yhi"))
    made = {
        "pins": lambda: view(spark, "/root/testdata/sf0.001", "v_pin"), "as_of": lambda: waves.as_of(rows.select("signal", "t"), rows), "refined": lambda: graphs.refine(colours, edges), "exact": lambda: graphs.exact_refine(colours, edges),
        "numbered": lambda: netlist.numbered(rows, ["seq"], "n"), "bound": lambda: spatial.points_bound(spark.range(90).select(F.col("id").alias("text_id"), F.lit(0).alias("level"), (F.col("id") * 30).alias("x"), F.lit(5).cast("long").alias("y")), rects, "text_id"),
    }[what]()
    assert made.rdd.getNumPartitions() >= components.n_parts(spark)


def test_colours_of_a_hub(spark, monkeypatch):
    """A node that very many have as a neighbour gives its colour where they are, with the same result."""
    edges = spark.range(300).select(F.lit("left").alias("side"), F.col("id").alias("node"), F.lit(1).cast("long").alias("pin"), F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") * 7 % 300).alias("other"))
    colours = edges.select("side", "node", (F.col("node") % 4).alias("colour"))
    want = {tuple(r) for r in graphs.refine(colours, edges).collect()}
    monkeypatch.setattr(graphs, "HUB", 20)
    monkeypatch.setattr(graphs, "SHOWN", 1)
    assert {tuple(r) for r in graphs.refine(colours, edges).collect()} == want and len(want) == 300


def test_classes_of_both_sides(spark, monkeypatch):
    """Classes are counted for both sides in one pass over all partitions of a shuffle, and pins are joined once for both sides."""
    rows = [("left", k, k % 40 if k < 90 else 1000 + k) for k in range(100)] + [("right", k + 500, k % 40 if k < 95 else 1000 + k) for k in range(100)] + [("left", 7000, 5000), ("right", 7001, 6000)]
    colours = spark.createDataFrame(rows, "side string, node long, colour long")
    held = {(side, c): [n for s, n, d in rows if (s, d) == (side, c)] for side, _, c in rows}
    both = {c: (held.get(("left", c), []), held.get(("right", c), [])) for _, c in held}
    sizes, pairs = graphs.class_sizes(colours), graphs.mapping(colours)
    assert {tuple(r) for r in sizes.collect()} == {(c, len(a), len(b)) for c, (a, b) in both.items() if len(a) != len(b)}
    assert {tuple(r) for r in pairs.collect()} == {(a[0], b[0]) for a, b in both.values() if len(a) == len(b) == 1} != set()
    for made in (sizes, pairs):
        assert made.rdd.getNumPartitions() >= components.n_parts(spark) and "Join" not in made._jdf.queryExecution().executedPlan().toString()
    seen = []
    monkeypatch.setattr(netlist_queries, "written", lambda df, name: seen.append(df) or df)
    netlist_queries._graph(spark, "/root/testdata/sf0.001")
    assert seen[0]._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1


def test_parts_grow_with_rows(spark, monkeypatch):
    """A part's rows don't grow with the table: more rows are dealt in more parts than the session has for a shuffle, with hubs and without, and the result is the same."""
    sf_dir, dealt_in = "/root/testdata/sf0.001", lambda df: {int(n) for n in re.findall(r"hashpartitioning\([^()]*, (\d+)\)", df._jdf.queryExecution().executedPlan().toString())}
    mapped = lambda: netlist_queries.q_wl_mapping(spark, sf_dir)
    pins, want = view(spark, sf_dir, "v_pin").count(), {tuple(r) for r in mapped().collect()}
    assert want and dealt_in(mapped()) == {components.n_parts(spark)}
    monkeypatch.setattr(components, "PART_ROWS", 1000, raising=False)
    rows = sum(spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("lineitem", "orders"))
    assert dealt_in(view(spark, sf_dir, "v_pin")) == {math.ceil(rows / 1000)}
    assert dealt_in(made := mapped()) == {math.ceil(4 * pins / 1000)} and {tuple(r) for r in made.collect()} == want
    monkeypatch.setattr(graphs, "HUB", 20)
    monkeypatch.setattr(graphs, "SHOWN", 1)
    assert max(dealt_in(made := mapped())) == math.ceil(4 * pins / 1000) and {tuple(r) for r in made.collect()} == want


def _square_rows(seed: int, n: int, span: int, most: int):
    """Rectangles, cuts and labels of a square at random, in the order of swept()'s arguments."""
    rng = np.random.default_rng(seed)
    lo, kind = rng.integers(-span, span, (n, 2)), rng.choice(3, n, p=[0.6, 0.25, 0.15])
    box = np.concatenate([lo, lo + np.where(kind == squares.LABEL, 0, rng.integers(0, most, (2, n))).T], axis=1)
    return rng.permutation(n).astype(np.int64) + n * (kind == squares.LABEL), rng.integers(0, 3, n), kind == squares.CUT, box, kind == squares.LABEL


@pytest.mark.parametrize("seed", range(12))
def test_squares_as_arrays(seed, monkeypatch):
    """Comparing what lies beside each other gives the trees of the sweep, whatever the density, and however many pairs are held at a time."""
    rows, found = _square_rows(seed, (20, 200, 500)[seed % 3], (10, 40, 150, 400)[seed % 4], (3, 9, 60)[seed // 4]), []
    for near, pairs in ((-1, 1), (10**9, 1 << 20), (10**9, 50), (3, 50)):
        monkeypatch.setattr(squares, "NEAR", near)
        monkeypatch.setattr(squares, "PAIRS", pairs)
        found.append(squares.swept(*rows))
    assert all((a == b).all() for other in found[1:] for a, b in zip(found[0], other, strict=True))


def test_only_piles_are_swept(monkeypatch):
    """A square whose rows lie beside few others isn't swept row by row; a pile is, and no pairs of it are listed."""
    swept, plain = [], squares.Sweep.level
    monkeypatch.setattr(squares.Sweep, "level", lambda self, *rows: swept.append(len(rows[0])) or plain(self, *rows))
    squares.swept(*_square_rows(1, 5000, 5000, 100))
    assert not swept
    pile = np.tile(np.array([0, 0, 9, 9]), (3000, 1))
    node, root, size = squares.swept(np.arange(3000), np.zeros(3000, int), np.zeros(3000, bool), pile)
    assert swept == [3000] and len(node) == 3000 and (root == 0).all() and (size == 3000).all()


def test_squares_begin_at_the_corner(spark, monkeypatch):
    """A row of cells around the axis is in one row of squares, so what crosses the axis is in one of them only; squares are dealt in parts that don't grow with the rows."""
    rects = spark.range(600).select(F.col("id").alias("rect_id"), F.lit(0).alias("level"), (F.col("id") * 1000).alias("xlo"), F.lit(-15).cast("long").alias("ylo"), (F.col("id") * 1000 + 20).alias("xhi"), F.lit(15).cast("long").alias("yhi"))
    rects = rects.unionByName(rects.withColumn("rect_id", F.col("rect_id") + 600))
    monkeypatch.setattr(squares, "TOGETHER", 100)
    monkeypatch.setattr(components, "PART_ROWS", 100)
    trees = squares.square_trees(rects, None, 2)
    assert trees.where("NOT shared").count() == trees.count() == 1200
    assert re.search(r"hashpartitioning\([^()]*, 12\)", trees._jdf.queryExecution().executedPlan().toString())


def _random_circuit(spark):
    """Nodes and edges of two sides, with nets that very many pins are on, pins that are there twice, and nodes that nothing is on."""
    rng = random.Random(3)
    pins = [(s, 2 * k, rng.randrange(3), 2 * rng.choice([0, 0, 0, 1, 1, rng.randrange(30)]) + 1) for s in ("left", "right") for k in range(50) for _ in range(rng.randrange(4))]
    nodes = [(s, 2 * k, "inst", f"c{k % 3}") for s in ("left", "right") for k in range(50)] + [(s, 2 * k + 1, "net", None) for s in ("left", "right") for k in range(30)]
    edges = pins + [(s, o, p, n) for s, n, p, o in pins]
    return spark.createDataFrame(nodes, "side string, node long, kind string, label string"), spark.createDataFrame(edges, "side string, node long, pin int, other long")


@pytest.mark.parametrize("bits,hub", [(64, 200_000), (64, 8), (2, 8)])
def test_exact_rounds_with_hubs(spark, monkeypatch, bits, hub):
    """Exact classes are those of the rounds that trust 64 bits, whether neighbours are put in order as one value or counted by rows, and where hashes collide."""
    monkeypatch.setattr(graphs, "HUB", hub)
    monkeypatch.setattr(graphs, "SHOWN", 1 if hub < 100 else 100)
    nodes, edges = _random_circuit(spark)
    plain, exact = graphs.seed_colours(nodes), graphs.exact_seeds(nodes, bits)
    for _ in range(2):
        plain, exact = graphs.refine(plain, edges), graphs.exact_refine(exact, edges, bits, 5)
        both = [{(r.side, r.node): r.colour for r in df.collect()} for df in (plain, exact)]
        assert both[0].keys() == both[1].keys() and len(both[0]) == 160
        assert len({(both[0][k], both[1][k]) for k in both[0]}) == len(set(both[0].values())) == len(set(both[1].values()))


def test_exact_rounds_move_rows_seldom(spark, monkeypatch):
    """A round without collisions writes each node once and no row for each edge, and compares what nodes have once."""
    nodes, edges = _random_circuit(spark)
    colours, seen, plain = components.written(graphs.exact_seeds(nodes), "colours"), [], graphs.written
    monkeypatch.setattr(graphs, "written", lambda df, name: seen.append((name, plain(df, name))) or seen[-1][1])
    made = graphs.exact_refine(colours, edges)
    rows = {name: df.count() for name, df in seen}
    assert made.count() == nodes.count() == rows.pop("classes") and sum(rows.values()) == 0 and len(seen) == 3
