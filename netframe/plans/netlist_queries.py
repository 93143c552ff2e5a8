"""Queries over netlists: naming, ports, gates, simulation, comparison, scoring and waves, each with DuckDB SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netframe.functions import cells, text
from netframe.operators import graphs, netlist, scoring, waves
from netframe.plans.bridge import ctes, view
from netframe.operators.components import dealt, parts_for, written
from netframe.sources.verilog import tokens

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def _pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_pin")


PIN = f"WITH {ctes('v_pin')} "

# -- names, kinds and ports -----------------------------------------------------------------------------------------

CELL_NAME = "CASE p_partkey % 4 WHEN 0 THEN 'lib_hd__nand2_' || p_size WHEN 1 THEN 'inv_' || p_size WHEN 2 THEN 'a__b__' || p_brand ELSE p_name END"


@query(f"WITH c AS (SELECT p_partkey, {CELL_NAME} AS cell FROM part) SELECT p_partkey, regexp_replace(list_last(string_split(cell, '__')), '_[0-9]+$', '') AS base FROM c")
def q_base_name(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select("p_partkey", text.instance_base_name(F.expr(CELL_NAME)).alias("base"))


@query(f"WITH c AS (SELECT p_partkey, {CELL_NAME} AS cell FROM part) SELECT p_partkey, CASE WHEN regexp_full_match(cell, '[A-Za-z_$][A-Za-z0-9_$]*') THEN cell ELSE chr(92) || cell || ' ' END AS name FROM c")
def q_escape(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", text.escape_identifier(F.expr(CELL_NAME)).alias("name"))


_CODE = " || ".join(f"CASE WHEN {k} = 0 OR n >= {94**k} THEN chr(CAST(33 + n // {94**k} % 94 AS INT)) ELSE '' END" for k in range(8))


@query(f"SELECT event_id, {_CODE} AS code FROM (SELECT event_id, event_id * 123456789 AS n FROM events)")
def q_id_code(spark, sf_dir):
    """Names of up to seven characters."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", text.id_code(F.col("event_id") * 123_456_789).alias("code"))


_SPACE = r" \t\n\f\r\x0B"
_TOKEN_SQL = rf"\\[^{_SPACE}]+|[A-Za-z_$][A-Za-z0-9_$]*|[0-9]+''[bodhBODH][0-9a-fA-FxXzZ_]+|[0-9]+|<=|[^{_SPACE}]"


@query(f"WITH t AS (SELECT doc_id, regexp_extract_all(regexp_replace(COALESCE(text, ''), '(?s)//[^\\n]*|/\\*.*?\\*/|\\(\\*.*?\\*\\)', ' ', 'g'), '{_TOKEN_SQL}') AS w FROM documents) SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, md5(array_to_string(w, ' ')) AS tokens_md5 FROM t")
def q_tokens(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", tokens(F.coalesce("text", F.lit(""))).alias("w"))
    return docs.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.md5(F.array_join("w", " ")).alias("tokens_md5"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 1 THEN -1 ELSE 1 END * (1 + event_id % 200) * CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 16 ELSE 256 END AS value FROM events")
def q_ibm_real(spark, sf_dir):
    e = F.col("event_id")
    exponent = F.hex((F.when(e % 2 == 1, 128).otherwise(0) + 66 + e % 3).cast("long"))
    mantissa = F.lpad(F.hex(1 + e % 200), 2, "0")
    made = text.ibm_real(F.concat(exponent, mantissa, F.lit("000000000000")))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", made.cast("long").alias("value"))


@query("SELECT event_id, (event_id * 2654435) % 65536 AS u16, CASE WHEN (event_id * 2654435) % 65536 >= 32768 THEN (event_id * 2654435) % 65536 - 65536 ELSE (event_id * 2654435) % 65536 END AS i16, (event_id * 429496) % 4294967296 - CASE WHEN (event_id * 429496) % 4294967296 >= 2147483648 THEN 4294967296 ELSE 0 END AS i32 FROM events")
def q_bigendian(spark, sf_dir):
    e = F.col("event_id")
    body = F.unhex(F.concat(F.lpad(F.hex((e * 2654435) % 65536), 4, "0"), F.lpad(F.hex((e * 429496) % 4294967296), 8, "0")))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", text.unsigned(body, 0, 2).alias("u16"), text.signed(body, 0, 2).alias("i16"), text.signed(body, 2, 4).alias("i32"))


@query("WITH i AS (SELECT o_orderkey AS inst_id, regexp_replace(o_orderpriority, '_[0-9]+$', '') AS base FROM orders) SELECT inst_id, base || '_' || (row_number() OVER (PARTITION BY base ORDER BY inst_id) - 1) AS name FROM i")
def q_instance_names(spark, sf_dir):
    return netlist.instance_names(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("inst_id"), F.col("o_orderpriority").alias("cell")))


@query(PIN + ", f AS (SELECT net_id, MIN(inst_id * 100 + pin) AS first FROM v_pin GROUP BY net_id) SELECT net_id, 'n' || (row_number() OVER (ORDER BY first) - 1) AS name FROM f")
def q_net_names(spark, sf_dir):
    return netlist.net_names(_pins(spark, sf_dir))


@query("SELECT l_orderkey AS inst_id, l_linenumber AS pin, MIN(l_suppkey) AS net_id, COUNT(DISTINCT l_suppkey) AS n_nets FROM lineitem GROUP BY 1, 2")
def q_split_pins(spark, sf_dir):
    return netlist.pin_nets(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("inst_id"), F.col("l_linenumber").alias("pin"), F.col("l_suppkey").alias("net_id")))


@query("SELECT o_orderpriority AS cell, COUNT(*) AS n FROM orders GROUP BY 1")
def q_cell_usage(spark, sf_dir):
    return netlist.cell_histogram(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("cell")))


# supply pins: each order is an instance, its pins are named by line number
SUPPLY = "s AS (SELECT l_orderkey AS inst_id, CASE l_linenumber % 5 WHEN 0 THEN 'VPWR' WHEN 1 THEN 'VGND' WHEN 2 THEN 'VPB' ELSE 'A' || l_linenumber END AS pin, l_suppkey AS net FROM lineitem), p AS (SELECT inst_id, pin, MIN(net) AS net_id, COUNT(DISTINCT net) AS n_nets FROM s GROUP BY 1, 2)"


def _supply_pins(spark, sf_dir) -> DataFrame:
    n = F.col("l_linenumber")
    pin = F.when(n % 5 == 0, "VPWR").when(n % 5 == 1, "VGND").when(n % 5 == 2, "VPB").otherwise(F.concat(F.lit("A"), n.cast("string")))
    return netlist.pin_nets(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("inst_id"), pin.alias("pin"), F.col("l_suppkey").alias("net_id")))


@query(f"WITH {SUPPLY} SELECT DISTINCT net_id, CASE pin WHEN 'VGND' THEN 'ground' ELSE 'power' END AS kind FROM p WHERE n_nets = 1 AND pin IN ('VPWR', 'VGND', 'VPB')")
def q_supply_roots(spark, sf_dir):
    return netlist.supply_roots(_supply_pins(spark, sf_dir))


@query(f"WITH {SUPPLY} SELECT inst_id, pin, net_id FROM p UNION ALL SELECT inst_id, b.body, net_id FROM p JOIN (VALUES ('VPB', 'VPWR'), ('VNB', 'VGND')) b(body, rail) ON rail = pin WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.inst_id = p.inst_id AND q.pin = b.body)")
def q_body_infer(spark, sf_dir):
    return netlist.body_pins(_supply_pins(spark, sf_dir), {"VPB": "VPWR", "VNB": "VGND"})


LABELS = "labels AS (SELECT s_suppkey AS net_id, CASE s_suppkey % 10 WHEN 3 THEN 'VPWR' WHEN 7 THEN 'VSS' ELSE s_name END AS name FROM supplier WHERE s_suppkey % 2 = 1)"
KINDS = f"{SUPPLY}, {LABELS}, roots AS (SELECT net_id, MAX(CASE pin WHEN 'VGND' THEN 'ground' ELSE 'power' END) AS k FROM p WHERE n_nets = 1 AND pin IN ('VPWR', 'VGND', 'VPB') GROUP BY 1), nets AS (SELECT net_id FROM p UNION SELECT net_id FROM labels), kinds AS (SELECT net_id, CASE WHEN name = 'VPWR' THEN 'power' WHEN name = 'VSS' THEN 'ground' ELSE COALESCE(k, 'signal') END AS kind FROM nets LEFT JOIN labels USING (net_id) LEFT JOIN roots USING (net_id))"
DRIVEN = "driven AS (SELECT DISTINCT net_id FROM p WHERE pin IN ('A3', 'A8'))"


def _kinds(spark, sf_dir):
    pins = _supply_pins(spark, sf_dir)
    k = F.col("s_suppkey")
    labels = spark.read.parquet(f"{sf_dir}/supplier.parquet").where(k % 2 == 1).select(k.alias("net_id"), F.when(k % 10 == 3, "VPWR").when(k % 10 == 7, "VSS").otherwise(F.col("s_name")).alias("name"))
    return pins, labels, netlist.net_kinds(netlist.all_nets(pins, labels), labels, netlist.supply_roots(pins))


def _driven(spark, pins):
    directions = spark.createDataFrame([("x", "A3", "output"), ("x", "A8", "output"), ("x", "A4", "input")], "cell string, pin string, direction string")
    return netlist.driven_nets(pins.withColumn("cell", F.lit("x")), directions)


@query(f"WITH {KINDS} SELECT net_id, kind FROM kinds")
def q_net_kind(spark, sf_dir):
    return _kinds(spark, sf_dir)[2]


@query(f"WITH {SUPPLY}, {DRIVEN} SELECT net_id FROM driven")
def q_driven(spark, sf_dir):
    return _driven(spark, _supply_pins(spark, sf_dir))


@query(f"WITH {KINDS}, {DRIVEN} SELECT name, CASE WHEN kind <> 'signal' THEN 'inout' WHEN d.net_id IS NOT NULL THEN 'output' ELSE 'input' END AS direction, net_id FROM labels JOIN kinds USING (net_id) LEFT JOIN driven d USING (net_id)")
def q_ports(spark, sf_dir):
    pins, labels, kinds = _kinds(spark, sf_dir)
    return netlist.ports(labels, kinds, _driven(spark, pins))


# -- gates ----------------------------------------------------------------------------------------------------------


def _by_name(name: str) -> str:
    """A cell's function read off its name, over 0, 1 and 2 for false, unknown and true: and is the least, or the greatest, not the difference to 2."""
    least, most = (lambda *x: x[0] if len(x) == 1 else f"LEAST({', '.join(x)})"), (lambda *x: x[0] if len(x) == 1 else f"GREATEST({', '.join(x)})")
    no = lambda x: f"(2 - {x})"
    xor = lambda a, b: most(least(a, no(b)), least(no(a), b))
    v = [f"v{k}" for k in range(6)]
    if name in ("inv", "clkinv", "einvp"):
        return no("v0")
    if name in ("buf", "bufbuf", "clkbuf", "dlygate4sd3"):
        return "v0"
    if name == "maj3":
        return f"CASE WHEN v0 + v1 + v2 - LEAST(v0, v1, v2) - GREATEST(v0, v1, v2) = 0 THEN 0 WHEN v0 + v1 + v2 - LEAST(v0, v1, v2) - GREATEST(v0, v1, v2) = 2 THEN 2 ELSE 1 END"
    if name.startswith("mux"):
        if name == "mux4":
            return most(*(least(v[k], v[4] if k & 1 else no(v[4]), v[5] if k & 2 else no(v[5])) for k in range(4)))
        found = most(least("v0", no("v2")), least("v1", "v2"))
        return no(found) if name.endswith("i") else found
    if m := re.fullmatch(r"(xnor|xor)([23])", name):
        found = xor("v0", "v1") if m[2] == "2" else xor(xor("v0", "v1"), "v2")
        return no(found) if m[1] == "xnor" else found
    if m := re.fullmatch(r"(nand|and|nor|or)([234])(b*)", name):
        n, bars, is_and = int(m[2]), len(m[3]), m[1].endswith("and")
        own = [no(x) if (k < bars if is_and else k >= n - bars) else x for k, x in enumerate(v[:n])]
        found = least(*own) if is_and else most(*own)
        return no(found) if m[1].startswith("n") else found
    if m := re.fullmatch(r"o2bb2(ai?)", name):
        found = least(no(least("v0", "v1")), most("v2", "v3"))
        return no(found) if m[1] == "ai" else found
    m = re.fullmatch(r"([ao])(\d+)(b?)([ao])(i?)", name)
    groups, at, inner, outer = [], 0, *((least, most) if m[1] == "a" else (most, least))
    for n in map(int, m[2]):
        groups.append(v[at : at + n])
        at += n
    if m[3]:
        groups[-1] = [no(groups[-1][0])]
    found = outer(*(inner(*g) for g in groups))
    return no(found) if m[5] else found


def _gate_sql(kind: str) -> str:
    own = sorted({f[1] for f in cells.functions() if f[0] == kind and f[1] != "conb"})
    bits = ", ".join(f"CASE WHEN b{k} IS NULL THEN 1 WHEN b{k} THEN 2 ELSE 0 END AS v{k}" for k in range(6))
    return f"WITH {ctes('v_gate')}, g AS (SELECT {bits} FROM v_gate) " + " UNION ALL ".join(f"SELECT '{n}' AS cell, COUNT(*) FILTER ({_by_name(n)} = 2) AS n_true, COUNT(*) FILTER ({_by_name(n)} = 0) AS n_false, COUNT(*) FILTER ({_by_name(n)} = 1) AS n_unknown FROM g" for n in own)


def _gate_counts(kind: str):
    def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
        """All of a class's functions in one pass over the stimuli; equal stimuli are counted first."""
        stimuli = view(spark, sf_dir, "v_gate").groupBy(*(f"b{k}" for k in range(6))).agg(F.count("*").alias("times"))
        own = [f for f in cells.functions() if f[0] == kind and f[1] != "conb"]
        made = [F.expr(cells.expression(name, {p: f"b{k}" for k, p in enumerate(inputs)})) for _, name, inputs, _, _ in own]
        count = lambda c: F.coalesce(F.sum(F.when(c, F.col("times"))), F.lit(0))
        sums = stimuli.agg(F.array(*(F.struct(F.lit(f[1]).alias("cell"), count(e).alias("n_true"), count(~e).alias("n_false"), count(e.isNull()).alias("n_unknown")) for f, e in zip(own, made, strict=True))).alias("rows"))
        return sums.select(F.inline("rows"))

    return gates


for _kind in ("buffer", "basic", "xor", "complex", "other"):
    query(_gate_sql(_kind), f"q_gate_{_kind}")(_gate_counts(_kind))


_PLACED_CELL = "CASE p_partkey % 6 WHEN 0 THEN 'nand2_' WHEN 1 THEN 'lib__dfrtp_' WHEN 2 THEN 'mux4_' WHEN 3 THEN 'conb_' WHEN 4 THEN 'decap_' ELSE 'zzz_' END || CASE p_size % 7 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '4' WHEN 3 THEN '6' WHEN 4 THEN '8' WHEN 5 THEN '12' ELSE '16' END"


@query(
    f"WITH c AS (SELECT p_partkey, p_partkey % 6 AS k, {_PLACED_CELL} AS cell FROM part) SELECT p_partkey, cell, CASE WHEN k = 1 THEN 'seq' WHEN k < 4 THEN 'comb' WHEN k = 4 AND cell NOT IN ('decap_1', 'decap_2', 'decap_16') THEN 'physical' END AS kind FROM c"
)
def q_cell_models(spark, sf_dir):
    """The model of every placed cell, by its name behind the library's prefix; null for what has none."""
    placed = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.expr(_PLACED_CELL).alias("cell"))
    models = cells.models(spark).select(F.col("cell").alias("model"), "kind")
    return placed.withColumn("model", cells.model_name(F.col("cell"))).join(F.broadcast(models), "model", "left").select("p_partkey", "cell", "kind")


# -- circuits -------------------------------------------------------------------------------------------------------

# every order is fed by two earlier ones: a circuit as large as the table, about as deep as its logarithm
EDGES = "edges AS (SELECT DISTINCT a, b FROM (SELECT o_orderkey // 3 AS a, o_orderkey AS b FROM orders UNION ALL SELECT o_orderkey // 4 + o_custkey % 2, o_orderkey FROM orders) WHERE a < b)"


def _edges(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    fed = orders.select(F.expr("o_orderkey div 3").alias("a"), F.col("o_orderkey").alias("b")).unionByName(orders.select(F.expr("o_orderkey div 4 + o_custkey % 2").alias("a"), F.col("o_orderkey").alias("b")))
    return fed.where("a < b").distinct()


@query(f"WITH RECURSIVE {EDGES}, nodes AS (SELECT a AS node FROM edges UNION SELECT b FROM edges), l AS (SELECT node, CAST(0 AS INT) AS level FROM nodes WHERE node NOT IN (SELECT b FROM edges) UNION SELECT e.b, l.level + 1 FROM l JOIN edges e ON e.a = l.node) SELECT node, MAX(level) AS level FROM l GROUP BY node")
def q_levels(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return graphs.levels(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct(), edges)


@query(f"WITH RECURSIVE {EDGES}, s AS (SELECT o_orderkey AS node FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT e.a FROM s JOIN edges e ON e.b = s.node) SELECT node FROM s")
def q_support(spark, sf_dir):
    urgent = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderpriority = '1-URGENT'")
    return graphs.support(_edges(spark, sf_dir), urgent.select(F.col("o_orderkey").alias("node")))


@query(PIN + "SELECT DISTINCT net_id FROM v_pin WHERE pin > 4 AND net_id NOT IN (SELECT net_id FROM v_pin WHERE pin = 1 AND inst_id % 50 = 1)")
def q_free_inputs(spark, sf_dir):
    pins = _pins(spark, sf_dir)
    return netlist.free_inputs(pins.where("pin > 4"), pins.where("pin = 1 and inst_id % 50 = 1"))


@query(PIN + "SELECT net_id, COUNT(*) AS n, MAX(inst_id) AS last FROM v_pin WHERE pin = 1 GROUP BY net_id HAVING COUNT(*) > 1")
def q_multi_driver(spark, sf_dir):
    return netlist.multiple_drivers(_pins(spark, sf_dir).where("pin = 1"))


# -- comparison -----------------------------------------------------------------------------------------------------

# two netlists of the same instances; the right one has some nets rewired: pins of every fiftieth instance, or only the first pins of one net
REWIRED, FEW_REWIRED = "inst_id % 50 = 0", "net_id = 1 AND pin = 1"


def _sides_sql(rewired: str) -> str:
    return PIN + f", e AS (SELECT 'left' AS side, inst_id, cell, pin, net_id FROM v_pin UNION ALL SELECT 'right', inst_id, cell, pin, CASE WHEN {rewired} THEN net_id + 1 ELSE net_id END FROM v_pin)"


def _graph(spark, sf_dir, rewired: str = REWIRED) -> tuple[DataFrame, DataFrame, int]:
    """Nodes and edges of both sides, and the parts that so many edges are dealt in."""
    # both sides of a pin are made where it is, so the pins are joined and counted once
    of = lambda side, net: F.struct(F.lit(side).alias("side"), net.alias("net_id"))
    sides = F.explode(F.array(of("left", F.col("net_id")), of("right", F.when(F.expr(rewired), F.col("net_id") + 1).otherwise(F.col("net_id")))))
    both = _pins(spark, sf_dir).select("inst_id", "cell", "pin", sides.alias("own")).select("own.side", "inst_id", "cell", "pin", "own.net_id")
    inst, net = F.col("inst_id") * 2, F.col("net_id") * 2 + 1
    both = written(both, "pins")
    parts = parts_for(spark, 2 * both.count())
    insts = dealt(both.select("side", inst.alias("node"), F.lit("inst").alias("kind"), F.col("cell").alias("label")), "side", "node", parts=parts).distinct()
    nodes = insts.union(both.select("side", net.alias("node"), F.lit("net"), F.lit(None).cast("string")).distinct())
    edges = both.select("side", inst.alias("node"), F.col("pin").cast("long").alias("pin"), net.alias("other"))
    return written(nodes, "nodes"), edges.unionByName(edges.select("side", F.col("other").alias("node"), "pin", F.col("node").alias("other"))), parts


def _wl(rounds: int):
    def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
        nodes, edges, parts = _graph(spark, sf_dir)
        colours = graphs.seed_colours(nodes)
        for _ in range(rounds):
            colours = graphs.refine(colours, edges, parts)
        sizes = colours.groupBy("side", "colour").agg(F.count("*").alias("size"))
        return sizes.groupBy("side", "size").agg(F.count("*").alias("n_classes"))

    return classes


def _wl_sql(rounds: int, rewired: str = REWIRED) -> str:
    out = _sides_sql(rewired) + ", i0 AS (SELECT DISTINCT side, inst_id, md5('I' || cell) AS c FROM e), n0 AS (SELECT DISTINCT side, net_id, md5('N') AS c FROM e)"
    for k in range(rounds):
        out += f", i{k + 1} AS (SELECT e.side, e.inst_id, md5(MIN(i{k}.c) || string_agg(pin || ':' || n{k}.c, ',' ORDER BY pin, n{k}.c)) AS c FROM e JOIN n{k} ON e.side = n{k}.side AND e.net_id = n{k}.net_id JOIN i{k} ON e.side = i{k}.side AND e.inst_id = i{k}.inst_id GROUP BY e.side, e.inst_id)"
        out += f", n{k + 1} AS (SELECT e.side, e.net_id, md5(MIN(n{k}.c) || string_agg(pin || ':' || i{k}.c, ',' ORDER BY pin, i{k}.c)) AS c FROM e JOIN i{k} ON e.side = i{k}.side AND e.inst_id = i{k}.inst_id JOIN n{k} ON e.side = n{k}.side AND e.net_id = n{k}.net_id GROUP BY e.side, e.net_id)"
    return out + f", c AS (SELECT side, 'i' || inst_id AS node, c FROM i{rounds} UNION ALL SELECT side, 'n' || net_id, c FROM n{rounds})"


def _exact_wl(bits: int, rounds: int):
    def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
        nodes, edges, parts = _graph(spark, sf_dir)
        colours = graphs.exact_seeds(nodes, bits)
        for _ in range(rounds):
            colours = graphs.exact_refine(colours, edges, bits, parts)
        sizes = colours.groupBy("side", "colour").agg(F.count("*").alias("size"))
        return sizes.groupBy("side", "size").agg(F.count("*").alias("n_classes"))

    return classes


_WL_SIZES = ", z AS (SELECT side, c, COUNT(*) AS size FROM c GROUP BY side, c) SELECT side, size, COUNT(*) AS n_classes FROM z GROUP BY side, size"
for _r in (1, 2, 3):
    query(_wl_sql(_r) + _WL_SIZES, f"q_wl_round{_r}")(_wl(_r))


query(_wl_sql(2) + _WL_SIZES, "q_wl_exact")(_exact_wl(64, 2))


def _refined(spark, sf_dir, rounds, rewired=REWIRED):
    nodes, edges, parts = _graph(spark, sf_dir, rewired)
    colours = graphs.seed_colours(nodes)
    for _ in range(rounds):
        colours = graphs.refine(colours, edges, parts)
    return colours, parts


@query(_wl_sql(2) + ", z AS (SELECT c, COUNT(*) FILTER (side = 'left') AS n_left, COUNT(*) FILTER (side = 'right') AS n_right FROM c GROUP BY c) SELECT n_left, n_right, COUNT(*) AS n FROM z WHERE n_left <> n_right GROUP BY n_left, n_right")
def q_class_sizes(spark, sf_dir):
    return graphs.class_sizes(*_refined(spark, sf_dir, 2)).groupBy("n_left", "n_right").agg(F.count("*").alias("n"))


@query(_wl_sql(2, FEW_REWIRED) + ", z AS (SELECT c, MIN(node) FILTER (side = 'left') AS l, MIN(node) FILTER (side = 'right') AS r FROM c GROUP BY c HAVING COUNT(*) FILTER (side = 'left') = 1 AND COUNT(*) FILTER (side = 'right') = 1) SELECT CAST(substr(l, 2) AS BIGINT) * 2 + CASE WHEN l LIKE 'n%' THEN 1 ELSE 0 END AS \"left\", CAST(substr(r, 2) AS BIGINT) * 2 + CASE WHEN r LIKE 'n%' THEN 1 ELSE 0 END AS \"right\" FROM z")
def q_wl_mapping(spark, sf_dir):
    return graphs.mapping(*_refined(spark, sf_dir, 2, FEW_REWIRED))


@query("SELECT p_brand AS cell, CAST(SUM(CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE -1 END) AS BIGINT) AS n FROM part GROUP BY p_brand HAVING SUM(CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE -1 END) <> 0")
def q_hist_diff(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").withColumnRenamed("p_brand", "cell")
    return graphs.histogram_difference(part.where("p_partkey % 2 = 0"), part.where("p_partkey % 2 = 1"))


# -- scoring --------------------------------------------------------------------------------------------------------

EXPECTED = "x AS (SELECT o_orderpriority AS cell, o_custkey % 50 AS x, o_orderkey % 20 AS y FROM orders WHERE o_orderkey % 2 = 0), f AS (SELECT o_orderpriority AS cell, o_custkey % 50 AS x, o_orderkey % 20 AS y FROM orders WHERE o_orderkey % 3 = 1)"


def _expected(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = lambda df: df.select(F.col("o_orderpriority").alias("cell"), (F.col("o_custkey") % 50).alias("x"), (F.col("o_orderkey") % 20).alias("y"))
    return rows(orders.where("o_orderkey % 2 = 0")), rows(orders.where("o_orderkey % 3 = 1"))


@query(f"WITH {EXPECTED} SELECT COUNT(*) AS n, CAST(SUM(CASE WHEN (cell, x, y) IN (SELECT (cell, x, y) FROM f) THEN 1 ELSE 0 END) AS BIGINT) AS n_found FROM x")
def q_place_semi(spark, sf_dir):
    return scoring.placements_found(*_expected(spark, sf_dir))


@query(f"WITH {EXPECTED} SELECT cell, x, y FROM x WHERE (cell, x, y) NOT IN (SELECT (cell, x, y) FROM f) ORDER BY cell, x, y LIMIT 10")
def q_place_missing(spark, sf_dir):
    return scoring.placements_missing(*_expected(spark, sf_dir))


SIGNED = _sides_sql(REWIRED) + ", g AS (SELECT side, net_id, string_agg(cell || '.' || pin, '|' ORDER BY cell || '.' || pin) AS signature FROM e GROUP BY side, net_id)"


def _signatures(spark, sf_dir, side):
    """Pins of a side's nets."""
    pins = _pins(spark, sf_dir)
    net = F.when(F.expr(REWIRED), F.col("net_id") + 1).otherwise(F.col("net_id")) if side == "right" else F.col("net_id")
    return pins.select(net.alias("net_id"), "cell", "pin")


@query(SIGNED + "SELECT net_id, md5(signature) AS signature FROM g WHERE side = 'left'")
def q_net_signature(spark, sf_dir):
    return scoring.net_signatures(_signatures(spark, sf_dir, "left")).select("net_id", F.md5("signature").alias("signature"))


@query(SIGNED + ", c AS (SELECT signature, COUNT(*) FILTER (side = 'left') AS n_left, COUNT(*) FILTER (side = 'right') AS n_right, MIN(net_id) AS first FROM g GROUP BY signature) SELECT g.side, g.net_id, c.first, c.n_left, c.n_right FROM g JOIN c USING (signature)")
def q_net_classes(spark, sf_dir):
    """Each net of both sides with the first net and the sizes of its class: nets whose kinds of pins are the same, each as often."""
    kinds = [_signatures(spark, sf_dir, side).select(F.lit(side).alias("side"), F.col("net_id").alias("node"), F.struct("cell", "pin").alias("f")) for side in ("left", "right")]
    kinds = written(kinds[0].unionByName(kinds[1]).groupBy("side", "node", "f").agg(F.count("*").alias("n")), "kinds")
    classes = written(graphs.signature_classes(kinds.select("side", "node").distinct(), kinds), "classes")
    each = classes.groupBy("colour").agg(F.count_if(F.col("side") == "left").alias("n_left"), F.count_if(F.col("side") == "right").alias("n_right"), F.min("node").alias("first"))
    return classes.join(each, "colour").select("side", F.col("node").alias("net_id"), "first", "n_left", "n_right")


@query(SIGNED + "SELECT COUNT(*) AS n_matched FROM (SELECT signature FROM g WHERE side = 'left' INTERSECT ALL SELECT signature FROM g WHERE side = 'right')")
def q_net_matched_exact(spark, sf_dir):
    return scoring.nets_matched_exactly(*(_signatures(spark, sf_dir, side) for side in ("left", "right")))


@query(SIGNED + "SELECT COUNT(*) AS n_matched FROM (SELECT signature FROM g WHERE side = 'left' INTERSECT ALL SELECT signature FROM g WHERE side = 'right')")
def q_net_multiset(spark, sf_dir):
    return scoring.nets_matched(*(scoring.counted_signatures(_signatures(spark, sf_dir, side)) for side in ("left", "right")))


@query(SIGNED + "SELECT md5(signature) AS signature, net_id FROM (SELECT signature, net_id FROM g WHERE side = 'left' AND signature NOT IN (SELECT signature FROM g WHERE side = 'right') ORDER BY signature, net_id LIMIT 5)")
def q_net_unmatched(spark, sf_dir):
    return scoring.nets_unmatched(*(scoring.net_signatures(_signatures(spark, sf_dir, side)) for side in ("left", "right"))).select(F.md5("signature").alias("signature"), "net_id")


# -- waves ----------------------------------------------------------------------------------------------------------

WAVE = f"WITH {ctes('v_wave')} "
BIT = f"WITH {ctes('v_bits')} "


def _wave(spark, sf_dir):
    return view(spark, sf_dir, "v_wave").withColumnRenamed("event_id", "seq")


@query(WAVE + "SELECT signal, t, event_id AS seq, value FROM (SELECT *, LAG(value) OVER w AS b, row_number() OVER w AS k FROM v_wave WINDOW w AS (PARTITION BY signal ORDER BY t, event_id)) WHERE k = 1 OR value IS DISTINCT FROM b")
def q_vcd_changes(spark, sf_dir):
    return waves.changes(_wave(spark, sf_dir)).select("signal", "t", "seq", "value")


@query(WAVE + "SELECT signal, t, event_id AS seq FROM (SELECT *, LAG(value) OVER (PARTITION BY signal ORDER BY t, event_id) AS b FROM v_wave) WHERE b = 0 AND value = 1")
def q_edges(spark, sf_dir):
    return waves.edges(_wave(spark, sf_dir)).select("signal", "t", "seq")


LAST = "l AS (SELECT signal, t, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY signal, t ORDER BY event_id DESC) AS k FROM v_wave) WHERE k = 1), asked AS (SELECT DISTINCT v.signal, t.t FROM (SELECT DISTINCT signal FROM v_wave) v, (SELECT DISTINCT t FROM v_wave) t)"


def _asked(spark, sf_dir):
    wave = _wave(spark, sf_dir)
    signals = wave.select("signal").distinct()  # event types: a handful
    return dealt(wave.select("t"), "t").distinct().withColumn("signal", F.explode(F.lit([r.signal for r in signals.collect()])))


@query(WAVE + f", {LAST} SELECT a.signal, a.t, l.value FROM asked a ASOF LEFT JOIN l ON a.signal = l.signal AND a.t >= l.t")
def q_asof(spark, sf_dir):
    return waves.as_of(_asked(spark, sf_dir), _wave(spark, sf_dir))


@query(WAVE + f", {LAST} SELECT a.signal, a.t, l.value FROM asked a ASOF LEFT JOIN l ON a.signal = l.signal AND a.t > l.t")
def q_before_edge(spark, sf_dir):
    return waves.as_of(_asked(spark, sf_dir), _wave(spark, sf_dir), strictly_before=True)


@query(WAVE + f", {LAST}, x AS (SELECT a.signal, a.t, l.value FROM asked a ASOF LEFT JOIN l ON a.signal = l.signal AND a.t >= l.t), y AS (SELECT a.signal, a.t, l.value FROM asked a ASOF LEFT JOIN l ON a.signal = l.signal AND a.t > l.t) SELECT COUNT(*) AS n, COUNT(*) FILTER (x.value IS DISTINCT FROM y.value) AS n_mismatched FROM x JOIN y USING (signal, t)")
def q_replay_mismatch(spark, sf_dir):
    asked, wave = _asked(spark, sf_dir), _wave(spark, sf_dir)
    return waves.mismatches(waves.as_of(asked, wave), waves.as_of(asked, wave, strictly_before=True))


@query("WITH c AS (SELECT user_id, event_id, CAST(20 + (event_id // 2 * 13 + user_id) % 100 AS INT) AS code FROM events), f AS (SELECT *, LAG(code) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM c) SELECT user_id, string_agg(chr(code), '' ORDER BY event_id) AS text FROM f WHERE code BETWEEN 32 AND 126 AND code IS DISTINCT FROM b GROUP BY user_id")
def q_rle_text(spark, sf_dir):
    codes = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", F.expr("cast(20 + (event_id div 2 * 13 + user_id) % 100 as int)").alias("code"))
    return waves.run_text(codes, "user_id", "event_id", "code")


@query(BIT + "SELECT user_id, event_id, bit, CAST((row_number() OVER w - 1) % 11 AS INT) AS modulo, LEAST(CAST(SUM(bit) OVER r AS BIGINT), 3) AS saturating, MAX(bit) OVER r AS sticky, LAG(bit, 1) OVER w AS tap_1, LAG(bit, 10) OVER w AS tap_10, LAG(bit, 11) OVER w AS tap_11, LAG(bit, 12) OVER w AS tap_12 FROM v_bits WINDOW w AS (PARTITION BY user_id ORDER BY event_id), r AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def q_counters(spark, sf_dir):
    return waves.counters(view(spark, sf_dir, "v_bits"))
