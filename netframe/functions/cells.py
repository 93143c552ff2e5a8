"""The standard-cell library: three-valued functions as Spark boolean expressions, where NULL is the unknown value.

Spark's AND, OR and NOT on nullable booleans are the three-valued functions, and <> is exclusive or, so a cell's function is a
column expression over its input pins.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: each base cell's class, inputs, output and function
FUNCTIONS = """
buffer buf A X A
buffer bufbuf A X A
buffer clkbuf A X A
buffer dlygate4sd3 A X A
buffer inv A Y NOT A
buffer clkinv A Y NOT A
buffer einvp A,TE Z NOT A
basic and2 A,B X A AND B
basic and2b A_N,B X NOT A_N AND B
basic and3 A,B,C X A AND B AND C
basic and3b A_N,B,C X NOT A_N AND B AND C
basic and4 A,B,C,D X A AND B AND C AND D
basic and4b A_N,B,C,D X NOT A_N AND B AND C AND D
basic and4bb A_N,B_N,C,D X NOT (A_N OR B_N) AND C AND D
basic nand3b A_N,B,C Y NOT (NOT A_N AND B AND C)
basic or2 A,B X A OR B
basic or2b A,B_N X A OR NOT B_N
basic or3 A,B,C X A OR B OR C
basic or3b A,B,C_N X A OR B OR NOT C_N
basic or4 A,B,C,D X A OR B OR C OR D
basic or4b A,B,C,D_N X A OR B OR C OR NOT D_N
basic or4bb A,B,C_N,D_N X A OR B OR NOT (C_N AND D_N)
basic nand2 A,B Y NOT (A AND B)
basic nand2b A_N,B Y NOT (NOT A_N AND B)
basic nand3 A,B,C Y NOT (A AND B AND C)
basic nand4 A,B,C,D Y NOT (A AND B AND C AND D)
basic nor2 A,B Y NOT (A OR B)
basic nor2b A,B_N Y NOT (A OR NOT B_N)
basic nor3 A,B,C Y NOT (A OR B OR C)
basic nor3b A,B,C_N Y C_N AND NOT (A OR B)
basic nor4 A,B,C,D Y NOT (A OR B OR C OR D)
basic nor4b A,B,C,D_N Y NOT (A OR B OR C OR NOT D_N)
xor xor2 A,B X A <> B
xor xor3 A,B,C X (A <> B) <> C
xor xnor2 A,B Y NOT (A <> B)
xor xnor3 A,B,C Y NOT ((A <> B) <> C)
complex a21o A1,A2,B1 X (A1 AND A2) OR B1
complex a21oi A1,A2,B1 Y NOT ((A1 AND A2) OR B1)
complex a21bo A1,A2,B1_N X (A1 AND A2) OR NOT B1_N
complex a21boi A1,A2,B1_N Y NOT ((A1 AND A2) OR NOT B1_N)
complex a22o A1,A2,B1,B2 X (A1 AND A2) OR (B1 AND B2)
complex a22oi A1,A2,B1,B2 Y NOT ((A1 AND A2) OR (B1 AND B2))
complex a31o A1,A2,A3,B1 X (A1 AND A2 AND A3) OR B1
complex a31oi A1,A2,A3,B1 Y NOT ((A1 AND A2 AND A3) OR B1)
complex a32o A1,A2,A3,B1,B2 X (A1 AND A2 AND A3) OR (B1 AND B2)
complex a41o A1,A2,A3,A4,B1 X (A1 AND A2 AND A3 AND A4) OR B1
complex a211o A1,A2,B1,C1 X (A1 AND A2) OR B1 OR C1
complex a211oi A1,A2,B1,C1 Y NOT ((A1 AND A2) OR B1 OR C1)
complex a221o A1,A2,B1,B2,C1 X (A1 AND A2) OR (B1 AND B2) OR C1
complex a222oi A1,A2,B1,B2,C1,C2 Y NOT ((A1 AND A2) OR (B1 AND B2) OR (C1 AND C2))
complex a311o A1,A2,A3,B1,C1 X (A1 AND A2 AND A3) OR B1 OR C1
complex a2111o A1,A2,B1,C1,D1 X (A1 AND A2) OR B1 OR C1 OR D1
complex a2111oi A1,A2,B1,C1,D1 Y NOT ((A1 AND A2) OR B1 OR C1 OR D1)
complex a221oi A1,A2,B1,B2,C1 Y NOT ((A1 AND A2) OR (B1 AND B2) OR C1)
complex a41oi A1,A2,A3,A4,B1 Y NOT ((A1 AND A2 AND A3 AND A4) OR B1)
complex o21a A1,A2,B1 X (A1 OR A2) AND B1
complex o21ai A1,A2,B1 Y NOT ((A1 OR A2) AND B1)
complex o21ba A1,A2,B1_N X (A1 OR A2) AND NOT B1_N
complex o21bai A1,A2,B1_N Y NOT ((A1 OR A2) AND NOT B1_N)
complex o22a A1,A2,B1,B2 X (A1 OR A2) AND (B1 OR B2)
complex o22ai A1,A2,B1,B2 Y NOT ((A1 OR A2) AND (B1 OR B2))
complex o31a A1,A2,A3,B1 X (A1 OR A2 OR A3) AND B1
complex o31ai A1,A2,A3,B1 Y NOT ((A1 OR A2 OR A3) AND B1)
complex o32a A1,A2,A3,B1,B2 X (A1 OR A2 OR A3) AND (B1 OR B2)
complex o32ai A1,A2,A3,B1,B2 Y NOT ((A1 OR A2 OR A3) AND (B1 OR B2))
complex o41a A1,A2,A3,A4,B1 X (A1 OR A2 OR A3 OR A4) AND B1
complex o2bb2a A1_N,A2_N,B1,B2 X NOT (A1_N AND A2_N) AND (B1 OR B2)
complex o2bb2ai A1_N,A2_N,B1,B2 Y NOT (NOT (A1_N AND A2_N) AND (B1 OR B2))
complex o211a A1,A2,B1,C1 X (A1 OR A2) AND B1 AND C1
complex o211ai A1,A2,B1,C1 Y NOT ((A1 OR A2) AND B1 AND C1)
complex o221a A1,A2,B1,B2,C1 X (A1 OR A2) AND (B1 OR B2) AND C1
complex o311a A1,A2,A3,B1,C1 X (A1 OR A2 OR A3) AND B1 AND C1
other maj3 A,B,C X (A AND B) OR (B AND C) OR (A AND C)
other mux2 A0,A1,S X (A0 AND NOT S) OR (A1 AND S)
other mux2i A0,A1,S Y NOT ((A0 AND NOT S) OR (A1 AND S))
other mux4 A0,A1,A2,A3,S0,S1 X (A0 AND NOT S0 AND NOT S1) OR (A1 AND S0 AND NOT S1) OR (A2 AND NOT S0 AND S1) OR (A3 AND S0 AND S1)
other conb - HI TRUE
other conb - LO FALSE
"""

# fixed values: flip-flops as name, clock edge, reset, set, inverted output; drive strengths; cells without logic; supply pins
FLIP_FLOPS = (
    ("dfxtp", True, None, None, None),
    ("dfxbp", True, None, None, "Q_N"),
    ("dfrtp", True, "RESET_B", None, None),
    ("dfrbp", True, "RESET_B", None, "Q_N"),
    ("dfstp", True, None, "SET_B", None),
    ("dfsbp", True, None, "SET_B", "Q_N"),
    ("dfrtn", False, "RESET_B", None, None),
)
STRENGTHS = (1, 2, 4, 6, 8, 12, 16)
# decap_12 comes in two libraries; names here are without the library's prefix, so it is one
PHYSICAL = ("decap_3", "decap_4", "decap_6", "decap_8", "decap_12", "fill_1", "fill_2", "fill_4", "fill_8", "tap_1", "tap_2", "diode_2", "fakediode_2", "fill_diode_2", "tapvpwrvgnd_1")
SUPPLY_PINS = ("VPWR", "VGND", "VPB", "VNB")


def functions() -> list[tuple[str, str, list[str], str, str]]:
    """(class, base cell, inputs, output, expression), one for each output."""
    out = []
    for line in FUNCTIONS.strip().splitlines():
        kind, name, inputs, output, text = line.split(" ", 4)
        out.append((kind, name, [] if inputs == "-" else inputs.split(","), output, text))
    return out


def expression(base: str, pins: dict[str, str], output: str | None = None) -> str:
    """A cell's function as SQL over the columns (or expressions) in pins; a pin without one is unknown."""
    _, _, _, _, text = next(f for f in functions() if f[1] == base and output in (None, f[3]))
    return re.sub(r"\b(?!(?:AND|OR|NOT|TRUE|FALSE)\b)[A-Z]+[0-9]*(?:_N)?\b", lambda m: f"({pins.get(m[0]) or 'CAST(NULL AS BOOLEAN)'})", text)


def to_verilog(text: str) -> str:
    """An expression as Verilog writes it."""
    for a, b in ((" AND ", " & "), (" OR ", " | "), (" <> ", " ^ "), ("NOT ", "~"), ("TRUE", "1'b1"), ("FALSE", "1'b0")):
        text = text.replace(a, b)
    return text


def and_(*values: Column) -> Column:
    """All true; true without values."""
    return reduce(lambda a, b: a & b, values, F.lit(True)) if values else F.lit(True)


def or_(*values: Column) -> Column:
    return reduce(lambda a, b: a | b, values) if values else F.lit(False)


def xor_(*values: Column) -> Column:
    return reduce(lambda a, b: a != b, values) if values else F.lit(False)


def model_name(cell: Column) -> Column:
    """A cell's name as models has it: what follows the last double underscore."""
    return F.substring_index(cell, "__", -1)


def is_physical(cell: Column) -> Column:
    """The cell's model has no logic; a cell without a model isn't physical."""
    return model_name(cell).isin(*PHYSICAL)


def models(spark: SparkSession) -> DataFrame:
    """(cell, base, kind): every base cell in every drive strength, kind comb or seq, and physical cells."""
    bases = sorted({(f[1], "comb") for f in functions()} | {(f[0], "seq") for f in FLIP_FLOPS})
    base, strength = spark.createDataFrame(bases, "base string, kind string"), spark.createDataFrame([(s,) for s in STRENGTHS], "strength int")
    logic = base.crossJoin(F.broadcast(strength)).select(F.concat_ws("_", "base", F.col("strength").cast("string")).alias("cell"), "base", "kind")
    return logic.unionByName(spark.createDataFrame([(c, c.rpartition("_")[0], "physical") for c in PHYSICAL], "cell string, base string, kind string"))


def pins(spark: SparkSession) -> DataFrame:
    """(base, pin, direction, seq) of all pins, supply pins included."""
    rows = {(name, p, "input") for _, name, inputs, _, _ in functions() for p in inputs} | {(name, out, "output") for _, name, _, out, _ in functions()}
    for name, _, reset, preset, q_n in FLIP_FLOPS:
        rows |= {(name, p, "input") for p in ("CLK", "D", reset, preset) if p} | {(name, p, "output") for p in ("Q", q_n) if p}
    rows |= {(name, p, "inout") for name in {r[0] for r in rows} | {c.rpartition("_")[0] for c in PHYSICAL} for p in (SUPPLY_PINS[:2] if name == "tapvpwrvgnd" else SUPPLY_PINS)}
    return spark.createDataFrame(sorted(rows), "base string, pin string, direction string")


def verilog_stub(base: str, cell: str) -> str:
    """A behavioural module of one cell."""
    own = [f for f in functions() if f[1] == base]
    if own:
        ports = [*(f"input {p}" for p in own[0][2]), *(f"output {f[3]}" for f in own)]
        body = [f"  assign {f[3]} = {to_verilog(f[4])};" for f in own]
    else:
        name, posedge, reset, preset, q_n = next(f for f in FLIP_FLOPS if f[0] == base)
        ports = ["input CLK", "input D", *(f"input {p}" for p in (reset, preset) if p), "output reg Q", *([f"output {q_n}"] if q_n else [])]
        edges = [f"{'posedge' if posedge else 'negedge'} CLK", *(f"negedge {p}" for p in (reset, preset) if p)]
        body = [f"  always @({' or '.join(edges)})", "    " + "".join(f"if (!{p}) Q <= 1'b{v}; else " for p, v in ((reset, 0), (preset, 1)) if p) + "Q <= D;", *([f"  assign {q_n} = ~Q;"] if q_n else [])]
    return "\n".join([f"module {cell} ({', '.join(ports)});", *body, "endmodule", ""])


def stubs(spark: SparkSession, only: DataFrame | None = None) -> DataFrame:
    """(cell, text): a module for each model, or for those in only (cell), by name."""
    rows = [(b, verilog_stub(b, "@")) for b in sorted({f[1] for f in functions()} | {f[0] for f in FLIP_FLOPS})]
    found = models(spark).join(F.broadcast(spark.createDataFrame(rows, "base string, stub string")), "base")
    if only is not None:
        found = found.join(only.select("cell").distinct(), "cell", "left_semi")
    return found.select("cell", F.replace("stub", F.lit("@ ("), F.concat("cell", F.lit(" ("))).alias("text")).orderBy("cell")
