"""Sources and sinks: streams that the tests encode, and round trips."""

import json
import math
import random
import struct
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from netframe.operators import components, extract, inspect, scoring, waves
from netframe.plans import source_queries
from netframe.sources import defdb, documents, gds, jsonir, vcd, verilog
from netframe.streaming import monitor


def files(spark, *texts):
    return spark.createDataFrame([(f"f{k}", t) for k, t in enumerate(texts)], "path string, value string")


def held(folder):
    """The text of a written document."""
    return "".join(p.read_text() for p in sorted(folder.glob("part-*")))


VERILOG = r"""// a comment; with a semicolon
module top (a, clk, \out[0] , VPWR);
  input a, clk; inout VPWR;
  output \out[0] ;
  wire [3:0] unused; wire n1;
  /* block ; comment */ (* keep = "true" *)
  inv_1 u1 (.A(a), .Y(n1), .VPWR(VPWR));
  dfxtp_1 \a_reg[0] (.D(n1), .CLK(clk),
     .Q(\out[0] ), .X());
  decap_3 FILL_1 ();
  assign n2 = n1;
  buf_1 u2 (.A({n1, a}));
endmodule
module second (x); input x; endmodule
"""


def test_verilog(spark):
    v = verilog.StructuralVerilog(files(spark, VERILOG))
    assert v.modules().first().module == "top"
    assert {(r.name, r.direction) for r in v.ports().collect()} == {("a", "input"), ("clk", "input"), ("VPWR", "inout"), ("out[0]", "output")}
    inst = {r.inst_id: (r.name, r.cell) for r in v.instances().collect()}
    assert list(inst.values()) == [("u1", "inv_1"), ("a_reg[0]", "dfxtp_1"), ("FILL_1", "decap_3"), (inst[3][0], "$alias"), ("u2", "buf_1")]
    pins = {(r.inst_id, r.pin): r.net for r in v.pins().collect()}
    assert pins == {(0, "A"): "a", (0, "Y"): "n1", (0, "VPWR"): "VPWR", (1, "D"): "n1", (1, "CLK"): "clk", (1, "Q"): "out[0]", (1, "X"): None, (3, "A"): "n1", (3, "X"): "n2", (4, "A"): "${"}
    assert {r.name: r.kind for r in v.nets().collect()}["VPWR"] == "power"
    with pytest.raises(Exception, match="by position"):
        verilog.StructuralVerilog(files(spark, "module m (a); inv u (a, b); endmodule")).instances().collect()


def test_verilog_round_trip(spark, tmp_path):
    v = verilog.StructuralVerilog(files(spark, VERILOG))
    insts = v.instances().where("cell not in ('$alias', 'buf_1')").select("inst_id", "name", "cell")
    lines = verilog.to_verilog(insts, v.pins().where("inst_id < 3").select("inst_id", "pin", "net"), v.ports().select("name", "direction"), "top", physical=spark.createDataFrame([("decap_3",)], "cell string"))
    documents.write_lines(lines, f"file://{tmp_path}/out")
    text = "\n".join(p.read_text().rstrip("\n") for p in sorted((tmp_path / "out").glob("part-*")) if p.stat().st_size)
    again = verilog.StructuralVerilog(files(spark, text))
    assert {(r.name, r.cell) for r in again.instances().collect()} == {("u1", "inv_1"), ("a_reg[0]", "dfxtp_1")}
    assert {r.name for r in again.ports().collect()} == {"a", "clk", "out[0]"} and "VPWR" not in text
    assert again.pins().where("net = 'out[0]'").count() == 1


DEF = """VERSION 5.8 ;
DESIGN top ;
UNITS DISTANCE MICRONS 1000 ;
DIEAREA ( 0 -5 ) ( 5000 6000 ) ;
COMPONENTS 2 ;
 - u1 inv_1 + PLACED ( 100 200 ) N ;
 - u2 inv_1 + SOURCE DIST + FIXED ( -5 0 ) FS ;
END COMPONENTS
PINS 1 ;
 - a + NET a + DIRECTION INPUT + USE SIGNAL ;
END PINS
SPECIALNETS 1 ;
 - VPWR ( * VPWR ) + USE POWER + ROUTED met1 480 ( 1 2 ) ( 3 4 ) ;
END SPECIALNETS
NETS 2 ;
 - a ( PIN a ) ( u1 A ) + ROUTED met1 ( 5 6 ) ( 7 8 ) ;
 - n1 ( u1 Y )
   ( u2 A ) ;
END NETS
END DESIGN
"""


def test_def(spark):
    d = defdb.RoutedDatabase.of_texts(files(spark, DEF))
    assert tuple(d.design().first())[1:] == ("top", 1000, 0, -5, 5000, 6000)
    assert {tuple(r)[1:] for r in d.components().collect()} == {("u1", "inv_1", 100, 200, "N"), ("u2", "inv_1", -5, 0, "FS")}
    assert [tuple(r)[1:] for r in d.pins().collect()] == [("a", "input", "a")]
    assert {tuple(r)[1:] for r in d.net_pins().collect()} == {("VPWR", True, "*", "VPWR"), ("a", False, None, "a"), ("a", False, "u1", "A"), ("n1", False, "u1", "Y"), ("n1", False, "u2", "A")}


def test_vcd_round_trip(spark):
    waves = spark.createDataFrame([("clk", 0, 1, 0), ("clk", 5, 2, 1), ("clk", 5, 3, 1), ("d", 0, 4, None), ("d", 7, 5, 1)], "signal string, t long, seq long, value int")
    signals = spark.createDataFrame([("clk", 0), ("d", 100)], "signal string, n long")
    text = "\n".join(r.text for r in vcd.to_vcd(waves, signals).orderBy("part", "key").collect())
    read = vcd.parse_vcd(files(spark, text + "\n#9\nb01x !\n"))
    assert [(r.t, r.signal, r.value) for r in read.orderBy("seq").collect()] == [(0, "clk", "x"), (0, "d", "x"), (0, "clk", "0"), (5, "clk", "1"), (7, "d", "1"), (9, "clk", "01x")]
    frames = {r.t: r.signals for r in vcd.frames(read).collect()}
    assert frames[7] == {"clk": "1", "d": "1"} and frames[5] == {"clk": "1", "d": "x"}


def test_json_round_trip(spark, tmp_path):
    v = verilog.StructuralVerilog(files(spark, VERILOG))
    jsonir.write_json_netlist('a "b"', v.ports().select("name", "direction", "net"), v.nets().select("name", "kind"), v.instances().select("inst_id", "name", "cell"), v.pins().where("net is not null").select("inst_id", "pin", "net"), f"file://{tmp_path}/n")
    (tmp_path / "n.json").write_text(held(tmp_path / "n"))
    assert json.loads(held(tmp_path / "n"))["name"] == 'a "b"'
    read = jsonir.read_json_netlist(spark, f"file://{tmp_path}/n.json")
    assert {tuple(r) for r in read["pins"].collect()} == {tuple(r)[1:] for r in v.pins().where("net is not null").collect()}
    assert [r.name for r in read["instances"].orderBy("inst_id").collect()] == [r.name for r in v.instances().orderBy("inst_id").collect()]
    assert jsonir.stats_json(spark.createDataFrame([(1, "x")], "a int, b string")).first().value == '{"a":1,"b":"x"}'


def test_document(spark, tmp_path):
    """Counts and netlist as one document, whatever the parts it was written in; lists may be empty."""
    frame = spark.createDataFrame
    insts = frame([(k, f'u"{k}', "inv_1", 10 * k, 0, 90.0, k % 2 == 1, 0, 0, 5, 5) for k in range(3)], "inst_id long, name string, cell string, x long, y long, angle double, mirror boolean, xlo long, ylo long, xhi long, yhi long")
    pins = frame([(0, "A", 5), (0, "Y", 6), (1, "A", 6), (1, "Y", None)], "inst_id long, pin string, net_id long")
    nets = frame([(5, "in", True, "signal", 0, 0, 1, 1), (6, "n0", False, "signal", 2, 2, 3, 3)], "net_id long, name string, named_in_layout boolean, kind string, xlo long, ylo long, xhi long, yhi long")
    stats = frame([tuple(range(len(jsonir.COUNTS)))], ", ".join(f"{c} long" for c in jsonir.COUNTS.values()))
    warnings = frame([('a "quoted" one',), ("b",), ("b",)], "warning string")
    made = extract.Netlist(insts, pins, nets, frame([("in", "input", 5)], "name string, direction string, net_id long"), insts, stats, warnings, insts.select("cell"))
    jsonir.write_extraction(made, "to\"p", f"file://{tmp_path}/d")
    parts = [p.read_text() for p in sorted((tmp_path / "d").glob("part-*"))]
    doc = json.loads("".join(parts))
    assert list(doc) == ["stats", "netlist"] and doc["stats"]["nets_signal"] == 5 and doc["stats"]["warnings"] == ['a "quoted" one', "b"]
    assert doc["netlist"]["module"] == 'to"p' and doc["netlist"]["ports"] == [{"name": "in", "direction": "input", "net": "in"}]
    assert [n["bbox"] for n in doc["netlist"]["nets"]] == [[0, 0, 1, 1], [2, 2, 3, 3]] and [n["labelled"] for n in doc["netlist"]["nets"]] == [True, False]
    assert [i["connections"] for i in doc["netlist"]["instances"]] == [{"A": "in", "Y": "n0"}, {"A": "n0", "Y": ""}, {}]
    read = jsonir.read_document(spark, f"file://{tmp_path}/d")
    assert sorted(map(tuple, read["pins"].collect()), key=str) == [('u"0', "A", "in"), ('u"0', "Y", "n0"), ('u"1', "A", "n0"), ('u"1', "Y", None)]
    assert read["instances"].count() == 3 and [r.net for r in read["ports"].collect()] == ["in"]
    none = extract.Netlist(*(df.limit(0) for df in (insts, pins, nets, made.ports, insts)), stats, warnings.limit(0), insts.limit(0))
    jsonir.write_extraction(none, "m", f"file://{tmp_path}/none")
    assert json.loads(held(tmp_path / "none"))["netlist"] == {"module": "m", "ports": [], "nets": [], "instances": []}


# -- documents ------------------------------------------------------------------------------------------------------


def plain_document(rows, sections):
    return "".join(s.opening + s.separator.join(t for _, _, t in sorted(r for r in rows if r[0] == n)) + s.closing for n, s in enumerate(sections))


@pytest.mark.parametrize("counts", [(0, 0, 0), (1, 0, 0), (0, 0, 1), (40, 0, 300), (3, 500, 1)])
def test_documents_of_many_parts(spark, tmp_path, counts):
    """Whatever the parts, a document is its sections one after the other, empty ones included."""
    sections = [documents.Section("[", ",", "]"), documents.Section("<", "|", ">"), documents.Section("{", ";\n", "}")]
    rows = [(n, f"{k:05d}", f"é{n}.{k}") for n, count in enumerate(counts) for k in range(count)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "section int, key string, text string").repartition(5)
    documents.write_document(df, sections, f"file://{tmp_path}/d")
    assert held(tmp_path / "d") == plain_document(rows, sections)
    assert sum(documents.whole(f"file://{tmp_path}/d").values()) == len(held(tmp_path / "d").encode())
    assert [p.name for p in tmp_path.iterdir()] == ["d"]


def test_a_document_is_there_as_a_whole_or_not_at_all(spark, tmp_path):
    sections, schema = [documents.Section("[", ",", "]")], "section int, key string, text string"
    target = f"file://{tmp_path}/d"
    rows = spark.createDataFrame([(0, f"{k:03d}", str(k)) for k in range(200)], schema).repartition(4)
    killed = rows.select("section", "key", F.when(F.col("key") == "150", F.raise_error(F.lit("killed"))).otherwise(F.col("text")).alias("text"))
    for bad in (killed, rows.select("section", "key", F.when(F.col("key") < "199", F.col("text")).alias("text")), rows.select(F.lit(3).alias("section"), "key", "text")):
        with pytest.raises(Exception, match="killed|without section|no section"):
            documents.write_document(bad, sections, target)
        assert list(tmp_path.iterdir()) == []
    documents.write_document(rows, sections, target)
    with pytest.raises(Exception, match="there already"):
        documents.write_document(rows, sections, target)
    with pytest.raises(Exception, match="killed"):
        documents.write_document(killed, sections, target, overwrite=True)
    assert json.loads(held(tmp_path / "d")) == list(range(200))
    documents.write_document(rows.where("key < '003'"), sections, target, overwrite=True)
    assert held(tmp_path / "d") == "[0,1,2]" and len(list(tmp_path.iterdir())) == 1
    first = sorted((tmp_path / "d").glob("part-*"))[0]
    first.write_text(first.read_text() + " ")
    with pytest.raises(ValueError, match="whole"):
        documents.read_lines(spark, target)


def test_attempts_that_failed_leave_nothing(tmp_path):
    """A part written twice counts once; what a lost attempt has left goes; parts out of order are refused."""
    sections = [documents.Section("[", ",", "]")]
    batch = lambda *keys: iter([pa.RecordBatch.from_arrays([pa.array([0] * len(keys), pa.int32()), pa.array(list(keys)), pa.array(list(keys))], ["section", "key", "text"])])
    writer = documents.DocumentWriter(f"file://{tmp_path}/d", sections, False)
    writer.written(batch("a", "b"), 0, 7)  # lost
    writer.commit([writer.written(batch("c"), 3, 9), None, writer.written(iter([]), 2, 5), writer.written(batch("a", "b"), 0, 8)])
    assert held(tmp_path / "d") == "[a,b,c]" and sorted(p.name for p in (tmp_path / "d").glob("*-7")) == []
    wrong = documents.DocumentWriter(f"file://{tmp_path}/e", sections, False)
    with pytest.raises(ValueError, match="out of order"):
        wrong.commit([wrong.written(batch("b"), 0, 1), wrong.written(batch("a"), 1, 2)])
    with pytest.raises(ValueError, match="out of order"):
        wrong.written(batch("b", "a"), 0, 3)
    wrong.abort([])
    assert [p.name for p in tmp_path.iterdir()] == ["d"]


def test_written_verilog_is_read_by_many_tasks(spark, tmp_path):
    v = verilog.StructuralVerilog(files(spark, VERILOG))
    insts = v.instances().where("cell not in ('$alias', 'buf_1')").select("inst_id", "name", "cell")
    tables = insts, v.pins().where("inst_id < 3").select("inst_id", "pin", "net"), v.ports().select("name", "direction")
    verilog.write_verilog(*tables, "top", f"file://{tmp_path}/v", power=True, header="made")
    assert held(tmp_path / "v").startswith("// made\nmodule top (") and held(tmp_path / "v").endswith("endmodule\n")
    lines = "".join(r.text + "\n" for r in verilog.to_verilog(*tables, "top", power=True, header="made").orderBy("part", "key").collect())
    assert held(tmp_path / "v") == lines
    read = verilog.read_written(spark, f"file://{tmp_path}/v")
    named = lambda made: {(r.name, r.cell, r.pin, r.net) for r in made.pins().join(made.instances(), ["path", "inst_id"]).collect()}
    assert named(read) == named(verilog.StructuralVerilog(files(spark, lines))) and len(named(read)) == 7
    assert {(r.name, r.direction) for r in read.ports().collect()} == {("a", "input"), ("clk", "input"), ("VPWR", "inout"), ("out[0]", "output")}
    assert read.modules().first().module == "top"


# -- layout streams -------------------------------------------------------------------------------------------------


def record(kind, dtype=0, body=b""):
    return struct.pack(">HBB", len(body) + 4, kind, dtype) + body


def i16(*v):
    return struct.pack(f">{len(v)}h", *v)


def i32(*v):
    return struct.pack(f">{len(v)}i", *v)


def name(s):
    raw = s.encode()
    return raw + b"\0" * (len(raw) & 1)


def box(layer, datatype, x0, y0, x1, y1):
    return record(gds.BOUNDARY) + record(gds.LAYER, 2, i16(layer)) + record(gds.DATATYPE, 2, i16(datatype)) + record(gds.XY, 3, i32(x0, y0, x1, y0, x1, y1, x0, y1, x0, y0)) + record(gds.ENDEL)


def label(layer, x, y, s):
    return record(gds.TEXT) + record(gds.LAYER, 2, i16(layer)) + record(gds.TEXTTYPE, 2, i16(5)) + record(gds.XY, 3, i32(x, y)) + record(gds.STRING, 6, name(s)) + record(gds.ENDEL)


def place(cell, x, y, mirror=False):
    return record(gds.SREF) + record(gds.SNAME, 6, name(cell)) + (record(gds.STRANS, 1, struct.pack(">H", 0x8000)) if mirror else b"") + record(gds.XY, 3, i32(x, y)) + record(gds.ENDEL)


def cell(s, *elements):
    return record(gds.BGNSTR, 2, i16(*range(12))) + record(gds.STRNAME, 6, name(s)) + b"".join(elements) + record(gds.ENDSTR)


def stream(*cells):
    units = bytes.fromhex("3E4189374BC6A7F0" "3944B82FA09B5A54")
    return record(0, 2, i16(600)) + record(gds.BGNLIB, 2, i16(*range(12))) + record(gds.LIBNAME, 6, name("lib")) + record(gds.UNITS, 5, units) + b"".join(cells) + record(gds.ENDLIB) + b"\0" * 64


INV = cell("inv_1", box(67, 20, 0, 0, 20, 20), label(67, 10, 10, "A"), box(67, 20, 80, 0, 100, 20), label(67, 90, 10, "Y"))


def test_layout_stream(spark, tmp_path):
    array = record(gds.AREF) + record(gds.SNAME, 6, name("inv_1")) + record(gds.ANGLE, 5, bytes.fromhex("425A000000000000")) + record(gds.COLROW, 2, i16(3, 2)) + record(gds.XY, 3, i32(0, 0, 301, 0, 0, -201)) + record(gds.ENDEL)
    path = record(gds.PATH) + record(gds.LAYER, 2, i16(68)) + record(gds.DATATYPE, 2, i16(20)) + record(gds.PATHTYPE, 2, i16(2)) + record(gds.WIDTH, 3, i32(14)) + record(gds.XY, 3, i32(0, 0, 50, 0)) + record(gds.ENDEL)
    (tmp_path / "a.gds").write_bytes(stream(INV, cell("top", place("inv_1", -5, 7, True), array, path)))
    g = gds.read_gds(spark, f"file://{tmp_path}/a.gds")
    lib = g.library().first()
    assert lib.lib == "lib" and abs(lib.user_unit - 0.001) < 1e-12 and abs(lib.db_unit_m - 1e-9) < 1e-18
    assert {r.cell for r in g.cells().collect()} == {"inv_1", "top"}
    assert {(r.cell, r.layer, r.datatype, len(r.ring)) for r in g.boundaries().collect()} == {("inv_1", 67, 20, 5)}
    assert {(r.x, r.y, r.value) for r in g.texts().collect()} == {(10, 10, "A"), (90, 10, "Y")}
    assert [(r.width, r.path_type, len(r.pts)) for r in g.paths().collect()] == [(14, 2, 2)]
    refs = {r.n_cols: r for r in g.references().collect()}
    assert (refs[1].ox, refs[1].oy, refs[1].mirror, refs[1].angle) == (-5, 7, True, 0)
    assert (refs[3].n_rows, refs[3].col_dx, refs[3].row_dy, refs[3].angle, refs[3].mirror) == (2, 100, -100, 90, False)
    (tmp_path / "b.gds").write_bytes(b"\xff\xff\x00\x02")
    with pytest.raises(Exception, match="bad record"):
        gds.read_gds(spark, f"file://{tmp_path}/b.gds").cells().collect()


RANGE = {"path": pa.string(), "length": pa.int64(), "begin": pa.int64(), "end": pa.int64(), "entry": pa.int64(), "content": pa.binary(), "cells_before": pa.int64(), "name_before": pa.string(), "elements_before": pa.int64(), "section": pa.string(), "t": pa.int64()}


def run(function, *rows):
    """A task's function over rows of ranges."""
    batch = pa.RecordBatch.from_pylist([dict.fromkeys(RANGE) | r for r in rows], schema=pa.schema(list(RANGE.items())))
    return [x for out in function(iter([batch])) for x in out.to_pylist()]


def ranges_of(data, *cuts):
    ends = [*cuts, len(data)]
    return [{"path": "f", "length": len(data), "begin": a, "end": b, "content": data} for a, b in zip([0, *cuts], ends, strict=True)]


def test_layout_cut_at_every_byte():
    """Two ranges, wherever the cut is: where the second one's guess agrees with the first one's end, both together give the rows of one range."""
    whole = ranges_of(SMALL := stream(INV, cell("top", place("inv_1", -5, 7, True), box(67, 20, 1, 2, 3, 4), label(67, 1, 2, "abc")), cell("inv_1", box(1, 2, 3, 4, 5, 6))))[0] | {"entry": 0, "cells_before": 0, "elements_before": 0}
    want, agreed = [run(f, whole) for f in (gds.elements, gds.framed)], 0
    assert len(want[0]) == 8 and len(want[1]) > 50
    for cut in range(1, len(SMALL)):
        first, second = run(gds.follow, *ranges_of(SMALL, cut))
        if first["leave"] == gds.ENDED:
            rows = [whole | {"end": cut}]
        elif second["entry"] == first["leave"]:
            agreed += 1
            rows = [whole | {"end": cut}, whole | {"begin": cut, "entry": second["entry"], "cells_before": first["n_cells"], "name_before": first["last_name"], "elements_before": first["n_elements"]}]
        else:
            continue
        assert [run(f, *rows) for f in (gds.elements, gds.framed)] == want
    assert agreed > 0.9 * (len(SMALL) - 64)


def test_layout_in_many_ranges(spark, tmp_path):
    """Records that stand in another record's body lead guesses astray; agreement along the file puts that right, also where it ends early."""
    fake = record(gds.BOUNDARY) + record(gds.LAYER, 2, i16(1)) + record(gds.BGNSTR, 2, i16(*range(12))) + record(gds.STRNAME, 6, b"no") + record(gds.ENDEL)
    traps = [record(gds.BOUNDARY) + record(0x2C, 6, fake * 40 + record(gds.ENDLIB) + fake[:-2]) + record(gds.LAYER, 2, i16(k)) + record(gds.DATATYPE, 2, i16(0)) + record(gds.XY, 3, i32(*range(2 * k + 8))) + record(gds.ENDEL) for k in range(12)]
    data = stream(INV, cell("top", *traps[:6], place("inv_1", 1, 2), *(box(67, 20, i, 0, i + 5, 20) for i in range(100))), cell("other", *traps[6:], label(67, 1, 2, "x")))
    (tmp_path / "a.gds").write_bytes(data)
    (tmp_path / "b.gds").write_bytes(stream(INV))
    whole = gds.read_gds(spark, f"file://{tmp_path}/*.gds")
    cut = gds.read_gds(spark, f"file://{tmp_path}/*.gds", range_bytes=1500)
    assert whole.ranges.count() == 2 and cut.ranges.count() > 4
    rows = [sorted((r.path, r.cell_id, r.cell, r.seq, r.kind, bytes(r.xy)) for r in g.elements().collect()) for g in (whole, cut)]
    assert rows[0] == rows[1] and len(rows[0]) == 4 + 12 + 1 + 100 + 1 + 4
    assert sorted(map(tuple, cut.cells().collect())) == sorted(map(tuple, whole.cells().collect()))
    (tmp_path / "c.gds").write_bytes(data[:4000] + b"\0\1" + data[4000:])
    with pytest.raises(Exception, match="c.gds: bad record"):
        gds.read_gds(spark, f"file://{tmp_path}/c.gds", range_bytes=3000).boundaries().collect()
    (tmp_path / "d.gds").write_bytes(b"xy")
    with pytest.raises(Exception, match="not a layout stream"):
        gds.read_gds(spark, f"file://{tmp_path}/d.gds").cells().collect()


def test_database_and_waves_cut_at_every_byte():
    data = DEF.replace("( 5 6 )", "# a ; comment\n ( 5 6 )").encode()
    whole = run(defdb._statements, *ranges_of(data))
    assert len(whole) == 15 and {r["section"] for r in whole} == {None, "COMPONENTS", "PINS", "SPECIALNETS", "NETS"}
    for cut in range(1, len(data)):
        head = run(defdb._heads, *ranges_of(data, cut))[0]["last"]
        first, second = ranges_of(data, cut)
        assert run(defdb._statements, first, second | {"section": head}) == whole
    waves = b"$var wire 1 ! clk $end\n$enddefinitions $end\nx!\n#0\n0!\r\n#5\n1!\nb01 !\n\n#17\n0!\n1!"
    whole = run(vcd._parsed, *ranges_of(waves))
    assert [(r["t"], r["value"]) for r in whole] == [(0, None), (0, "x"), (0, "0"), (5, "1"), (5, "01"), (17, "0"), (17, "1")]
    for cut in range(1, len(waves)):
        first, second = ranges_of(waves, cut)
        assert run(vcd._parsed, first, second | {"t": run(vcd._times, first)[0]["last"]}) == whole


def test_database_and_waves_in_many_ranges(spark, tmp_path):
    (tmp_path / "a.def").write_text(DEF)
    cut = defdb.read_def(spark, f"file://{tmp_path}/a.def", range_bytes=40)
    plain = defdb.RoutedDatabase.of_texts(files(spark, DEF))
    for table in ("components", "pins", "net_pins", "design"):
        assert sorted((tuple(r)[1:] for r in getattr(cut, table)().collect()), key=repr) == sorted((tuple(r)[1:] for r in getattr(plain, table)().collect()), key=repr)
    text = "$var wire 1 ! clk $end\n$enddefinitions $end\n" + "".join(f"#{t}\n{t % 2}!\n" for t in range(200))
    (tmp_path / "a.vcd").write_text(text)
    (tmp_path / "b.vcd").write_text("")
    read = vcd.read_vcd(spark, f"file://{tmp_path}/*.vcd", range_bytes=64)
    assert [(r.t, r.signal, r.value) for r in read.orderBy("seq").collect()] == [(t, "clk", str(t % 2)) for t in range(200)]


def test_extract(spark, tmp_path):
    """Two inverters in a row: in, middle (over a higher level, by cuts) and out."""
    wires = [box(67, 20, 100, 5, 200, 15), box(67, 44, 150, 6, 156, 12), box(68, 20, 145, 0, 400, 20), box(67, 44, 305, 6, 310, 12), box(67, 20, 300, 0, 311, 20), box(67, 20, -50, 5, 0, 15), label(67, -40, 10, "in"), box(67, 20, 400, 5, 500, 15), label(67, 490, 10, "out"), label(67, 5000, 10, "nowhere")]
    (tmp_path / "x.gds").write_bytes(stream(INV, cell("top", place("inv_1", 0, 0), place("inv_1", 300, 0), *wires)))
    n = extract.extract(gds.read_gds(spark, f"file://{tmp_path}/x.gds"))
    names = {r.net_id: r.name for r in n.nets.collect()}
    pins = {(r.inst_id, r.pin): names[r.net_id] for r in n.pins.collect()}
    first, second = (r.inst_id for r in n.instances.orderBy("x").collect())
    assert pins[first, "A"] == "in" and pins[second, "Y"] == "out" and pins[first, "Y"] == pins[second, "A"] and len(names) == 3
    assert {(r.name, r.direction) for r in n.ports.collect()} == {("in", "input"), ("out", "output")}
    stats = n.stats.first()
    assert (stats.instances, stats.nets, stats.labels, stats.unbound, stats.polygons, stats.warnings) == (2, 3, 7, 1, 11, 1)
    assert {r.name for r in n.instances.collect()} == {"inv_0", "inv_1"}


def test_extract_wires_drawn_as_paths(spark, tmp_path):
    """The inverters are joined by paths only: one with a bend, and one of no width, which is no metal."""
    def wire(width, *pts):
        return record(gds.PATH) + record(gds.LAYER, 2, i16(67)) + record(gds.DATATYPE, 2, i16(20)) + record(gds.WIDTH, 3, i32(width)) + record(gds.XY, 3, i32(*pts)) + record(gds.ENDEL)

    wires = [wire(6, 90, 10, 200, 10, 200, 40, 250, 40), wire(6, 247, 40, 260, 40, 260, 10, 310, 10), wire(0, -50, 10, 10, 10), wire(6, 390, 10, 500, 10), label(67, 490, 10, "out"), label(67, -40, 10, "in")]
    (tmp_path / "p.gds").write_bytes(stream(INV, cell("top", place("inv_1", 0, 0), place("inv_1", 300, 0), *wires)))
    n = extract.extract(gds.read_gds(spark, f"file://{tmp_path}/p.gds"))
    names = {r.net_id: r.name for r in n.nets.collect()}
    pins = {(r.inst_id, r.pin): names[r.net_id] for r in n.pins.collect()}
    first, second = (r.inst_id for r in n.instances.orderBy("x").collect())
    assert pins[first, "Y"] == pins[second, "A"] and pins[second, "Y"] == "out" and len(names) == 3
    assert n.stats.first().polygons == 4 + 3 + 3 + 1
    assert [r.warning for r in n.warnings.collect()] == ["label in at (-40, 10) on li1 is on no metal"]


def supplied(s, *more):
    """A cell with its rails, and a pin A on both ends of the row."""
    return cell(s, box(67, 20, 0, 0, 20, 20), label(67, 10, 10, "A"), box(68, 20, 0, 40, 100, 50), label(68, 5, 45, "VPWR"), box(68, 20, 0, -50, 100, -40), label(68, 5, -45, "VGND"), *more)


def test_extract_models_and_body_pins(spark, tmp_path):
    """Cells without logic go by their model, not by how their names begin; unknown cells stay, without body pins."""
    cells = [supplied("lib__inv_1", box(67, 20, 60, 0, 80, 20), label(67, 70, 10, "A"), label(67, 70, 300, "Y")), supplied("lib__tap_1"), supplied("tapestry_1"), supplied("lib__tapvpwrvgnd_1")]
    placed = [place(c, 200 * k, 0) for k, c in enumerate(("lib__inv_1", "lib__tap_1", "tapestry_1", "lib__tapvpwrvgnd_1"))]
    (tmp_path / "m.gds").write_bytes(stream(*cells, cell("top", *placed, box(68, 20, 0, 40, 900, 50), label(68, 150, 45, "VPWR"))))
    g = gds.read_gds(spark, f"file://{tmp_path}/m.gds")
    n = extract.extract(g)
    assert {r.name for r in n.instances.collect()} == {"inv_0", "tapestry_0"} and {r.cell for r in n.unknown_cells.collect()} == {"tapestry_1"}
    assert {r.pin for r in n.pins.collect()} == {"A"}
    stats = n.stats.first()
    assert (stats.split_pins, stats.inferred_body_pins, stats.unknown_cells, stats.unbound, stats.logic_instances, stats.nets, stats.signal_nets) == (1, 0, 1, 1, 2, 3, 2)
    assert {r.warning for r in n.warnings.collect()} == {"pin inv_0.A is on 2 nets", "cell tapestry_1 has no model", "label Y at (70, 300) on li1 is on no metal"}
    full = extract.extract(g, keep_physical=True, keep_power=True)
    names = {r.inst_id: r.cell for r in full.instances.collect()}
    pins = {}
    for r in full.pins.collect():
        pins.setdefault(names[r.inst_id], set()).add(r.pin)
    rails = {"A", "VPWR", "VGND"}
    assert pins == {"lib__inv_1": rails | {"VPB", "VNB"}, "lib__tap_1": rails | {"VPB", "VNB"}, "tapestry_1": rails, "lib__tapvpwrvgnd_1": rails}
    assert (full.stats.first().inferred_body_pins, full.stats.first().logic_instances) == (4, 2)
    assert extract.extract(g, keep_power=True, infer_body_pins=False).stats.first().inferred_body_pins == 0


def test_extract_turned_arrays_and_scales(spark, tmp_path):
    """Columns of the array run upwards, rows to the left; one inverter is twice as large, one has an odd angle. Boxes hold what is drawn, or the abutment box."""
    turned = record(gds.AREF) + record(gds.SNAME, 6, name("inv_1")) + record(gds.ANGLE, 5, bytes.fromhex("425A000000000000")) + record(gds.COLROW, 2, i16(3, 2)) + record(gds.XY, 3, i32(0, 0, 0, 600, -400, 0)) + record(gds.ENDEL)
    strans = record(gds.STRANS, 1, struct.pack(">H", 0))
    twice = record(gds.SREF) + record(gds.SNAME, 6, name("inv_1")) + strans + record(gds.MAG, 5, bytes.fromhex("4120000000000000")) + record(gds.XY, 3, i32(5000, 0)) + record(gds.ENDEL)
    odd = record(gds.SREF) + record(gds.SNAME, 6, name("buf_1")) + strans + record(gds.ANGLE, 5, bytes.fromhex("422D800000000000")) + record(gds.XY, 3, i32(9000, 0)) + record(gds.ENDEL)
    buf = cell("buf_1", box(67, 20, 0, 0, 20, 20), label(67, 10, 10, "A"), box(81, 4, 0, 0, 100, 100))
    (tmp_path / "t.gds").write_bytes(stream(INV, buf, cell("top", turned, twice, odd)))
    g = gds.read_gds(spark, f"file://{tmp_path}/t.gds")
    n = extract.extract(g)
    boxes = sorted((r.xlo, r.ylo, r.xhi, r.yhi) for r in n.instances.where("cell = 'inv_1'").collect())
    assert boxes == sorted([(x - 20, y, x, y + 100) for x in (0, -200) for y in (0, 200, 400)] + [(5000, 0, 5200, 40)])
    c, s = math.cos(math.radians(45.5)), math.sin(math.radians(45.5))
    r = n.instances.where("cell = 'buf_1'").first()
    assert r.angle == 45.5 and (r.xlo, r.ylo, r.xhi, r.yhi) == (9000 - round(100 * s), 0, 9000 + round(100 * c), round(100 * (s + c)))
    assert n.stats.first().polygons == 16 and n.stats.first().rectangles == 15 and n.stats.first().labels == 15 and n.stats.first().unbound == 0 and n.stats.first().diagonal == 1
    assert [tuple(r)[1:] for r in inspect.labels_listed(g.texts()).collect()] == [("buf_1", 6, "A@67/5"), ("inv_1", 2, "A@67/5"), ("inv_1", 4, "Y@67/5")]


def test_extracted_tables_are_dealt(spark):
    """Instances and nets are put together in as many tasks as a shuffle has, however small they are: adaptive execution would join them. Nothing is broadcast, as at size."""
    limit = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(limit, "-1")
    n = source_queries._extracted(spark, "/root/testdata/sf0.001")
    assert n.instances.count() == 1200 and {r.kind for r in n.nets.select("kind").distinct().collect()} == {"power", "signal"}
    parts = [made.rdd.getNumPartitions() for made in (n.instances, n.nets)]
    spark.conf.unset(limit)
    assert min(parts) >= components.n_parts(spark)


def test_extraction_against_a_database(spark, tmp_path):
    """Two of three placements and two of three nets are as the database has them."""
    wires = [box(67, 20, 100, 5, 300, 15), box(67, 20, -50, 5, 0, 15), label(67, -40, 10, "in"), box(67, 20, 400, 5, 500, 15), label(67, 490, 10, "q")]
    (tmp_path / "d.gds").write_bytes(stream(INV, cell("top", place("inv_1", 0, 0), place("inv_1", 300, 20, True), *wires)))
    database = defdb.RoutedDatabase.of_texts(files(spark, """DESIGN top ;
COMPONENTS 3 ;
 - a inv_1 + PLACED ( 0 0 ) N ;
 - b inv_1 + PLACED ( 300 0 ) FS ;
 - c inv_1 + PLACED ( 300 20 ) N ;
END COMPONENTS
NETS 3 ;
 - in ( PIN in ) ( a A ) ;
 - mid ( a Y ) ( b A ) ;
 - out ( PIN out ) ( b Y ) ;
END NETS
END DESIGN
"""))
    n = extract.extract(gds.read_gds(spark, f"file://{tmp_path}/d.gds"))
    assert tuple(scoring.database_check(n, database).first()) == (3, 2, 3, 2)


def test_changes_of_a_late_stream(spark, tmp_path):
    """A stream out of order, in small batches: the rows of the operator over the whole table; a signal that falls silent is let go."""
    made = random.Random(8)
    rows = [(made.choice(["clk", "clk", "d", "q"]), 1_700_000_000_000 + 1000 * (k + made.randrange(-5, 6)), k, made.choice([0, 1, None])) for k in range(240)]
    rows.sort(key=lambda r: r[1] + made.randrange(-4000, 4000))
    schema = "signal string, ts timestamp, seq long, value int"
    frame = lambda part: spark.createDataFrame(part, "signal string, ms long, seq long, value int").select("signal", F.timestamp_millis("ms").alias("ts"), "seq", "value")
    ends = [[("flush", 1_700_000_000_000 + 1000 * t, 10_000 + t, 1)] for t in (2000, 2001, 20_000, 20_001)]  # push the watermark on, twice past the end
    parts = [rows[k : k + 80] for k in range(0, 240, 80)] + ends
    for part in parts:
        frame(part).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        time.sleep(0.02)

    def read(name, function):
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
        q = function(source, "30 seconds", 1_000_000).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None
        return sorted(((r.signal, r.seq, r.value) for r in spark.table(name).where("signal <> 'flush'").collect()), key=str), q.lastProgress.stateOperators[0].numRowsTotal

    table = frame(rows).select("signal", F.unix_millis("ts").alias("t"), "seq", "value")
    for name, function, whole in (("changed", monitor.changes_of_stream, waves.changes), ("rising", monitor.edges_of_stream, waves.edges)):
        got, left = read(name, function)
        assert got == sorted(((r.signal, r.seq, r.value) for r in whole(table).collect()), key=str) and len(got) > 20
        assert left == 1  # only the signal that has come last
