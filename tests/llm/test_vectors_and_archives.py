"""Hard negatives, centroids and WARC bundles against brute force, SQL and plain readers."""

import hashlib
import io
import math
import random

import duckdb
import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs

from netframe.llm import centroids, hard_negatives, queries, warc
from netframe.llm.vectors import MAX_COMPONENT

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int"


def whole(vec):
    return [max(-MAX_COMPONENT, min(MAX_COMPONENT, math.floor(256 * float(x)))) for x in vec]


def usable(vec):
    return vec is not None and all(x is not None and math.isfinite(x) for x in vec)


def against_sql(spark, name, table):
    duck = duckdb.connect()
    duck.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    found = duck.execute(queries.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(found.fetchall(), key=repr)


@pytest.mark.parametrize(("name", "table"), [("op11_hard_negatives", "embeddings"), ("op12_centroids", "embeddings"), ("op13_warc", "pages")])
def test_query(spark, name, table):
    against_sql(spark, name, table)


# -- hard negatives -------------------------------------------------------------------------------------------------


def plain_negatives(rows, every=50, n_pos=5, n_neg=3):
    rows = [(i, whole(v), label) for i, v, label in rows if i is not None and label is not None and usable(v)]
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))  # noqa: E731  the longer one's rest meets zeros
    out = []
    for a, av, label in rows:
        if a % every:
            continue
        ranked = sorted((-score(av, v), i, own == label) for i, v, own in rows if i != a)
        for s, p, _ in [x for x in ranked if x[2]][:n_pos]:
            band = [(i, n) for n, i, alike in ranked if not alike and 50 * -s <= 100 * -n <= 95 * -s][:n_neg]
            out += [(a, p, k, i, -s, -n) for k, (i, n) in enumerate(band, 1)]
    return sorted(out)


def mixed_vectors(n=400, seed=3):
    made = random.Random(seed)
    base = [[made.gauss(0, 0.3) for _ in range(8)] for _ in range(6)]
    rows = [(i, [x + made.gauss(0, 0.15) for x in base[i % 6]], made.choice([i % 6, 1])) for i in range(n)]
    hot = rows[5][1]
    rows += [(1000 + i, hot, i % 2) for i in range(150)]  # one vector that many rows have, under two labels
    rows += [(50, rows[50][1], 2), (50, rows[50][1], 2), (7, hot, 3), (-50, hot, 1), (0, [0.0] * 8, 0)]  # repeated anchors, anchors below zero
    rows += [(None, hot, 1), (100, None, 1), (150, hot, None), (200, [0.1, None], 1), (250, [float("nan")] * 8, 1), (300, [float("inf")] * 8, 1)]
    rows += [(2000, [], 1), (2050, [0.5, 0.5], 1), (2100, [*hot, 0.7, -0.7], 2), (2001, [3e38] * 8, 1), (2150, [-3e38] * 8, 2)]
    return rows


@pytest.mark.parametrize("parts", [1, 5])
def test_hard_negatives(spark, parts, monkeypatch):
    monkeypatch.setattr(hard_negatives, "TILE", 32)
    rows = mixed_vectors()
    table = spark.createDataFrame(rows, VECTORS).repartition(parts)
    got = hard_negatives.mine_hard_negatives(table)
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert got.columns == columns
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows)


def test_hard_negatives_clashes_and_empty(spark):
    table = spark.createDataFrame(mixed_vectors(60)[:60], VECTORS).selectExpr("*", "1 AS q", "2 AS block", "'x' AS score", "3 AS pos")
    assert hard_negatives.mine_hard_negatives(table).count() == len(plain_negatives(mixed_vectors(60)[:60]))
    assert hard_negatives.mine_hard_negatives(spark.createDataFrame([], VECTORS)).count() == 0
    assert hard_negatives.mine_hard_negatives(spark.createDataFrame([(50, [1.0], 1)], VECTORS)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([1, 3, 8, 64]), st.sampled_from([1, 100, 10**5, MAX_COMPONENT]))
def test_search_loses_no_pair(seed, width, size):
    """Whatever the rotation and the size of components, what may reach the threshold is scored, and exactly."""
    made = np.random.default_rng(seed)
    a, b = (made.integers(-size, size + 1, (n, width)) for n in (20, 150))
    rotation = np.linalg.qr(made.normal(size=(width, width)))[0]
    anchors, rows = (hard_negatives.block_of(np.arange(len(x)), np.zeros(len(x), np.int64), x, rotation) for x in (a, b))
    exact = a @ b.T
    least = np.sort(exact, axis=1)[:, -5].astype(np.float64)
    search = hard_negatives.Search(anchors, width)
    i, j, s = search.scores(rows, slice(None), least, np.full(20, np.inf), np.ones(exact.shape, bool), seed % 2 * 5)
    assert (s == exact[i, j]).all() and (np.bincount(i[s >= least[i]], minlength=20) == (exact >= least[:, None]).sum(1)).all()


def test_leading_components_let_pairs_go():
    """Where vectors lie near a few directions, most pairs are let go before any integer product."""
    made = np.random.default_rng(1)
    x = (made.normal(size=(3000, 4)) @ made.normal(size=(4, 64)) * 30 + made.normal(size=(3000, 64))).astype(np.int64)
    rotation = np.linalg.eigh((x.T @ x).astype(np.float64))[1][:, ::-1]
    block = hard_negatives.block_of(np.arange(3000), np.zeros(3000, np.int64), x, rotation)
    search = hard_negatives.Search(block.part(slice(0, 50)), 64)
    kept = search.positives(block, 5)
    assert len(kept[0]) == 250 and search.scored < search.pairs / 4


# -- centroids ------------------------------------------------------------------------------------------------------


def plain_clusters(rows, width=64, k=40, rounds=5):
    kept = [(i, whole(v)) for i, v, *_ in rows if v is not None and len(v) == width and usable(v)]
    starts = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    now = [v for _, v in starts[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda: [min((apart(v, c), n) for n, c in enumerate(now)) for _, v in kept]
    for _ in range(rounds):
        own = [n for _, n in nearest()]
        for n in set(own):
            group = [v for (_, v), m in zip(kept, own, strict=True) if m == n]
            now[n] = [sum(x) // len(group) for x in zip(*group, strict=True)]
    at = nearest()
    sums = {n: sum(d for d, m in at if m == n) for n in range(len(now))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return sorted(((i, n, d, sums[n], sum(sums.values()), digest[n]) for (i, _), (d, n) in zip(kept, at, strict=True)), key=repr)


def test_clusters(spark):
    made = random.Random(5)
    base = [[made.gauss(0, 0.4) for _ in range(6)] for _ in range(4)]
    rows = [(i, [x + made.gauss(0, 0.1) for x in base[i % 4]]) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(150)] + [(3, rows[3][1]), (None, rows[9][1]), (5, [0.0] * 6)]
    rows += [(600, None), (601, [0.1] * 5), (602, [0.1] * 7), (603, [None] * 6), (604, [float("nan")] * 6), (605, [float("-inf")] * 6), (606, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS cluster", "2 AS q", "3 AS upper").repartition(3)
    got = centroids.cluster_vectors(table, width=6, k=9)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_clusters(rows, width=6, k=9)


def test_few_vectors_and_none(spark):
    rows = [(i, [float(i), 1.0]) for i in range(3)]
    got = centroids.cluster_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), width=2)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_clusters(rows, width=2)
    empty = centroids.cluster_vectors(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>"))
    assert empty.columns == got.columns and empty.dtypes == got.dtypes and empty.count() == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 12), st.sampled_from([2, 50, 10**4]))
def test_bounds_keep_clusters_exact(seed, k, size):
    """Many rounds of moving centroids: clusters are those of full scans, ties included, and fewer vectors are scanned."""
    made = np.random.default_rng(seed)
    x = made.integers(-size, size + 1, (300, 5))
    now = x[made.choice(300, k, replace=False)]
    cluster, upper, lower = np.zeros(300, np.int64), np.full(300, np.inf), np.zeros(300)
    moved = centroids.Moved(now)
    for _ in range(8):
        cluster, upper, lower, scanned = moved.assign(x, cluster, upper, lower)
        apart = ((x[:, None, :] - moved.now) ** 2).sum(2)
        assert (cluster == apart.argmin(1)).all()
        assert (upper**2 >= apart.min(1) * (1 - 1e-9)).all() and scanned <= 300
        moved = centroids.Moved(moved.now + made.integers(-1, 2, moved.now.shape) * max(1, size // 50), moved.now)


def test_settled_vectors_are_not_scanned():
    made = np.random.default_rng(2)
    base = made.integers(-5000, 5000, (6, 16))
    x = base[np.arange(600) % 6] + made.integers(-50, 51, (600, 16))
    moved = centroids.Moved(base)
    state = moved.assign(x, np.zeros(600, np.int64), np.full(600, np.inf), np.zeros(600))[:3]
    assert centroids.Moved(base + 3, base).assign(x, *state)[3] == 0


# -- WARC -----------------------------------------------------------------------------------------------------------

BIG = "<p>é" * 400
PAGE_ROWS = [
    (1, "http://a/1", BIG), (2, "http://a/2", BIG), (9, "http://a/9", BIG), (3, "http://a/3", "x" * 999), (4, "http://a/4", "x" * 999), (5, "http://a/5", "x" * 1000), (6, "http://a/6", "x" * 1000),
    (6, "http://a/6", "x" * 1000), (7, None, None), (8, "http://a/b c\r\nX: y", ""), (None, "http://n/", BIG), (-1, "http://m/", "y" * 3000), (-2, "http://m/", "y" * 3000), (10, "http://l/", "long \r\n\r\nWARC/1.1 " * 60_000),
    *((100 + i, f"http://c/{i}", "z" * 2000) for i in range(60)), (2**63 - 1, "http://e/", "q"), (-(2**63), "http://e/", "q"),
]


def plain_archive(rows):
    last = {}
    for i, _, t in rows:
        if i is not None and len((t or "").encode()) >= 1000:
            last[t] = max(i, last.get(t, i))
    out = []
    for i, _, t in rows:
        raw = (t or "").encode()
        to = last.get(t, i) if i is not None and len(raw) >= 1000 else i
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if to == i else "revisit", None if to == i else to))
    return sorted(out, key=repr)


def test_archive(spark, tmp_path):
    pages = spark.createDataFrame(PAGE_ROWS, "page_id long, url string, html string").selectExpr("*", "1 AS n_bytes", "'x' AS digest", "2 AS file").repartition(3)
    records = warc.archive_pages(pages, f"file://{tmp_path}/w")
    got = records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect()), key=repr) == plain_archive(PAGE_ROWS)
    assert [r.url for r in records.where("page_id = 8").collect()] == ["http://a/b%20c%0D%0AX:%20y"]
    assert warc.archive_pages(pages.limit(0), f"file://{tmp_path}/e").count() == 0


def test_bundles_seek_and_map(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    pages = spark.createDataFrame(PAGE_ROWS, "page_id long, url string, html string").repartition(2)
    bundles = warc.write_bundles(pages, path, frame_bytes=3000)
    files = bundles.collect()
    assert sum(f.n_records for f in files) == len(PAGE_ROWS) and sum(f.n_frames for f in files) > 10
    store = fs.FileSystem.from_uri(path)[0]
    seen = 0
    for f in files:
        with store.open_input_file(f.file) as source:
            reader = warc.BundleReader(source)
            all_frames = b"".join(reader.frame(k) for k in range(reader.n_frames))
            for identifier, frame, at, length in reader.entries():
                record, end = warc.parse_record(reader.frame(frame), at)
                assert end - at == length and warc.of_urn(record.headers[b"warc-record-id"]) == identifier
                assert identifier in {warc.of_urn(r.headers[b"warc-record-id"]) for r in reader.find(identifier)}
                seen += 1
            assert reader.find(warc.record_id(12345)) == []
            source.seek(0)
            plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(source.read()), read_across_frames=True).read()  # any reader passes over map and seek table
            assert plain == all_frames and plain.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    assert seen == len(PAGE_ROWS)
    placed = warc.record_map(bundles, path)
    assert sorted((r.page_id for r in placed.collect()), key=str) == sorted((r[0] for r in PAGE_ROWS), key=str)
    payloads = {r.page_id: bytes(r.payload) for r in warc.read_bundles(bundles, path, with_payload=True).where("record_type = 'response'").collect()}
    assert payloads[9] == BIG.encode() and payloads[10] == PAGE_ROWS[13][2].encode() and 1 not in payloads


def test_leftovers_and_damage(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    (tmp_path / "w").mkdir()
    (tmp_path / "w/bundle-000000-77.warc.zst").write_bytes(b"left by an attempt that failed")
    pages = spark.createDataFrame(PAGE_ROWS[:3], "page_id long, url string, html string").coalesce(1)
    bundles = warc.write_bundles(pages, path)
    assert sorted(p.name for p in (tmp_path / "w").iterdir() if p.suffix == ".zst") == sorted(r.file.rpartition("/")[2] for r in bundles.collect())
    records = warc.read_bundles(bundles, path)
    with pytest.raises(ValueError, match="agree"):
        warc.check_revisits(records.selectExpr("page_id", "record_type", "refers_to", "payload_bytes + CASE WHEN page_id = 1 THEN 1 ELSE 0 END AS payload_bytes", "payload_digest"))
    record = warc.make_record(warc.record_id(1), b"u", b"pay", hashlib.sha1(b"other").hexdigest(), None)
    with pytest.raises(ValueError, match="stated"):
        warc._row(warc.parse_record(record)[0])


@given(st.integers(-(2**63), 2**63 - 1))
def test_identifiers(page_id):
    made = warc.record_id(page_id)
    assert warc.page_of(made) == page_id and made[6] >> 4 == 8 and made[8] >> 6 == 2 and warc.of_urn(warc.urn(made)) == made
    assert warc.page_of(warc.record_id(None, b"x")) is None
