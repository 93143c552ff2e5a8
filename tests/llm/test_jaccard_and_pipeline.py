"""The n-gram Jaccard join and the pipeline against brute force."""

import random

import corpus_pipeline
import pytest
from netframe.llm import byte_bpe, decontaminate, jaccard, line_dedup, toxicity


def frame(spark, rows, columns="doc_id long, text string"):
    return spark.createDataFrame(rows, columns)


def plain_components(rows, size=5, percent=80):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()))
    part = {i: i for i, _ in sets}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[a + 1 :]:
            both = len(s & t)
            if s and t and 100 * both >= percent * (len(s) + len(t) - both):
                x, y = sorted((find(i), find(j)))
                part[y] = x
    return sorted((i, len(s), find(i)) for i, s in sets)


def corpus(seed, n=160):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    passage = [rng.choice(words) for _ in range(40)]
    bases, rows = [[rng.choice(words) for _ in range(rng.choice((3, 5, 12, 30, 50, 80)))] for _ in range(12)], []
    for i in range(n):
        kind = rng.random()
        if kind < 0.65:  # near copies at all distances
            w = list(rng.choice(bases))
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.randint(0, 2)] = [rng.choice(words) for _ in range(rng.randint(0, 2))]
        elif kind < 0.85:  # mostly a passage that many share
            w = [rng.choice(words) for _ in range(rng.randint(0, 9))] + passage + [rng.choice(words) for _ in range(rng.randint(0, 9))]
        else:
            w = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        rows.append((i * 3 + 1, " ".join(w) if w or rng.random() < 0.5 else None))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(jaccard, "CHUNK", 4)
    monkeypatch.setattr(jaccard, "BUCKET_BYTES", (64, 4000, 16 << 20)[seed - 1])
    monkeypatch.setattr(jaccard, "SET_BLOCK", (8, 8192, 30)[seed - 1])
    monkeypatch.setattr(jaccard, "MAX_BROADCAST_IDS", seed - 2)
    rows = corpus(seed)
    out = jaccard.jaccard_components(frame(spark, rows).repartition(5)).collect()
    assert sorted(map(tuple, out)) == plain_components(rows)


def test_components_of_odd_tables(spark):
    long = " ".join(f"x{k}" for k in range(50_000))
    rows = [(1, None), (2, ""), (3, " \t"), (4, "One two"), (5, "one TWO"), (6, "one"), (7, long), (8, long + " tail"), (9, "É é É é É"), (10, "É é É é É ")]
    assert sorted(map(tuple, jaccard.jaccard_components(frame(spark, rows)).collect())) == plain_components(rows)
    more = jaccard.jaccard_components(frame(spark, [*rows, (4, "one two"), (None, "one two"), (None, None)])).collect()
    assert len(more) == len(rows) + 3 and {r.component_id for r in more if r.n_shingles == 1 and r.doc_id != 6 and r.doc_id not in (9, 10)} == {4}
    assert jaccard.jaccard_components(frame(spark, [])).count() == 0
    # a doc_id with two texts: each row belongs to its own text's component
    copy, other = (" ".join(f"{c}{k}" for k in range(40)) for c in "ab")
    two = frame(spark, [(1, copy), (5, copy + " z"), (5, other), (9, other + " z"), (9, other), (9, copy)])
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(two).collect()) == [(1, 36, 1), (5, 36, 5), (5, 37, 1), (9, 36, 1), (9, 36, 5), (9, 37, 5)]
    assert sorted((r.doc_id, r.text) for r in jaccard.one_of_each_group(two).collect()) == [(1, copy), (5, other)]
    clash = frame(spark, [(4, "a b", 1, 2), (5, "a b", 3, 4)], "doc_id long, text string, hi int, n long")
    assert [r.n for r in jaccard.one_of_each_group(clash).collect()] == [2]


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in kept.collect()}
        out = stage(spark, kept, sf)
        if k < 4:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        rows = {r.doc_id: r for r in out.collect()}
        if name == "toxicity":
            bad = {r.doc_id for r in toxicity.score_toxicity(kept, spark.read.parquet(f"{sf}/labels.parquet")).collect() if r.predicted}
            assert bad and set(rows) == set(before) - bad
        elif name == "line_dedup":
            want = {r.doc_id: r.kept_text for r in line_dedup.dedup_lines(kept).collect()}
            assert {i: r.text for i, r in rows.items()} == want and all(r.n_chars == len(r.text) for r in rows.values())
        elif name == "ngram_jaccard":
            assert set(rows) == {i for i, _, c in plain_components([(i, r.text) for i, r in before.items()]) if i == c}
        elif name == "decontamination":
            hit = {r.doc_id for r in decontaminate.find_contamination(kept, spark.read.parquet(f"{sf}/benchmark.parquet")).collect() if r.contaminated}
            assert hit and set(rows) == set(before) - hit
        else:
            assert {i: (r.n_tokens, r.ids_sha256) for i, r in rows.items()} == {r.doc_id: (r.n_tokens, r.ids_sha256) for r in byte_bpe.encode_decode(kept).collect()} and set(rows) == set(before)
        kept = out
    assert {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, sf).collect()} == {r.doc_id: r.ids_sha256 for r in kept.collect()}


def test_stages_on_odd_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(1, None, None, 5, 7), (None, "x", "y", None, 8), (3, "", "", 0, 9), (3, "", "", 0, 9)]
    docs = frame(spark, rows, "doc_id long, text string, lang string, n_chars long, hi long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 4 and stage(spark, docs.limit(0), sf).count() == 0
