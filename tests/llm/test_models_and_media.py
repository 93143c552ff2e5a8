"""Quality, sorted string tables, lossless WebP, token counts and toxicity: round trips, brute force and held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs
from tokenizers import Tokenizer

from netframe.llm import quality, sstable, toxicity, webp, wordpiece
from netframe.llm.common import shared_path

DATA = "/root/testdata/sf0.1"
ODD = [None, "", " ", "\n", "a\x00b", "É é x", "İstanbul ΣΑΣ ǅ don't 12", "👩‍👩‍👧 a@b.co", "x y1 " * 30_000]


def frame(spark, rows, columns="doc_id long, text string"):
    return spark.createDataFrame(rows, columns)


# -- quality --------------------------------------------------------------------------------------------------------


def held_out_accuracy(rows, column):
    rows = [r for r in rows if r.held_out and r[column] is not None]
    assert len(rows) > 50
    return sum(r.predicted == r[column] for r in rows) / len(rows)


def test_quality_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.score_quality(docs, labels).join(labels, "doc_id", "left").collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert held_out_accuracy(out, "quality") > 0.96


def plain_quality(rows, labels, n_bytes):
    """Scores of rows (doc_id, text) by plain loops: dictionaries of the learnable halves, differences, a logistic fitted by many small steps."""
    learn = {i: y for i, y in labels.items() if zlib.crc32(str(i).encode()) % 4 != 2}
    own = [[t.encode() for i, t in sorted(rows) if learn.get(i) == y] for y in (0, 1)]

    def made(texts):
        pieces = [t[k : k + 512] for t in texts for k in range(0, len(t), 512)]
        return zstandard.ZstdCompressor(level=3, dict_data=zstandard.train_dictionary(n_bytes, pieces), write_content_size=False, write_checksum=False, write_dict_id=False)

    def difference(raw, bad, good):
        blocks = [raw[k : k + 512] for k in range(0, len(raw), 512)]
        return sum(len(bad.compress(b)) - len(good.compress(b)) for b in blocks) / max(1, len(raw))

    seen = []
    for half in (0, 1):
        pair = [made(texts[half::2]) for texts in own]
        seen += [(difference(raw, *pair), y) for y in (0, 1) for raw in own[y][1 - half :: 2]]
    scale = (sum(x * x for x, _ in seen) / len(seen)) ** 0.5
    x, y = np.array([v / scale for v, _ in seen]), np.array([k for _, k in seen])
    a = b = 0.0
    for _ in range(200_000):
        p = 1 / (1 + np.exp(-(a + b * x)))
        g = (y - p).sum() - 1e-3 * a, ((y - p) * x).sum() - 1e-3 * b
        a, b = a + 0.01 * g[0], b + 0.01 * g[1]
        if abs(g[0]) + abs(g[1]) < 1e-10:
            break
    pair = [made(texts) for texts in own]
    return {i: 1 / (1 + math.exp(-(a + b * difference(t.encode(), *pair) / scale))) for i, t in rows}


def test_quality_scores_by_plain_loops(spark):
    rng = random.Random(4)
    kinds = [[f"{c}{k}{c}word" for k in range(60)] for c in "xq"]
    text = lambda y: " ".join(rng.choice(kinds[y if rng.random() < 0.6 else 1 - y]) for _ in range(rng.randint(1, 260)))
    labels = {i: i % 2 for i in range(240)}
    rows = [(i, text(i % 2)) for i in range(300)]
    got = quality.score_quality(frame(spark, [*rows, (7, rows[7][1])]), frame(spark, list(labels.items()), "doc_id long, quality int"), dictionary_bytes=4096).collect()
    want = plain_quality(rows, labels, 4096)
    assert len(got) == 301 and len({round(v, 3) for v in want.values()}) > 50
    assert [r.score for r in got] == pytest.approx([want[r.doc_id] for r in got], abs=1e-6)


def test_models_on_odd_tables(spark):
    docs, labels = frame(spark, list(enumerate(ODD)) + [(None, "x"), (1, "")]), spark.read.parquet(f"{DATA}/labels.parquet")
    for score in (quality.score_quality, toxicity.score_toxicity):
        none = score(docs, labels.limit(0)).collect()
        assert len(none) == len(ODD) + 2 and len({r.score for r in none}) == 1
        assert score(frame(spark, []), labels).count() == 0
    odd = spark.createDataFrame([(0, 1, None), (0, 0, 1), (5, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.score_quality(docs, odd).count() == len(ODD) + 2 and toxicity.score_toxicity(docs, odd).count() == len(ODD) + 2


# -- toxicity -------------------------------------------------------------------------------------------------------


def test_toxicity_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.score_toxicity(docs, labels).join(labels, "doc_id", "left").collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert held_out_accuracy(out, "toxic") > 0.96
    flagged = [r for r in out if r.predicted]
    assert flagged and all(r.evidence for r in flagged)
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in out if not r.predicted}


def test_toxicity_takes_every_term():
    rows = [(i, int(i % 4 == 0), f"{'vile ' * (i % 4 == 0)}an ox no {i} of the red sea") for i in range(40)] + [(100, 0, "犬が好き"), (101, 1, "猫が嫌い")]
    model = toxicity.ToxicityModel(rows, {0: 31, 1: 11})
    assert {"an", "ox", "no", "7", "犬", "が好", "好き"} <= set(model.terms)
    texts = ("ox", "the red sea 7", "私は犬が好き", "猫", "", "nothing known")
    for text, nearest, (score, near) in zip(texts, (None, 7, 100, 101, -1, -1), model.scores(list(texts)), strict=True):
        assert 0 < score < 1 and bool(near) == (nearest != -1), text
        assert nearest in (None, -1) or model.ids[near[0][1]] == nearest


def plain_toxicity(rows, counts, texts, k=15):
    """Scores by plain loops: TF-IDF weighted by association, cosines, votes and a logistic curve."""
    rows = sorted({t: (i, y, t) for i, y, t in sorted(rows, reverse=True)}.values())
    words = lambda t: Counter(re.findall(r"\w+", t.lower()))
    df = {y: Counter(w for _, label, t in rows if label == y for w in words(t)) for y in (0, 1)}
    n = Counter(y for _, y, _ in rows)
    total = n[0] + n[1]

    def weight(w):
        a, b = df[1][w], df[0][w]
        c, d = n[1] - a, n[0] - b
        chi = total * (a * d - b * c) ** 2 / max(1, (a + b) * (c + d) * (a + c) * (b + d))
        return (math.log((1 + total) / (1 + a + b)) + 1) * (1 + chi**0.5)

    def vector(t):
        v = {w: (1 + math.log(c)) * weight(w) for w, c in words(t).items() if df[0][w] + df[1][w]}
        norm = sum(x * x for x in v.values()) ** 0.5
        return {w: x / norm for w, x in v.items()}

    vectors = [vector(t) for _, _, t in rows]

    def vote(v, without=-1):
        near = sorted(((-round(s, 12), j) for j, x in enumerate(vectors) if j != without and (s := sum(c * x.get(w, 0) for w, c in v.items())) > 1e-12))[:k]
        held = [1 / (1.05 + s) for s, _ in near]
        return sum(h for h, (_, j) in zip(held, near, strict=True) if rows[j][1]) / (sum(held) + 2 / 1.05) if near else None

    votes = [(x, rows[j][1]) for j, v in enumerate(vectors) if (x := vote(v, j)) is not None]
    share = [counts[y] / n[y] for _, y in votes]
    a, b = quality.logistic([x for x, _ in votes], [y for _, y in votes], [s * len(share) / sum(share) for s in share], ridge=0.05)
    none = counts[1] / (counts[0] + counts[1])
    return [none if (x := vote(vector(t))) is None else 1 / (1 + math.exp(-a - b * x)) for t in texts]


def test_toxicity_scores_by_plain_loops():
    rng = random.Random(8)
    words = [f"w{k}" for k in range(70)]
    text = lambda y: " ".join(rng.choices(words + ["vile", "foul"] * 6 * y, k=rng.randint(1, 30)))
    rows = [(i, y := int(i % 3 == 0), text(y)) for i in range(150)] + [(200 + k, 1, "foul w1 w2") for k in range(3)]
    texts = [text(k % 2) for k in range(80)] + ["", "unheard of", "w1 " * 5000]
    got = [s for s, _ in toxicity.ToxicityModel(rows, {0: 300, 1: 60}).scores(texts)]
    assert got == pytest.approx(plain_toxicity(rows, {0: 300, 1: 60}, texts), abs=1e-9)


def test_block_max_search_is_exact():
    rng = random.Random(3)

    def vector():
        v = {t: rng.random() for t in [*rng.sample(range(40), rng.randint(1, 8)), *rng.sample(range(40, 400), 3)]}
        norm = sum(x * x for x in v.values()) ** 0.5
        return {t: x / norm for t, x in v.items()}

    def packed(v):
        return np.array(list(v), np.int64), np.array(list(v.values()))

    vectors = [vector() for _ in range(500)]
    vectors += vectors[:50]  # ties
    index = toxicity.BlockMaxIndex([packed(v) for v in vectors], 400, block=16)
    assert 0 < len(index.dense) < 400
    queries = [vector() for _ in range(60)]
    for q, near in zip(queries, index.nearest([packed(q) for q in queries], 15), strict=True):
        want = sorted(((round(s, 9), -i) for i, v in enumerate(vectors) if (s := sum(w * v.get(t, 0) for t, w in q.items())) > 0), reverse=True)[:15]
        assert [-i for _, i in near] == [i for _, i in want] and [s for s, _ in near] == pytest.approx([s for s, _ in want], abs=2e-9)
    own = index.nearest([packed(v) for v in vectors[50:70]], 1, without=list(range(50, 70)))
    assert all(near[0][1] != i for i, near in zip(range(50, 70), own, strict=True))


# -- sorted string tables -------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def plain_tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(sstable.VOCABULARY))


@pytest.fixture(scope="module")
def word_tokenizer():
    return sstable.WordTokenizer(public_tokenizers.path(sstable.VOCABULARY))


def test_each_fast_character(plain_tokenizer, word_tokenizer):
    fast = [chr(c) for c in range(0x250) if not sstable._OTHER.search(chr(c))] + [chr(c) for c in (*range(0x2010, 0x2028), 0x20AC)]
    texts = [x for c in fast for x in (f"a{c}b1{c}", f"{c} {c}{c}'s", f"é{c.upper()}{c}'LL")]
    texts = [t for t in texts if not sstable._OTHER.search(t)]
    assert len(texts) > 1000
    for t, own in zip(texts, word_tokenizer.encode_batch(texts), strict=True):
        assert own.tolist() == plain_tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aEé'sSdD12 .,<|>endoftextßſ’\n", max_size=60))
def test_word_tokenizer(plain_tokenizer, word_tokenizer, text):
    assert word_tokenizer.encode_batch([text])[0].tolist() == plain_tokenizer.encode(text, add_special_tokens=False).ids


def test_added_tokens_in_texts(spark):
    loaded = Tokenizer.from_file(public_tokenizers.path(sstable.VOCABULARY))
    texts = ["a <|endoftext|> b", "x<|startoftext|>y z", "A <|ENDOFTEXT|> é", "<|endoftext|><|endoftext|>", "plain", "<| endoftext |>"]
    want = [loaded.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [320, 49407, 321]
    coder = sstable.WordTokenizer(public_tokenizers.path(sstable.VOCABULARY))
    assert [x.tolist() for x in coder.encode_batch(texts)] == want
    out = sorted(sstable.tokenize_to_shards(frame(spark, list(enumerate(texts))), with_ids=True).collect(), key=lambda r: r.doc_id)
    assert [r.ids for r in out] == [ids + [2] for ids in want]
    assert [r.start for r in out] == [sum(len(x) + 1 for x in want[:i]) for i in range(len(want))]


def test_sstable(spark, plain_tokenizer):
    rows = [(i * 7 - 20, t) for i, t in enumerate(ODD)] + [(k * 1000 + 500, f"text number {k} " * (k % 50)) for k in range(300)] + [(-20, "again"), (-20, "again"), (None, "no id"), (2**62, "far")]
    path = shared_path(spark, "sst")
    shards = sstable.write_shards(frame(spark, rows), path)
    out = sstable.read_shards(shards, path, with_ids=True).collect()
    want = sorted((i is not None, i or 0, *[plain_tokenizer.encode(t or "", add_special_tokens=False).ids + [2]]) for i, t in rows)
    by_start = sorted(out, key=lambda r: r.start)
    assert [r.doc_id for r in by_start] == [i if has else None for has, i, _ in want]
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids) for r in out) == want
    at = 0
    for r in by_start:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    store, _ = fs.FileSystem.from_uri(path)
    readers = [sstable.ShardReader(store.open_input_file(r.file)) for r in shards.collect()]
    found = lambda i: sorted(x.tolist() for r in readers for x in r.get(i))
    for i in (-20, None, 2**62, 150_500, 1):
        assert found(i) == sorted(ids for has, k, ids in want if (k if has else None) == i)
    assert sstable.tokenize_to_shards(frame(spark, [])).count() == 0


def test_sstable_damage(tmp_path):
    with open(tmp_path / "x.sst", "wb") as out:
        w = sstable.ShardWriter(out, 2)
        for i in range(20_000):
            w.add(i, np.arange(i % 7, dtype=np.uint32))
        w.close()
    data = bytearray((tmp_path / "x.sst").read_bytes())
    reader = sstable.ShardReader(fs.LocalFileSystem().open_input_file(str(tmp_path / "x.sst")))
    assert len(reader.places) > 1 and reader.get(19_999)[0].tolist() == list(range(19_999 % 7)) and reader.get(20_001) == []
    assert sum(k in reader.bloom for k in map(sstable.encode_key, range(30_000, 40_000))) < 300
    data[100] ^= 1
    (tmp_path / "x.sst").write_bytes(bytes(data))
    with pytest.raises(ValueError, match="damaged"):
        list(sstable.ShardReader(fs.LocalFileSystem().open_input_file(str(tmp_path / "x.sst"))))


# -- lossless WebP --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("transforms", [(), (0,), (1,), (2,), (3,), (0, 1, 2), (2, 0), (1, 0, 2), (3, 0)])
@pytest.mark.parametrize("cache_bits", [0, 4])
@pytest.mark.parametrize("references", [False, True])
def test_webp_transforms(transforms, cache_bits, references):
    rng = np.random.default_rng(cache_bits)
    image = rng.integers(0, 4, (13, 21, 4))
    image[3:6] = image[0:3]
    image = image * 60 % 256
    modes = rng.integers(0, 14, (4, 6)) if 3 not in transforms else None
    made = webp.encode(image, transforms, 2, cache_bits, references, modes=modes)
    assert (webp.decode(made) == image).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 5, 16, 17, 200])
def test_webp_palettes(colours):
    image = np.zeros((9, 17, 4), np.int64)
    image[..., 1] = np.arange(9 * 17).reshape(9, 17) % colours
    image[..., 0] = 255
    assert (webp.decode(webp.encode(image, (3,), references=True)) == image).all()


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=400))
def test_payload_round_trip(raw):
    payload = webp.payload_of(raw)
    assert len(payload) % 64 == 0 and payload and payload[: len(raw)] == raw and not payload[len(raw) :].strip(b"\0")
    assert webp.restore(webp.store(payload)).tobytes() == payload


def test_webp_of_long_and_steep_payloads():
    for raw in (np.random.default_rng(1).bytes(2_200_000), b"".join(bytes([k]) * (1 << k) for k in range(19)), b"a" * 64):
        payload = webp.payload_of(raw)
        assert webp.restore(webp.store(payload)).tobytes() == payload
    with pytest.raises(ValueError, match="breaks off|not a lossless"):
        webp.decode(webp.store(webp.payload_of(b"some text to break off" * 9))[:-40])


def test_media_columns(spark):
    rows = [*enumerate(ODD), (90, "Le été ça"), (91, "Le été ça")]
    out = {r.doc_id: r for r in webp.media_columns(frame(spark, rows)).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or 64 * (not raw))
        r = out[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest() and bytes(r.pixels) == payload
    assert tuple(out[90])[1:] == tuple(out[91])[1:]
    assert webp.media_columns(frame(spark, [])).count() == 0


# -- token counts ---------------------------------------------------------------------------------------------------


def greedy(word, pieces):
    at = n = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return None
        at, n = end, n + 1
    return n


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text(alphabet="abc", min_size=1, max_size=5), max_size=12), st.sets(st.text(alphabet="abc", max_size=4), max_size=6), st.lists(st.text(alphabet="abc", min_size=1, max_size=12), max_size=8))
def test_automaton_is_greedy(inner, starts, words):
    pieces = inner | {"▁" + s for s in starts}
    automaton = wordpiece.Automaton(sorted(pieces))
    for w in words:
        assert automaton.count("▁" + w) == greedy("▁" + w, pieces)


def test_token_counts(spark):
    pieces = set(wordpiece.load_pieces(public_tokenizers.path(wordpiece.VOCABULARY)))
    rows = [*enumerate(ODD[:-1]), (50, "Ciónue straße ▁x unaffable  \t tokenization"), (51, "a b " * 2000)]
    for r in wordpiece.count_tokens(frame(spark, rows)).collect():
        words = (dict(rows)[r.doc_id] or "").encode().split()
        counts = [None if "▁" in w.decode() else greedy("▁" + w.decode(), pieces) for w in words]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(words), sum(c or 1 for c in counts), counts.count(None))
    assert wordpiece.count_tokens(frame(spark, [])).count() == 0
