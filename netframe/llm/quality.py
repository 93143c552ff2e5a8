"""Compression classifier for text quality: one zstandard dictionary from good labelled text and one from bad. How much
smaller a text gets with the one than with the other, for each of its bytes, becomes a score by logistic calibration.

Texts are compressed whole, in blocks, so that the dictionaries count for as much at the end of a long text as at its start.

Fitting takes a bounded sample: per_class labelled documents of each class, the first in the order of a hash of their id,
none over max_chars. Each half calibrates with dictionaries built from the other half; all of them then build the final ones.
Everything else covers all rows.

Defined cases: null text is the empty text; its difference is 0, so it has the score that calibration gives 0. A null
doc_id is not held out. Documents labelled twice with different values, or with null, are not learned from. With labels of
one class only (or none), every score is that class's share (0.5). Repeated rows have equal scores, and an id's rows are one
example. An empty table has an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netframe.llm.common import raw_texts, sliced, text_frame

FOLDS, HELD_OUT = 4, 2
PER_CLASS = 2000
MAX_CHARS = 20_000
DICTIONARY_BYTES = 64 << 10
BLOCK_BYTES = 512
LEVEL = 3
THRESHOLD = 0.7


def fold(folds: int, id_col: str = "doc_id"):
    """crc32 of the id as text, modulo folds."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def labelled_rows(docs: DataFrame, labels: DataFrame, column: str, folds: int, held_out: int, per_class: dict[int, int], max_chars: int) -> tuple[DataFrame, dict[int, int]]:
    """Up to per_class[label] learnable documents of each label as rows (doc_id, label, text), and how many labels of each value there are."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).where(fold(folds) != held_out)
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most and label in (0, 1)").select("doc_id", "label")
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    parts = [known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for label, n in per_class.items()]
    # at most the sum of per_class ids
    picked = F.broadcast(parts[0].unionByName(parts[1]))
    found = text_frame(docs).where(F.length("text").between(1, max_chars)).join(picked, "doc_id")
    # an id's rows are one example, however many there are
    return found.groupBy("doc_id", "label").agg(F.max("text").alias("text")), counts


def logistic(x: list[float], y: list[int], weights: list[float], ridge: float = 1e-3) -> tuple[float, float]:
    """Intercept and slope of a weighted logistic regression, by Newton's method."""
    a = b = 0.0
    for _ in range(60):
        g0, g1, h00, h01, h11 = -ridge * a, -ridge * b, ridge, 0.0, ridge
        for xi, yi, wi in zip(x, y, weights, strict=True):
            p = sigmoid(a + b * xi)
            d, v = wi * (yi - p), wi * p * (1 - p)
            g0, g1, h00, h01, h11 = g0 + d, g1 + d * xi, h00 + v, h01 + v * xi, h11 + v * xi * xi
        det = h00 * h11 - h01 * h01
        da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        step = min(1.0, 5.0 / max(1e-12, abs(da), abs(db)))
        a, b = a + step * da, b + step * db
        if abs(da) + abs(db) < 1e-9:
            break
    return a, b


def sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def _dictionary(texts: list[bytes], n_bytes: int, block: int) -> zstandard.ZstdCompressionDict:
    pieces = [t[i : i + block] for t in texts for i in range(0, len(t), block)]
    try:
        return zstandard.train_dictionary(n_bytes, pieces)
    except zstandard.ZstdError:  # too little text to train on: the text itself
        return zstandard.ZstdCompressionDict(b"".join(pieces)[:n_bytes] or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


@dataclass
class QualityModel:
    """Small enough to be broadcast: two dictionaries of DICTIONARY_BYTES and three numbers."""

    bad: bytes
    good: bytes
    raw: tuple[bool, bool]
    scale: float
    intercept: float
    slope: float

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for data, raw in zip((self.bad, self.good), self.raw, strict=True):
            held = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT if raw else zstandard.DICT_TYPE_FULLDICT)
            held.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out

    @staticmethod
    def difference(raw: bytes, compressors: list[zstandard.ZstdCompressor]) -> float:
        """Bytes that the bad dictionary needs beyond the good one, for each byte of text."""
        bad, good = (c.compress for c in compressors)
        total = 0
        for i in range(0, len(raw), BLOCK_BYTES):
            block = raw[i : i + BLOCK_BYTES]
            total += len(bad(block)) - len(good(block))
        return total / max(1, len(raw))

    def score(self, difference: float) -> float:
        return sigmoid(self.intercept + self.slope * difference / self.scale)


def _model(texts: list[list[bytes]], dictionary_bytes: int) -> QualityModel:
    """An uncalibrated model of bad and good texts."""
    held = [_dictionary(own, dictionary_bytes, BLOCK_BYTES) for own in texts]
    return QualityModel(held[0].as_bytes(), held[1].as_bytes(), tuple(d.dict_id() == 0 for d in held), 1.0, 0.0, 0.0)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS, dictionary_bytes: int = DICTIONARY_BYTES) -> QualityModel | None:
    """None if there aren't two classes to tell apart."""
    rows, counts = labelled_rows(docs, labels, "quality", FOLDS, HELD_OUT, {0: per_class, 1: per_class}, max_chars)
    sample = sorted(tuple(r) for r in rows.collect())
    by = {label: [t.encode() for _, k, t in sample if k == label] for label in (0, 1)}
    if min(map(len, by.values())) < 2:
        return None
    x, y, w = [], [], []
    for half in (0, 1):
        compressors = _model([by[label][half::2] for label in (0, 1)], dictionary_bytes).compressors()
        for label in (0, 1):
            for raw in by[label][1 - half :: 2]:
                x.append(QualityModel.difference(raw, compressors))
                y.append(label)
                w.append(counts[label] / len(by[label]))  # as often as the label is
    model = _model([by[0], by[1]], dictionary_bytes)
    model.scale = max(1e-9, (sum(v * v for v in x) / len(x)) ** 0.5)
    total = sum(w) / len(w)
    model.intercept, model.slope = logistic([v / model.scale for v in x], y, [v / total for v in w])
    return model


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **fitting) -> DataFrame:
    """(doc_id, held_out, score, predicted, difference) for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **fitting))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        compressors = model.compressors() if model else []
        for batch in sliced(batches):
            found = [model.difference(raw, compressors) if model else 0.0 for raw in raw_texts(batch)]
            score = [model.score(x) if model else 0.5 for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64()), pa.array([int(s >= threshold) for s in score], pa.int32()), pa.array(found, pa.float64())], ["doc_id", "score", "predicted", "difference"])

    out = text_frame(docs).mapInArrow(scores, "doc_id long, score double, predicted int, difference double")
    return out.select("doc_id", F.coalesce(fold(FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted", "difference")
