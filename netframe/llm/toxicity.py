"""Toxicity from the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes,
calibrated to a score, with the neighbours as evidence.

Terms are lower-cased words of any length, and in scripts without spaces the sequences of 1 to MAX_GRAM characters. The vocabulary
holds every term of the sample; none is selected. A term's inverse document frequency is raised by how strongly it goes with either
label (1 + the root of its chi-squared), so that a text's few telling words aren't lost among its many others.
Examples are kept in blocks of similar ones; a block's bound is the query's weights times the block's largest weights. The FIRST
blocks of the highest bounds are visited, then all whose bound reaches the k-th best cosine, so the neighbours are exact. Terms
that many examples have keep their postings as matrix rows, and texts are searched for some at a time.

Fitting takes a bounded sample: n_toxic and n_clean labelled documents, the first in the order of a hash of their id, none
over max_chars. One task fits, and stores the model in the shared folder; its size is bounded by the sample. Everything else covers all rows.

Defined cases: null text is the empty text. A text without any term of the sample has no neighbours; its score is the
share of toxic documents among such examples, or among all where there is none. Ties between neighbours go to the smaller doc_id. Equal example texts count once. A null
doc_id is not held out. With labels of one class only (or none), every score is that class's share (0 without labels).
Repeated rows have equal scores. Texts of any length are scored whole. An empty table has an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netframe.llm.common import loaded, of_worker, shared_path, sliced, stored, str_texts, text_frame
from netframe.llm.quality import fold, labelled_rows, logistic, sigmoid

FOLDS, HELD_OUT = 3, 1
N_TOXIC, N_CLEAN = 2000, 4000
MAX_CHARS = 20_000
THRESHOLD = 0.7
NEIGHBOURS = 15
BLOCK = 64
FIRST = 4
MAX_GRAM = 3
#: A term that one example in so many has is dense.
DENSE = 16
#: Texts that are searched for together, and their terms, at most about.
QUERIES, QUERY_TERMS = 64, 16_384

#: Thai, Lao, Tibetan, Myanmar, Khmer, kana and Han: no spaces between words.
_UNSPACED = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_MARKS = "".join(chr(c) for c in range(0x300, 0x10000) if unicodedata.category(chr(c)) in ("Mn", "Mc"))
_WORD = re.compile(rf"[\w{_MARKS}]+")
_HAS_UNSPACED = re.compile(f"[{_UNSPACED}]")
_PART = re.compile(f"[{_UNSPACED}]+|[^{_UNSPACED}]+")


def word_terms(word: str) -> list[str]:
    """The word itself, or its parts: sequences of characters where its script has no spaces."""
    if not _HAS_UNSPACED.search(word):
        return [word]
    out = []
    for part in _PART.findall(word):
        if _HAS_UNSPACED.match(part):
            out += [part[i : i + k] for k in range(1, MAX_GRAM + 1) for i in range(len(part) - k + 1)]
        else:
            out.append(part)
    return out


class TermCounter:
    """counts(text): how often a text has each of the vocabulary's terms, by the term's number."""

    def __init__(self, terms: dict[str, int]):
        self.terms = terms

    def counts(self, text: str) -> dict[int, int]:
        get, out = self.terms.get, {}
        spaced = text.isascii() or not _HAS_UNSPACED.search(text)
        for word, n in Counter(_WORD.findall(text.lower())).items():
            if spaced or word.isascii():
                if (t := get(word)) is not None:
                    out[t] = out.get(t, 0) + n
            else:
                for term in word_terms(word):
                    if (t := get(term)) is not None:
                        out[t] = out.get(t, 0) + n
        return out


def packed(counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Terms, and how often each occurs."""
    return np.fromiter(counts, np.int32, len(counts)), np.fromiter(counts.values(), np.int32, len(counts))


def _ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges one after the other, and how many each has."""
    n = ends - starts
    return np.arange(n.sum()) + np.repeat(starts - np.cumsum(n) + n, n), n


Query = tuple[np.ndarray, np.ndarray]  # terms and weights


class BlockMaxIndex:
    """Unit vectors of examples, in blocks of similar ones: postings by term and block, with each block's largest weight of a term.
    Terms that one example in DENSE has keep their postings as rows of a matrix, block by block."""

    def __init__(self, vectors: list[Query], n_terms: int, block: int = BLOCK):
        self.n, self.block = len(vectors), block
        self.n_blocks = -(-self.n // block)
        sizes = [len(t) for t, _ in vectors]
        terms = np.concatenate([t for t, _ in vectors] or [np.zeros(0, np.int32)])
        weights = np.concatenate([w for _, w in vectors] or [np.zeros(0)])
        of = np.repeat(np.arange(self.n), sizes)
        df = np.bincount(terms, minlength=n_terms)
        dense = np.flatnonzero((df > 0) & (df * DENSE >= self.n))
        self.row = np.full(n_terms, -1, np.int32)  # a term's row of the matrix
        self.row[dense] = np.arange(len(dense))
        held = np.zeros((len(dense), self.n))
        at_row = self.row[terms]
        common = at_row >= 0
        held[at_row[common], of[common]] = weights[common]
        self.numbers = self._order(held)
        self.places = np.argsort(self.numbers)
        self.dense = np.ascontiguousarray(held[:, self.numbers])
        edges = np.arange(0, self.n, block)
        self.dense_tops = np.maximum.reduceat(self.dense, edges, axis=1) if self.n else np.zeros((len(dense), 0))
        terms, weights, places = terms[~common], weights[~common], self.places[of[~common]]
        by = np.lexsort((places, terms))
        terms, self.weights, self.at = terms[by], weights[by], places[by].astype(np.int32)
        new = np.flatnonzero(np.diff(terms, prepend=-1) | np.diff(self.at // block, prepend=-1))  # where a block's postings of a term start
        self.starts = np.append(new, len(terms))
        self.blocks = (self.at[new] // block).astype(np.int32)
        self.tops = np.maximum.reduceat(self.weights, new) if len(new) else np.zeros(0)
        self.first = np.searchsorted(terms[new], np.arange(n_terms + 1))

    def _order(self, held: np.ndarray) -> np.ndarray:
        """The examples in an order that puts similar ones in the same block: by the nearest of as many centres as there are blocks, moved a few times."""
        if self.n_blocks < 2 or not len(held):
            return np.arange(self.n)
        units = held.T / np.maximum(1e-12, np.linalg.norm(held, axis=0))[:, None]
        centres = units[:: self.block][: self.n_blocks].copy()
        for _ in range(8):
            near = np.argmax(units @ centres.T, axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, units)
            norms = np.linalg.norm(sums, axis=1)
            centres[norms > 0] = sums[norms > 0] / norms[norms > 0, None]
        near = np.argmax(units @ centres.T, axis=1)
        walk, left = [0], set(range(1, len(centres)))  # neighbouring centres one after the other
        like = centres @ centres.T
        while left:
            rest = sorted(left)
            walk.append(rest[int(np.argmax(like[walk[-1], rest]))])
            left.remove(walk[-1])
        rank = np.empty(len(centres), np.int64)
        rank[walk] = np.arange(len(centres))
        return np.lexsort((np.arange(self.n), rank[near]))

    def _add(self, scores: np.ndarray, query: np.ndarray, entries: Query, of: np.ndarray, want: np.ndarray) -> None:
        """Adds the cosines' parts of the blocks that each query wants."""
        for b in np.flatnonzero(want.any(axis=0)).tolist():
            rows = np.flatnonzero(want[:, b])
            at = slice(b * self.block, (b + 1) * self.block)
            scores[rows, at] += query[rows] @ self.dense[:, at]
        own, weights = entries
        now = want[of, self.blocks[own]]
        own, weights, of = own[now], weights[now], of[now]
        which, n = _ranges(self.starts[own], self.starts[own + 1])
        cell = np.repeat(of * self.n, n) + self.at[which]
        scores += np.bincount(cell, self.weights[which] * np.repeat(weights, n), scores.size).reshape(scores.shape)

    def nearest(self, queries: list[Query], k: int, without: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """For each query the k examples of the highest cosine above 0, as (cosine, number), best first, ties by number. without: for each query an example that doesn't count."""
        if not queries or not self.n:
            return [[] for _ in queries]
        m, sizes = len(queries), np.array([len(t) for t, _ in queries])
        terms, weights, of = np.concatenate([t for t, _ in queries]), np.concatenate([w for _, w in queries]), np.repeat(np.arange(m), sizes)
        row = self.row[terms]
        common = row >= 0
        query = np.zeros((m, len(self.dense)))
        query[of[common], row[common]] = weights[common]
        terms, weights, of = terms[~common], weights[~common], of[~common]
        own, n = _ranges(self.first[terms], self.first[terms + 1])
        weights, of = np.repeat(weights, n), np.repeat(of, n)
        bounds = query @ self.dense_tops + np.bincount(of * self.n_blocks + self.blocks[own], weights * self.tops[own], m * self.n_blocks).reshape(m, -1)
        scores, want = np.zeros((m, self.n)), np.zeros((m, self.n_blocks), bool)
        few = min(self.n_blocks, FIRST + k // self.block)
        want[np.arange(m)[:, None], np.argsort(-bounds, axis=1, kind="stable")[:, :few]] = True
        self._add(scores, query, (own, weights), of, want)
        if without is not None:
            left_out = np.arange(m), self.places[without]
            scores[left_out] = 0
        rest = ~want & (bounds > 0)
        if self.n > k:
            rest &= bounds >= np.partition(scores, self.n - k, axis=1)[:, self.n - k, None] - 1e-9
        self._add(scores, query, (own, weights), of, rest)
        if without is not None:
            scores[left_out] = 0
        least = np.partition(scores, self.n - k, axis=1)[:, self.n - k, None] - 1e-9 if self.n > k else 0
        of, found = np.nonzero((scores > 1e-12) & (scores >= least))
        held, numbers = np.round(scores[of, found], 12), self.numbers[found]
        best = np.lexsort((numbers, -held, of))
        of, held, numbers = of[best], held[best].tolist(), numbers[best].tolist()
        cuts = np.searchsorted(of, np.arange(m + 1)).tolist()
        return [list(zip(held[i : min(j, i + k)], numbers[i : min(j, i + k)], strict=True)) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


def association(df: np.ndarray, n: Counter) -> np.ndarray:
    """The root of each term's chi-squared between its presence and the label; df: documents of either label that hold it."""
    a, b = df[1], df[0]
    c, d = n[1] - a, n[0] - b
    return math.sqrt(n[0] + n[1]) * np.abs(a * d - b * c) / np.sqrt(np.maximum(1, (a + b) * (c + d) * (a + c) * (b + d)))


class ToxicityModel:
    """Vocabulary, index and calibration."""

    def __init__(self, sample: list[tuple[int, int, str]], counts: dict[int, int], k: int = NEIGHBOURS):
        self.k = k
        sample = sorted({text: (i, label, text) for i, label, text in sorted(sample, reverse=True)}.values())
        n = Counter(label for _, label, _ in sample)
        share = {label: counts.get(label, 0) / max(1, n[label]) for label in (0, 1)}  # labels for each example
        self.terms = {}
        if len(n) == 2:
            for _, _, text in sample:
                for word in _WORD.findall(text.lower()):
                    for t in word_terms(word):
                        self.terms.setdefault(t, len(self.terms))
        counter = TermCounter(self.terms)
        found = [(i, label, *packed(counter.counts(text))) for i, label, text in sample]
        df = np.zeros((2, len(self.terms)))
        for _, label, own, _ in found:
            df[label, own] += 1
        self.idf = (np.log((1 + len(sample)) / (1 + df[0] + df[1])) + 1) * (1 + association(df, n))
        none = Counter(label for _, label, own, _ in found if not len(own)) or n
        kept = [(i, label, self.vector(own, often)) for i, label, own, often in found if len(own)]
        del sample, found
        self.ids, self.labels = [i for i, _, _ in kept], [label for _, label, _ in kept]
        self.index = BlockMaxIndex([v for _, _, v in kept], len(self.terms))
        self.without = none[1] * share[1] / max(1e-9, none[0] * share[0] + none[1] * share[1]) if none else 0.0
        self.intercept, self.slope = -4.0, 8.0
        votes = []
        for at in range(0, len(kept), QUERIES):
            part = range(at, min(len(kept), at + QUERIES))
            votes += map(self.vote, self.index.nearest([kept[j][2] for j in part], k, without=list(part)))
        rows = [(x, y) for x, y in zip(votes, self.labels, strict=True) if x is not None]
        if {y for _, y in rows} == {0, 1}:
            w = [share[y] for _, y in rows]
            self.intercept, self.slope = logistic([x for x, _ in rows], [y for _, y in rows], [v * len(w) / sum(w) for v in w], ridge=0.05)

    def vector(self, terms: np.ndarray, often: np.ndarray) -> Query:
        v = (1 + np.log(often)) * self.idf[terms]
        return terms, v / math.sqrt(v @ v)

    def vote(self, near: list[tuple[float, int]]) -> float | None:
        """Share of the votes for toxic, each weighted by the inverse of the distance; two votes for clean at distance 1 keep few far neighbours from being certain."""
        if not near:
            return None
        weights = [1 / (1.05 - s) for s, _ in near]
        return sum(w for w, (_, i) in zip(weights, near, strict=True) if self.labels[i]) / (sum(weights) + 2 / 1.05)

    def scores(self, texts: list[str]) -> Iterator[tuple[float, list[tuple[float, int]]]]:
        """(score, neighbours) of each text. Texts are searched together, up to QUERIES of them or QUERY_TERMS terms."""
        counter, held, n_terms = TermCounter(self.terms), [], 0
        for text in texts:
            counts = counter.counts(text)
            held.append(self.vector(*packed(counts)) if counts else None)
            n_terms += len(counts)
            if len(held) >= QUERIES or n_terms >= QUERY_TERMS:
                yield from self._scored(held)
                held, n_terms = [], 0
        yield from self._scored(held)

    def _scored(self, vectors: list[Query | None]) -> Iterator[tuple[float, list[tuple[float, int]]]]:
        found = iter(self.index.nearest([v for v in vectors if v is not None], self.k))
        for v in vectors:
            near = next(found) if v is not None else []
            vote = self.vote(near)
            yield (self.without if vote is None else sigmoid(self.intercept + self.slope * vote)), near


def _sample(docs: DataFrame, labels: DataFrame, n_toxic: int = N_TOXIC, n_clean: int = N_CLEAN, max_chars: int = MAX_CHARS) -> tuple[DataFrame, dict[int, int]]:
    return labelled_rows(docs, labels, "toxic", FOLDS, HELD_OUT, {0: n_clean, 1: n_toxic}, max_chars)


def fit(docs: DataFrame, labels: DataFrame, **fitting) -> ToxicityModel:
    """The model, on the driver."""
    rows, counts = _sample(docs, labels, **fitting)
    return ToxicityModel([tuple(r) for r in rows.collect()], counts)


def _ready(docs: DataFrame, labels: DataFrame, model: ToxicityModel | None, **fitting) -> Callable[[], ToxicityModel]:
    """Gives a worker the model. A given one is broadcast; else a task fits it to the bounded sample and stores it in the shared folder, so neither sample nor model passes through the driver."""
    if model is None:
        rows, counts = _sample(docs, labels, **fitting)
        folder = shared_path(docs.sparkSession, "toxicity")

        def build(sample: pa.Table) -> pa.Table:
            columns = (sample[c].to_pylist() for c in ("doc_id", "label", "text"))
            return pa.table({"place": [stored(folder, "model", ToxicityModel(list(zip(*columns, strict=True)), counts))]})

        places = [r.place for r in rows.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(build, "place string").collect()]
        if places:
            return partial(of_worker, ("toxicity", places[0]), partial(loaded, places[0]))
        model = ToxicityModel([], counts)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return lambda: shared.value


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, model: ToxicityModel | None = None, **fitting) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) for each row of docs. evidence: neighbour's doc_id:label:cosine, nearest first."""
    ready = _ready(docs, labels, model, **fitting)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ready()
        for batch in sliced(batches):
            score, evidence = [], []
            for s, near in model.scores(str_texts(batch)):
                score.append(s)
                evidence.append(",".join(f"{model.ids[i]}:{model.labels[i]}:{c:.4f}" for c, i in near))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64()), pa.array([int(s >= threshold) for s in score], pa.int32()), pa.array(evidence, pa.string())], ["doc_id", "score", "predicted", "evidence"])

    out = text_frame(docs).mapInArrow(scores, "doc_id long, score double, predicted int, evidence string")
    return out.select("doc_id", F.coalesce(fold(FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted", "evidence")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, model: ToxicityModel | None = None, **fitting) -> DataFrame:
    """The rows of docs, with all columns, whose score is below the threshold."""
    ready = _ready(docs, labels, model, **fitting)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ready()
        for batch in sliced(batches):
            yield batch.filter(pa.array([s < threshold for s, _ in model.scores(str_texts(batch))], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
