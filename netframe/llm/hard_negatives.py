"""Hard-negative mining: for each anchor its best rows of the same label, and for each of these the best rows of other labels whose
score lies in a band below it. Scores are integer inner products; the search is exact.

Vectors are turned by an orthogonal matrix, the eigenvectors of the sum of all rows' outer products, largest first, so that leading
components carry most of a product. For a block of rows and a block of anchors the products over the leading components are taken at
once. What the other components can add is at most the product of both residual norms (Cauchy and Schwarz), plus a slack for the
rounding of single precision; pairs that can't reach their anchor's last kept score, or can't lie in a band, are let go. The pairs
left take the next components, with smaller residuals, and so on; those left after the last group are scored by integer products,
which alone decide.

Anchors are written to the shared folder in blocks; a task holds one block of rows at a time and reads the anchor blocks one after the
other. It sends the best few of its block for each anchor, and these are merged by a window that keeps few rows before its shuffle. A label
or a vector that a third of all rows have is nobody's group. Two passes: positives, then negatives within the bands they give.

Defined cases: rows with a null identifier, label or vector, or a null or non-finite component take no part. Other rows are those with
another vec_id. Repeated rows count as rows, as candidates and as anchors (each has its results). Ties go to the smaller vec_id.
Vectors of different lengths are filled up with zeros; components are clipped as vectors.MAX_COMPONENT says. A band below a negative
score is empty. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netframe.llm.common import loaded, materialize, shared_path, stored
from netframe.llm.vectors import SCALE, integer_vectors, matrix

ANCHOR_EVERY, POSITIVES, NEGATIVES = 50, 5, 3
#: A negative's score is between these hundredths of the positive's.
LOW, HIGH = 50, 95
#: Anchors of a stored block, rows that a task holds at a time, and rows whose products with a block of anchors are held at a time.
ANCHOR_BLOCK, ROW_BLOCK, TILE = 512, 65_536, 4096
#: Components are added in groups that end at these parts of all.
GROUPS = (0.25, 0.5, 0.75, 1.0)
_NONE = np.iinfo(np.int64).min


class Block(NamedTuple):
    """Rows or anchors: identifiers, labels, integer vectors, turned vectors in single precision, and the norms of what is left behind each group."""

    ids: np.ndarray
    labels: np.ndarray
    q: np.ndarray
    turned: np.ndarray
    rest: np.ndarray

    def part(self, at: slice | np.ndarray) -> Block:
        return Block(*(x[at] for x in self))


def group_ends(width: int) -> list[int]:
    return sorted({max(1, round(width * g)) for g in GROUPS})


def block_of(ids: np.ndarray, labels: np.ndarray, q: np.ndarray, rotation: np.ndarray) -> Block:
    turned = q.astype(np.float64) @ rotation
    squares = np.cumsum((turned * turned)[:, ::-1], axis=1)[:, ::-1]
    rest = np.zeros((len(q), 1 + len(group_ends(q.shape[1]))))
    rest[:, 0] = np.sqrt(squares[:, 0])  # the whole norm
    for g, end in enumerate(group_ends(q.shape[1])[:-1], 1):
        rest[:, g] = np.sqrt(squares[:, end])
    return Block(ids, labels, q, turned.astype(np.float32), rest * (1 + 1e-6))


def rotation_of(vectors: DataFrame, width: int) -> np.ndarray:
    """The orthogonal matrix: tasks sum outer products, and width ** 2 sums reach the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = matrix(batch.column("q"), width).astype(np.float64)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width), pa.int32()), pa.array(total.ravel())], ["k", "v"])

    sums = np.zeros(width * width)
    for r in vectors.select("q").mapInArrow(add, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        sums[r.k] = r.v
    return np.linalg.eigh(sums.reshape(width, width))[1][:, ::-1].copy()


def best(anchor: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of each anchor's k first rows by descending score, then identifier; anchors stand together."""
    order = np.lexsort((ids, -score, anchor))
    a = anchor[order]
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
    rank = np.arange(len(a)) - np.repeat(first, np.diff(np.r_[first, len(a)]))
    return order[rank < k]


class Search:
    """Pairs of a block of rows and a block of anchors, in tiles."""

    def __init__(self, anchors: Block, width: int):
        self.a, self.ends = anchors, group_ends(width)
        self.slack = 2.0**-22 * (width + 8)  # of the product of both norms: over twice what single precision can be off
        self.pairs = self.scored = 0

    def scores(self, rows: Block, at: np.ndarray | slice, least: np.ndarray, most: np.ndarray, allowed: np.ndarray, k: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, exact score) of the pairs that may score from least to most, both by anchor. at: the anchors taken; allowed: pairs that are asked for.
        k: only an anchor's k best are asked for, so that none is below the k-th of what its pairs score at least."""
        a, end = self.a.part(at), self.ends[0]
        slack = self.slack * a.rest[:, 0]
        so_far = a.turned[:, :end] @ rows.turned[:, :end].T
        room = a.rest[:, 1, None] * rows.rest[:, 1] + slack[:, None] * rows.rest[:, 0]
        if 0 < k <= so_far.shape[1]:
            least = np.maximum(least, np.partition(np.where(allowed, so_far - room, -np.inf), -k, axis=1)[:, -k])
        open_ = allowed & (so_far + room >= least[:, None]) & (so_far - room <= most[:, None])
        self.pairs += open_.size
        i, j = np.nonzero(open_)
        so_far = so_far[i, j].astype(np.float64)
        for g, (begin, end) in enumerate(zip(self.ends[:-1], self.ends[1:], strict=True), 2):
            so_far += np.einsum("ij,ij->i", a.turned[i, begin:end], rows.turned[j, begin:end])
            room = a.rest[i, g] * rows.rest[j, g] + slack[i] * rows.rest[j, 0]
            keep = (so_far + room >= least[i]) & (so_far - room <= most[i])
            i, j, so_far = i[keep], j[keep], so_far[keep]
        self.scored += len(i)
        return i, j, np.einsum("ij,ij->i", a.q[i], rows.q[j])

    def positives(self, rows: Block, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, identifier, score) of each anchor's k best rows of its label. rows are sorted by label."""
        kept = tuple(np.zeros(0, np.int64) for _ in range(3))
        last = np.full(len(self.a.ids), _NONE)  # the score that a further row has to reach
        for label in np.unique(self.a.labels):
            at = np.flatnonzero(self.a.labels == label)
            begin, end = np.searchsorted(rows.labels, [label, label + 1])
            for tile in range(begin, end, TILE):
                own = rows.part(slice(tile, min(tile + TILE, end)))
                other = self.a.ids[at, None] != own.ids
                i, j, s = self.scores(own, at, last[at].astype(np.float64), np.full(len(at), np.inf), other, k)
                found = tuple(map(np.concatenate, zip(kept, (at[i], own.ids[j], s), strict=True)))
                keep = best(found[0], found[2], found[1], k)
                kept = tuple(x[keep] for x in found)
                self._raise(last, kept[0], kept[2], k)
        return kept

    @staticmethod
    def _raise(last: np.ndarray, anchor: np.ndarray, score: np.ndarray, k: int) -> None:
        """Anchors with k rows have to beat the k-th; kept rows stand by anchor, best first."""
        full = np.flatnonzero(np.bincount(anchor, minlength=len(last)) >= k)
        ends = np.searchsorted(anchor, full, side="right") - 1
        last[full] = score[ends]

    def negatives(self, rows: Block, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor * n + positive, identifier, score) of the k best rows of other labels in each band. low and high: n bands for each anchor; an empty one has low over high."""
        n = low.shape[1]
        kept = tuple(np.zeros(0, np.int64) for _ in range(3))
        last = low.ravel().copy()
        every = slice(None)
        for tile in range(0, len(rows.ids), TILE):
            own = rows.part(slice(tile, tile + TILE))
            needed = np.where(low <= high, last.reshape(-1, n), np.iinfo(np.int64).max)
            least, most = needed.min(axis=1).astype(np.float64), np.where(low <= high, high, _NONE).max(axis=1).astype(np.float64)
            i, j, s = self.scores(own, every, least, most, (self.a.labels[:, None] != own.labels) & (self.a.ids[:, None] != own.ids))
            band, pair = np.nonzero(((s >= last.reshape(-1, n)[i].T) & (s <= high[i].T)))
            found = tuple(map(np.concatenate, zip(kept, (i[pair] * n + band, own.ids[j[pair]], s[pair]), strict=True)))
            keep = best(found[0], found[2], found[1], k)
            kept = tuple(x[keep] for x in found)
            self._raise(last, kept[0], kept[2], k)
        return kept


def _row_blocks(batches: Iterator[pa.RecordBatch], rotation: np.ndarray) -> Iterator[Block]:
    """Blocks of a task's rows, sorted by label."""

    def made() -> Block:
        ids, labels, q = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(labels, kind="stable")
        return block_of(ids[order], labels[order], q[order], rotation)

    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, ROW_BLOCK):
            part = batch.slice(at, ROW_BLOCK)
            if held and n + part.num_rows > ROW_BLOCK:
                yield made()
                held, n = [], 0
            held.append((part.column("vec_id").to_numpy(), part.column("label").to_numpy(), matrix(part.column("q"), len(rotation))))
            n += part.num_rows
    if held:
        yield made()


def _stored_anchors(vectors: DataFrame, every: int, rotation: np.ndarray, path: str) -> DataFrame:
    """Writes the anchors in blocks; returns (block, place, n)."""
    anchors = vectors.where(F.col("vec_id") % every == 0)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, held = TaskContext.get(), []

        def put() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            block = block_of(rows.column("vec_id").to_numpy(), rows.column("label").to_numpy(), matrix(rows.column("q"), len(rotation)), rotation)
            number = context.partitionId() << 32 | made
            place = stored(path, f"anchors-{number}-{context.taskAttemptId()}", tuple(block))
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([place])], ["block", "place"])

        made = 0
        for batch in batches:
            for at in range(0, batch.num_rows, ANCHOR_BLOCK):
                part = batch.slice(at, ANCHOR_BLOCK)
                if held and sum(x.num_rows for x in held) + part.num_rows > ANCHOR_BLOCK:
                    yield put()
                    held, made = [], made + 1
                held.append(part)
        if held:
            yield put()

    tasks = 1 + anchors.count() // ANCHOR_BLOCK
    return materialize(anchors.coalesce(tasks).mapInArrow(write, "block long, place string"), "anchor-blocks")


def _top(found: DataFrame, k: int, *group: str) -> DataFrame:
    first = Window.partitionBy(*group).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def _positives(vectors: DataFrame, places: list[tuple[int, str]], rotation: np.ndarray, k: int) -> DataFrame:
    """(block, pos, rank, vec_id, score): each anchor's k best rows of its label."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _row_blocks(batches, rotation):
            for number, place in places:
                at, ids, scores = Search(Block(*loaded(place)), len(rotation)).positives(rows, k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), number)), pa.array(at, pa.int32()), pa.array(ids), pa.array(scores)], ["block", "pos", "vec_id", "score"])

    return _top(vectors.mapInArrow(search, "block long, pos int, vec_id long, score long"), k, "block", "pos")


def _stored_bands(positives: DataFrame, places: dict[int, str], k: int, low: int, high: int, path: str) -> DataFrame:
    """Each block's positives and bands, (anchors, k) arrays; returns (block, place). A block has ANCHOR_BLOCK anchors at most, so its group is bounded."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, rows in zip(batch.column("block").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                n = len(loaded(places[number])[0])
                ids, scores = np.zeros((n, k), np.int64), np.zeros((n, k), np.int64)
                least, most = np.ones((n, k), np.int64), np.zeros((n, k), np.int64)  # empty bands
                for r in rows:
                    at = r["pos"], r["rank"] - 1
                    ids[at], scores[at] = r["vec_id"], r["score"]
                    least[at], most[at] = -(-low * r["score"] // 100), high * r["score"] // 100
                place = stored(path, f"bands-{number}-{TaskContext.get().taskAttemptId()}", (ids, scores, least, most))
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([place])], ["block", "place"])

    grouped = positives.groupBy("block").agg(F.collect_list(F.struct("pos", "rank", "vec_id", "score")).alias("rows"))
    return materialize(grouped.mapInArrow(write, "block long, place string"), "bands")


def mine_hard_negatives(
    rows: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    every: int = ANCHOR_EVERY,
    n_positives: int = POSITIVES,
    n_negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); anchors are the rows whose identifier every divides."""
    spark = rows.sparkSession
    vectors = integer_vectors(rows, id_col, vec_col, F.col(label_col).cast("long").alias("label"), scale=scale)
    vectors = materialize(vectors.where("vec_id IS NOT NULL AND label IS NOT NULL"), "vectors")
    width = max(1, vectors.agg(F.max(F.size("q"))).first()[0] or 1)
    rotation, path = rotation_of(vectors, width), shared_path(spark, "anchors")
    places = [(r.block, r.place) for r in _stored_anchors(vectors, every, rotation, path).collect()]  # a row for each block
    positives = _positives(vectors, places, rotation, n_positives)
    bands = {r.block: r.place for r in _stored_bands(positives, dict(places), n_positives, low, high, path).collect()}

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "band", "anchor_id", "positive_id", "positive_score", "vec_id", "score"]
        for block in _row_blocks(batches, rotation):
            for number, place in places:
                if number in bands:
                    anchors = Block(*loaded(place))
                    ids, scores, least, most = loaded(bands[number])
                    at, found, score = Search(anchors, width).negatives(block, least, most, n_negatives)
                    columns = np.full(len(at), number), at, anchors.ids[at // ids.shape[1]], ids.ravel()[at], scores.ravel()[at], found, score
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names)

    found = vectors.mapInArrow(search, "block long, band long, anchor_id long, positive_id long, positive_score long, vec_id long, score long")
    kept = _top(found, n_negatives, "block", "band")
    return kept.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
