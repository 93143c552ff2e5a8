"""Reversible line deduplication: sharded cuckoo filters backed by exact reference-count tables.

A line's key is its text without ASCII white space at the ends and with A-Z lower-cased. Keys of at least min_chars code
points that min_docs documents hold lose all their lines except in the largest doc_id holding them.

The exact side is a table of references (one row for each document and key) and the counts it sums up to. The filters hold
16-bit fingerprints of the keys that are droppable just now, sharded by key. They spare the exact lookup for the lines whose
key no filter knows; what a filter lets through is decided by the counts. Small filters are broadcast to the scan of the texts,
others meet the references shard by shard. Deleting documents takes references and
fingerprints back, so an index after insert(x) and delete(x) answers as before.

Defined cases: null text is one empty line. A document in several rows (same doc_id) counts once. Rows without doc_id hold
no references: they don't count, and lose the lines that others keep. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netframe.llm.common import materialize, raw_texts, shared_path, sliced, text_frame

SPACE = b" \t\n\x0b\x0c\r"
MIN_CHARS = 20
MIN_DOCS = 3
#: Shards at least; more where the keys ask for them.
N_SHARDS = 64
#: Keys of a shard's filter, about.
SHARD_KEYS = 1 << 17
#: Filters are broadcast up to this size; beyond it references go to their shard's filter.
MAX_FILTER_BYTES = 64 << 20
#: Tasks that the references of one shard are dealt to, each with the shard's filter: a key that many documents have is not one task's.
SALTS = 16

REF_SCHEMA = "doc_id long, hi long, lo long, n_lines long"
FILTER_SCHEMA = "shard int, n_keys long, cells binary"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of a line's key; None for short lines."""
    key = line.strip(SPACE).lower()
    if len(key) < min_chars or not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def _pairs(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)


def line_references(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, hi, lo, n_lines): the keys of each document, once each, with the number of its lines."""

    def refs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids, digests, counts = [], [], []
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), raw_texts(batch), strict=True):
                own: dict[bytes, int] = {}
                for line in raw.split(b"\n"):
                    if len(line) >= min_chars and (key := line_key(line, min_chars)):
                        own[key] = own.get(key, 0) + 1
                ids += [doc_id] * len(own)
                digests += own
                counts += own.values()
            pairs = _pairs(digests)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(counts, pa.int64())], ["doc_id", "hi", "lo", "n_lines"])

    return text_frame(docs).mapInArrow(refs, REF_SCHEMA)


def reference_counts(refs: DataFrame) -> DataFrame:
    """(hi, lo, n_docs, keeper): how many documents hold a key, and the largest of them. Partial sums precede both shuffles, so a key that a third of all documents hold is one row from each task."""
    own = refs.groupBy("hi", "lo", "doc_id").agg(F.first("doc_id").alias("held"))
    return own.groupBy("hi", "lo").agg(F.count("held").alias("n_docs"), F.max("held").alias("keeper"))


# -- cuckoo filters -------------------------------------------------------------------------------------------------

SLOTS, KICKS = 4, 500


def _mixed(x: np.ndarray | int):
    """Spread of a fingerprint over bucket numbers."""
    return (x * 0x5BD1E995) & 0xFFFFFFFF


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four; a key's second bucket follows from its first and its fingerprint, so that it can be moved and deleted without the key."""

    def __init__(self, cells: np.ndarray | None = None, n_keys: int = 0, capacity: int = 0):
        n = 1
        while n * SLOTS * 0.9 < capacity:
            n *= 2
        self.cells = np.zeros((n, SLOTS), np.uint16) if cells is None else cells
        self.n_keys = n_keys

    @staticmethod
    def fingerprint(hi: int) -> int:
        return ((hi >> 40) & 0xFFFF) or 1

    def _places(self, hi: int, lo: int) -> tuple[int, int, int]:
        mask, fp = len(self.cells) - 1, self.fingerprint(hi)
        one = lo & mask
        return fp, one, one ^ (_mixed(fp) & mask)

    def insert(self, hi: int, lo: int) -> bool:
        """False if the filter is full; then it has to be rebuilt from the exact table."""
        fp, one, two = self._places(hi, lo)
        for at in (one, two):
            free = np.flatnonzero(self.cells[at] == 0)
            if len(free):
                self.cells[at, free[0]] = fp
                self.n_keys += 1
                return True
        at, mask = two, len(self.cells) - 1
        for kick in range(KICKS):
            slot = (kick * 7 + fp) % SLOTS
            fp, self.cells[at, slot] = int(self.cells[at, slot]), fp
            at ^= _mixed(fp) & mask
            free = np.flatnonzero(self.cells[at] == 0)
            if len(free):
                self.cells[at, free[0]] = fp
                self.n_keys += 1
                return True
        return False

    def delete(self, hi: int, lo: int) -> bool:
        """Takes one copy of the fingerprint out; only for keys that were inserted."""
        fp, *places = self._places(hi, lo)
        for at in places:
            held = np.flatnonzero(self.cells[at] == fp)
            if len(held):
                self.cells[at, held[0]] = 0
                self.n_keys -= 1
                return True
        return False

    def __contains__(self, pair: tuple[int, int]) -> bool:
        fp, one, two = self._places(*pair)
        return fp in self.cells[one] or fp in self.cells[two]

    @classmethod
    def of(cls, pairs: np.ndarray) -> CuckooFilter:
        """A filter of these keys, as large as they need."""
        capacity, rows = max(4, len(pairs)), [(int(h), int(x)) for h, x in pairs]
        while True:
            made = cls(capacity=capacity)
            if all(made.insert(h, x) for h, x in rows):
                return made
            capacity *= 2


def _shard(n_shards: int):
    return F.pmod(F.col("hi"), F.lit(n_shards)).cast("int").alias("shard")


def cuckoo_filters(keys: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """(shard, n_keys, cells) of the keys (hi, lo): a filter for each shard, built where the shard's keys are."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def row() -> pa.RecordBatch:
            made = CuckooFilter.of(np.concatenate(held))
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([made.n_keys], pa.int64()), pa.array([made.cells.tobytes()], pa.binary())], ["shard", "n_keys", "cells"])

        for batch in batches:  # sorted by shard
            shards = batch.column("shard").to_numpy()
            pairs = np.column_stack([batch.column("hi").to_numpy(), batch.column("lo").to_numpy()])
            for part, shard in zip(np.split(pairs, np.flatnonzero(np.diff(shards)) + 1), shards[np.r_[0, np.flatnonzero(np.diff(shards)) + 1]] if len(shards) else [], strict=False):
                if at is not None and shard != at:
                    yield row()
                    held = []
                at = int(shard)
                held.append(part)
        if held:
            yield row()

    return keys.select(_shard(n_shards), "hi", "lo").repartition("shard").sortWithinPartitions("shard").mapInArrow(build, FILTER_SCHEMA)


class FilterBank:
    """All shards' filters side by side, probed with arrays of keys."""

    def __init__(self, rows: list[tuple[int, bytes]], n_shards: int):
        self.n_shards = n_shards
        self.start, self.mask = np.zeros(n_shards, np.int64), np.full(n_shards, -1, np.int64)
        parts, at = [], 0
        for shard, cells in rows:
            part = np.frombuffer(cells, np.uint16).reshape(-1, SLOTS)
            self.start[shard], self.mask[shard] = at, len(part) - 1
            parts.append(part)
            at += len(part)
        self.cells = np.concatenate(parts) if parts else np.zeros((1, SLOTS), np.uint16)

    def probe(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """True where a key may be held, false where it isn't."""
        shard = hi % self.n_shards  # of the divisor's sign, as pmod
        mask, start = self.mask[shard], self.start[shard]
        fp = (hi >> 40) & 0xFFFF
        fp[fp == 0] = 1
        one = lo & mask
        two = one ^ (_mixed(fp) & mask)
        known = mask >= 0
        one, two = np.where(known, one + start, 0), np.where(known, two + start, 0)
        return known & ((self.cells[one] == fp[:, None]) | (self.cells[two] == fp[:, None])).any(axis=1)


def _bank(filters: DataFrame, n_shards: int, max_bytes: int) -> FilterBank | None:
    """The filters for the executors, or None if they are larger than max_bytes together."""
    total = filters.agg(F.sum(F.length("cells"))).first()[0] or 0
    if total > max_bytes:
        return None
    return FilterBank([(r.shard, bytes(r.cells)) for r in filters.select("shard", "cells").collect()], n_shards)


def _probed(refs_source: DataFrame, bank: FilterBank, min_chars: int) -> DataFrame:
    """(doc_id, hi, lo) of the lines that the filters may hold."""
    shared = refs_source.sparkSession.sparkContext.broadcast(bank)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids, digests = [], []
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), raw_texts(batch), strict=True):
                own = {key for line in raw.split(b"\n") if len(line) >= min_chars and (key := line_key(line, min_chars))}
                ids += [doc_id] * len(own)
                digests += own
            pairs = _pairs(digests)
            hit = shared.value.probe(pairs[:, 0].copy(), pairs[:, 1])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()).filter(pa.array(hit)), pa.array(pairs[hit, 0]), pa.array(pairs[hit, 1])], ["doc_id", "hi", "lo"])

    return text_frame(refs_source).mapInArrow(probe, "doc_id long, hi long, lo long")


def _probed_by_shard(docs: DataFrame, filters: DataFrame, n_shards: int, min_chars: int) -> DataFrame:
    """(doc_id, hi, lo) of the lines that the filters may hold: each reference goes to a task that has its shard's filter."""
    refs = line_references(docs, min_chars).select(_shard(n_shards), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"), F.lit(1).alias("kind"), "doc_id", "hi", "lo", F.lit(None).cast("binary").alias("cells"))
    null = F.lit(None).cast("long")
    held = filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(0).alias("kind"), null.alias("doc_id"), null.alias("hi"), null.alias("lo"), "cells")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, bank = None, None
        for batch in batches:  # sorted: a shard's filter comes before its references
            filters_at = np.flatnonzero(batch.column("kind").to_numpy() == 0).tolist()
            cuts = sorted({0, *filters_at, *(i + 1 for i in filters_at), batch.num_rows})
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(i, j - i)
                if i in filters_at:
                    shard, bank = part.column("shard")[0].as_py(), FilterBank([(0, part.column("cells")[0].as_py())], 1)
                elif bank is not None:
                    hit = bank.probe(part.column("hi").to_numpy().copy(), part.column("lo").to_numpy()) & (part.column("shard").to_numpy() == shard)
                    yield part.filter(pa.array(hit)).select(["doc_id", "hi", "lo"])

    both = held.unionByName(refs).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    return both.mapInArrow(probe, "doc_id long, hi long, lo long")


def _drops(docs: DataFrame, min_chars: int, min_docs: int, n_shards: int, max_filter_bytes: int, index: LineIndex | None) -> DataFrame:
    """(drop_id, hi, lo): the keys whose lines a document loses, in two arrays."""
    if index is None:
        heavy = materialize(reference_counts(line_references(docs, min_chars)).where(F.col("n_docs") >= min_docs), "line-counts")
        n_shards = max(n_shards, heavy.count() // SHARD_KEYS)
        filters = materialize(cuckoo_filters(heavy, n_shards), "line-filters")
    else:
        heavy, filters, n_shards = index.counts().where(F.col("n_docs") >= min_docs), index.filters(), index.n_shards
    bank = _bank(filters, n_shards, max_filter_bytes)
    maybe = _probed(docs, bank, min_chars) if bank is not None else _probed_by_shard(docs, filters, n_shards, min_chars)
    held = maybe.join(heavy.select("hi", "lo", "keeper"), ["hi", "lo"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    # a document's own lines at most
    return held.groupBy(F.col("doc_id").alias("drop_id")).agg(F.collect_set(F.struct("hi", "lo")).alias("keys")).select("drop_id", F.col("keys.hi").alias("hi"), F.col("keys.lo").alias("lo"))


def _kept_lines(raw: bytes, hi: list[int] | None, lo: list[int] | None, min_chars: int) -> tuple[list[bytes], list[bytes]]:
    """All lines of a text, and those that stay."""
    lines = raw.split(b"\n")
    if not hi:
        return lines, lines
    drop = {bytes(x) for x in np.column_stack([np.array(hi, "<i8"), np.array(lo, "<i8")])}
    return lines, [x for x in lines if len(x) < min_chars or line_key(x, min_chars) not in drop]


def dedup_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, n_shards: int = N_SHARDS, max_filter_bytes: int = MAX_FILTER_BYTES, with_text: bool = True, index: LineIndex | None = None
) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256, and kept_text if with_text) for each row of docs. With an index, its keys decide instead of those of docs."""
    drops = _drops(docs, min_chars, min_docs, n_shards, max_filter_bytes, index)
    own = text_frame(docs)
    joined = own.join(drops, own.doc_id.eqNullSafe(drops.drop_id), "left").select("doc_id", "text", "hi", "lo")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            n_lines, n_dropped, sums, kept_texts = [], [], [], []
            for raw, hi, lo in zip(raw_texts(batch), batch.column("hi").to_pylist(), batch.column("lo").to_pylist(), strict=True):
                lines, kept = _kept_lines(raw, hi, lo, min_chars)
                text = b"\n".join(kept)
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
                sums.append(hashlib.sha256(text).hexdigest())
                kept_texts.append(text)
            out = [batch.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(sums, pa.string())]
            names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
            if with_text:
                out.append(pa.array(kept_texts, pa.binary()).cast(pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(out, names)

    return joined.mapInArrow(rewrite, "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + ", kept_text string" * with_text)


def without_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, n_shards: int = N_SHARDS, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """docs with all its columns; text holds only the lines that stay, and n_chars, where there is one, their length."""
    drops = _drops(docs, min_chars, min_docs, n_shards, max_filter_bytes, None)
    name = "dropped_keys"
    while name in docs.columns:
        name += "_"
    keys = drops.select(F.struct(*drops.columns).alias(name))
    joined = docs.join(keys, docs.doc_id.cast("long").eqNullSafe(keys[name].drop_id), "left")
    columns, schema = docs.columns, docs.schema

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = []
            for raw, keys in zip(raw_texts(batch), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                texts.append(b"\n".join(_kept_lines(raw, keys["hi"], keys["lo"], min_chars)[1]) if keys else raw)
            made = pa.array(texts, pa.binary()).cast(pa.string())
            made = pc.if_else(pc.and_(pc.is_null(batch.column("text")), pc.equal(made, "")), None, made)
            own = {"text": made, "n_chars": pc.utf8_length(made)}
            yield pa.RecordBatch.from_arrays([own[c].cast(batch.column(k).type) if c in own else batch.column(k) for k, c in enumerate(columns)], columns)

    return joined.mapInArrow(rewrite, schema)


class LineIndex:
    """The state on disk: references, deleted documents, exact counts and filters. A change writes only itself, as a new generation:
    the references that come, the documents that go, and the counts and filters of the keys and shards that it touches; the
    youngest generation of a key or shard holds. The generation number moves on only after all is whole, so a job that fails leaves
    the index as it was. compacted() writes all of it as one generation."""

    TABLES = {"refs": REF_SCHEMA, "gone": "doc_id long", "counts": "hi long, lo long, n_docs long, keeper long", "filters": FILTER_SCHEMA}

    def __init__(self, spark: SparkSession, path: str | None = None, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, n_shards: int = N_SHARDS):
        self.spark, self.path = spark, path or shared_path(spark, "line-index")
        self.min_chars, self.min_docs, self.n_shards, self.generations = min_chars, min_docs, n_shards, []

    def _at(self, table: str, generation: int) -> str:
        return f"{self.path}/{table}-{generation}"

    def _all(self, table: str) -> DataFrame:
        """All generations of a table, with their number (generation)."""
        parts = [self.spark.read.schema(self.TABLES[table]).parquet(self._at(table, g)).withColumn("generation", F.lit(g)) for g in self.generations]
        out = self.spark.createDataFrame([], f"{self.TABLES[table]}, generation int")
        for part in parts:
            out = out.unionByName(part)
        return out

    def references(self) -> DataFrame:
        """The references of all documents that are in the index now."""
        gone = self._all("gone").groupBy(F.col("doc_id").alias("gone_id")).agg(F.max("generation").alias("gone_at"))
        refs = self._all("refs")
        return refs.join(gone, refs.doc_id == gone.gone_id, "left").where("gone_at is null or gone_at < generation").select("doc_id", "hi", "lo", "n_lines")

    def counts(self) -> DataFrame:
        return self._all("counts").groupBy("hi", "lo").agg(F.max_by(F.struct("n_docs", "keeper"), "generation").alias("x")).select("hi", "lo", "x.*").where("n_docs > 0")

    def filters(self) -> DataFrame:
        return self._all("filters").groupBy("shard").agg(F.max_by(F.struct("n_keys", "cells"), "generation").alias("x")).select("shard", "x.*").where("n_keys > 0")

    def _write(self, refs: DataFrame, gone: DataFrame, touched: DataFrame) -> LineIndex:
        """touched: (hi, lo, n_docs, keeper) of the keys that change, after the change."""
        at = self.generations[-1] + 1 if self.generations else 0
        refs.write.parquet(self._at("refs", at))
        gone.write.parquet(self._at("gone", at))
        touched.write.parquet(self._at("counts", at))
        now = self.spark.read.schema(self.TABLES["counts"]).parquet(self._at("counts", at))
        self._changed(now).write.parquet(self._at("filters", at))
        self.generations.append(at)
        return self

    def _changed(self, now: DataFrame) -> DataFrame:
        """The filters of the shards in which keys have become droppable (those are inserted) or no longer are (those are deleted)."""
        enough = F.col("n_docs") >= self.min_docs
        old = self.counts().where(enough).select("hi", "lo", F.lit(True).alias("was"))
        edits = now.join(old, ["hi", "lo"], "left").select("hi", "lo", enough.alias("add"), F.coalesce("was", F.lit(False)).alias("was")).where("add <> was").select(_shard(self.n_shards), "hi", "lo", "add")
        edits = materialize(edits, "line-filter-edits")

        def change(filters: pa.Table, edits: pa.Table) -> pa.Table:
            shard = edits["shard"][0].as_py()
            if filters.num_rows:
                made = CuckooFilter(np.frombuffer(filters["cells"][0].as_py(), np.uint16).reshape(-1, SLOTS).copy(), filters["n_keys"][0].as_py())
            else:
                made = CuckooFilter(capacity=max(4, edits.num_rows))
            full = False
            for hi, lo, add in sorted(zip(edits["hi"].to_pylist(), edits["lo"].to_pylist(), edits["add"].to_pylist(), strict=True), key=lambda x: x[2]):
                full = full or not (made.insert(hi, lo) if add else made.delete(hi, lo))
            return pa.table({"shard": pa.array([shard], pa.int32()), "n_keys": pa.array([-1 if full else made.n_keys], pa.int64()), "cells": pa.array([b"" if full else made.cells.tobytes()], pa.binary())})

        own = self.filters().join(edits.select("shard").distinct(), "shard", "left_semi")
        done = materialize(own.groupBy("shard").cogroup(edits.groupBy("shard")).applyInArrow(change, FILTER_SCHEMA), "line-filter-changes")
        full = done.where("n_keys < 0").select("shard")  # a shard that has outgrown its filter
        after = self.counts().where(enough).select("hi", "lo").join(now, ["hi", "lo"], "left_anti").unionByName(now.where(enough).select("hi", "lo"))
        rebuilt = cuckoo_filters(after.select(_shard(self.n_shards), "hi", "lo").join(full, "shard", "left_semi"), self.n_shards)
        return done.where("n_keys >= 0").unionByName(rebuilt)

    def insert(self, docs: DataFrame) -> LineIndex:
        """Adds documents; those that the index has are left as they are, and rows without doc_id are none."""
        known = self.references().select("doc_id").distinct()
        new = line_references(docs.where("doc_id is not null"), self.min_chars).join(known, "doc_id", "left_anti").dropDuplicates(["doc_id", "hi", "lo"])
        new = materialize(new, "line-references")
        more = reference_counts(new)
        old = self.counts().select("hi", "lo", F.col("n_docs").alias("n"), F.col("keeper").alias("k"))
        touched = more.join(old, ["hi", "lo"], "left").select("hi", "lo", (F.col("n_docs") + F.coalesce("n", F.lit(0))).alias("n_docs"), F.greatest("keeper", "k").alias("keeper"))
        return self._write(new, self.spark.createDataFrame([], "doc_id long"), touched)

    def delete(self, ids: DataFrame) -> LineIndex:
        """Takes the documents of ids (doc_id) back out. Keys that they held are counted again, others aren't touched."""
        gone = materialize(ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct(), "gone-documents")
        live = self.references()
        held = materialize(live.join(gone, "doc_id", "left_semi").select("hi", "lo").distinct(), "touched-keys")
        left = reference_counts(live.join(held, ["hi", "lo"], "left_semi").join(gone, "doc_id", "left_anti"))
        touched = held.join(left, ["hi", "lo"], "left").select("hi", "lo", F.coalesce("n_docs", F.lit(0)).cast("long").alias("n_docs"), "keeper")
        return self._write(self.spark.createDataFrame([], REF_SCHEMA), gone, touched)

    def compacted(self, path: str | None = None) -> LineIndex:
        """The same index as one generation, in a new place."""
        made = LineIndex(self.spark, path, self.min_chars, self.min_docs, self.n_shards)
        for table, rows in (("refs", self.references()), ("gone", self.spark.createDataFrame([], "doc_id long")), ("counts", self.counts()), ("filters", self.filters())):
            rows.write.parquet(made._at(table, 0))
        made.generations.append(0)
        return made
