"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence that accumulates overlap counts and
discards what size-derived bounds rule out, down to connected components of exact links.

A document's set holds its distinct shingles of size words (the whole sequence as one where there are fewer). Two documents
link when percent * |union| <= 100 * |intersection|. Sets of nearly all documents have no partner, so the product is taken in passes
that each leave less:

1. Incidence in blocks. Documents are blocked by the text that a task holds at once, n-grams by their hash. A cell of that
   grid is one row: the n-grams of a document block in a hash block, packed. Hash blocks are as many as the bytes of text ask for,
   and a task sums one at a time: which n-grams has a second document? A partner shares at least percent of a set, so a
   document whose shared n-grams are fewer is discarded. Inside a block, repeated n-grams are summed before anything is
   shuffled: however many documents hold an n-gram, a block sends it once.
2. Equal sets become one class. Among one document of each class, the blocks are summed again; now each document block gets its
   n-grams back with how often they occur, and what a set still can't do without partners goes. N-grams are ordered from rare to
   frequent; by the overlap that sizes demand, partners share one of the first |set| - ceil(percent |set|) + 1, so only those are
   candidates' meeting points, within bands of size, and only while the n-grams behind the meeting point still suffice.
3. Overlap counts of candidate pairs are accumulated exactly: sets are cut in blocks of n-grams (one for nearly all, more for
   long documents), a pair's counts in the blocks are summed, and the sum is held against the sizes. First each class meets
   the smallest class of its n-gram and band (a linear number of pairs). Then pairs in different components meet, of which one side isn't in the largest component
   of that n-gram: a group of copies, however large, is not expanded into pairs. Skewed n-grams are split in chunks. Pairs whose
   parity signatures differ in more bits than a link allows are discarded inside the join.

Shingles are compared by 64-bit hashes of their words, sets by 128-bit hashes. Rows of docs must come in the same order when a task
runs again (a written table or a scan does), as a block's documents go by their numbers.

Defined cases: null, empty and wordless texts have an empty set, no links, and are their own component. A row without doc_id
gets the component of its set's class; a class of such rows only has no links and no component. Repeated rows have equal
results. Rows that share a doc_id but not the text belong to the components of their texts. A text of any length is one block at most. An empty table has an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netframe.llm.common import Remembered, materialize, of_worker, text_frame
from netframe.operators.components import connected_components

SIZE = 5
PERCENT = 80
#: Text of one document block, in bytes; a longer document is a block alone.
BLOCK_BYTES = 1 << 20
#: Cells that a hash block has, in bytes, at most about so many; a task holds one hash block.
BUCKET_BYTES = 16 << 20
#: N-grams of a set for each of its blocks, about.
SET_BLOCK = 8192
#: Classes of an n-gram and band that one chunk of a join key holds.
CHUNK = 2048
#: Up to so many candidate ids are broadcast to the scan that reads their texts again; beyond, a shuffle joins them.
MAX_BROADCAST_IDS = 1 << 20
#: Words whose hashes a worker remembers, in bytes.
REMEMBERED_BYTES = 24 << 20
#: Words of 64 bits in a set's parity signature.
WORDS = 8

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def shingle_sets(raws: list[bytes], size: int = SIZE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    look = of_worker("shingles", partial(Remembered, xxhash.xxh3_64_intdigest, REMEMBERED_BYTES)).__getitem__
    split = [raw.lower().split() for raw in raws]
    lengths = np.array([len(w) for w in split])
    flat = np.fromiter((h for words in split for h in map(look, words)), np.uint64, int(lengths.sum()))
    n, ends = max(0, len(flat) - size + 1), np.cumsum(lengths)
    rolled = flat[:n].copy()
    for j in range(1, size):
        rolled = (rolled ^ (rolled >> np.uint64(31))) * _MIX[j % 4] + flat[j : n + j]
    rolled = (rolled ^ (rolled >> np.uint64(29))) * _MIX[0]
    rolled ^= rolled >> np.uint64(32)
    out = []
    for words, n_words, end in zip(split, lengths.tolist(), ends.tolist(), strict=True):
        if n_words >= size:
            out.append(np.unique(rolled[end - n_words : end - size + 1]))
        else:
            out.append(np.array([xxhash.xxh3_64_intdigest(b"\0" + b" ".join(words))] if words else [], np.uint64))
    return out


def _text_blocks(batches: Iterator[pa.RecordBatch], n_bytes: int) -> Iterator[tuple[list, list[int], list[bytes]]]:
    """(doc_ids, hashes of text, texts) of about n_bytes of text each."""
    ids, sums, raws, held = [], [], [], 0
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        for i, (doc_id, text_hash) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), strict=True)):
            raw = texts[i].as_py() or b""
            ids.append(doc_id)
            sums.append(text_hash)
            raws.append(raw)
            held += len(raw) + 64
            if held >= n_bytes:
                yield ids, sums, raws
                ids, sums, raws, held = [], [], [], 0
    if ids:
        yield ids, sums, raws


def _repeated(values: np.ndarray) -> np.ndarray:
    """True at values that occur more than once."""
    order = np.argsort(values)
    held = values[order]
    same = held[1:] == held[:-1]
    out = np.zeros(len(values), bool)
    out[order] = np.r_[same, False] | np.r_[False, same]
    return out


_LONE = np.uint32(0xFFFFFFFF)  # in place of a document: an n-gram that its block has summed up already
CELL_SCHEMA = "bucket int, block long, kind int, a binary, b binary"
KNOWN = 6  # what a block knows of each document: id, whether there is one, size of the set, the first document with an equal set, n-grams shared within the block, hash of the text


def _rows(schema: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((),) * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.values(), strict=True)], list(schema))


def _cells(rows: DataFrame, size: int, n_buckets: int, fold: bool) -> DataFrame:
    """The incidence in cells: kind 0 has n-grams and their documents' numbers within the block; kind 1 has the block's documents. fold: n-grams that repeat within the block are summed up already."""
    schema = {"bucket": pa.int32(), "block": pa.int64(), "kind": pa.int32(), "a": pa.binary(), "b": pa.binary()}

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, (ids, text_hashes, raws) in enumerate(_text_blocks(batches, BLOCK_BYTES)):
            block, sets = part << 32 | k, shingle_sets(raws, size)
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            first: dict[bytes, int] = {}
            unit = [first.setdefault(d, i) for i, d in enumerate(digests)]  # equal sets count once
            own = [i for i, u in enumerate(unit) if i == u]
            grams = np.concatenate([sets[i] for i in own]) if own else np.zeros(0, np.uint64)
            of = np.repeat(np.array(own, np.uint32), [len(sets[i]) for i in own])
            shared = np.zeros(len(ids), np.int64)
            if fold:
                twice = _repeated(grams)
                shared = np.bincount(of[twice], minlength=len(ids))
                marks = np.unique(grams[twice])
                grams, of = np.r_[grams[~twice], marks], np.r_[of[~twice], np.full(len(marks), _LONE)]
            bucket = (grams >> np.uint64(17)) % np.uint64(n_buckets)
            order = np.argsort(bucket, kind="stable")
            grams, of, bucket = grams[order], of[order], bucket[order]
            cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=np.uint64(n_buckets))), len(bucket)).tolist() if len(bucket) else [0]
            out = [(int(bucket[i]), block, 0, grams[i:j].tobytes(), of[i:j].tobytes()) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            known = np.array([(i if i is not None else 0, i is not None, len(s), u, n, h) for i, s, u, n, h in zip(ids, sets, unit, shared.tolist(), text_hashes, strict=True)], np.int64)
            out.append((block % n_buckets, block, 1, known.tobytes(), b"".join(digests)))
            yield _rows(schema, out)

    return rows.mapInArrow(cells, CELL_SCHEMA)


SUM_SCHEMA = "block long, kind int, a binary, b binary, c binary"


def _sums(batches: Iterator[pa.RecordBatch], counted: bool) -> Iterator[pa.RecordBatch]:
    """Of the n-grams in a hash block's cells, those that occur again: back to each block, the numbers of its documents with one, and if counted the n-grams and how many have them. One hash block is in memory at a time: cells come sorted by it."""
    schema = {"block": pa.int64(), "kind": pa.int32(), "a": pa.binary(), "b": pa.binary(), "c": pa.binary()}
    at, blocks, grams, of = None, [], [], []

    def summed() -> pa.RecordBatch:
        values, numbers = np.concatenate(grams), np.concatenate(of)
        order = np.argsort(values)
        held = values[order]
        starts = np.append(np.flatnonzero(np.r_[True, held[1:] != held[:-1]]), len(held))
        total = np.empty(len(held), np.uint32)
        total[order] = np.repeat(np.diff(starts), np.diff(starts))
        back: dict[int, list[np.ndarray]] = {}
        place = 0
        for block, cell in zip(blocks, grams, strict=True):
            own = slice(place, place + len(cell))
            place += len(cell)
            hit = np.flatnonzero((total[own] > 1) & (numbers[own] != _LONE)) + own.start
            if len(hit):
                back.setdefault(block, []).append(hit)
        out = []
        for block, parts in back.items():
            hit = np.concatenate(parts)
            out.append((block, 0, numbers[hit].tobytes(), values[hit].tobytes() if counted else b"", total[hit].tobytes() if counted else b""))
        return _rows(schema, out)

    for batch in batches:
        docs = batch.filter(pc.equal(batch.column("kind"), 1))
        if docs.num_rows:
            yield pa.RecordBatch.from_arrays([docs.column("block"), docs.column("kind"), docs.column("a"), docs.column("b"), pa.array([b""] * docs.num_rows, pa.binary())], list(schema))
        cells = batch.filter(pc.equal(batch.column("kind"), 0))
        numbers, of_block, a, b = cells.column("bucket").to_pylist(), cells.column("block").to_pylist(), cells.column("a"), cells.column("b")
        for i, bucket in enumerate(numbers):
            if bucket != at and blocks:
                yield summed()
                blocks, grams, of = [], [], []
            at = bucket
            blocks.append(of_block[i])
            grams.append(np.frombuffer(a[i].as_py(), np.uint64))
            of.append(np.frombuffer(b[i].as_py(), np.uint32))
    if blocks:
        yield summed()


def _summed(rows: DataFrame, size: int, n_bytes: int, counted: bool) -> DataFrame:
    """The cells of rows (doc_id, text, text_hash) summed by hash block, for cells of about n_bytes."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_buckets = n * -(-n_bytes // (n * BUCKET_BYTES)) if n_bytes > n * BUCKET_BYTES else n
    cells = _cells(rows, size, n_buckets, not counted)
    return cells.repartitionById(n, F.col("bucket") % n).sortWithinPartitions("bucket").mapInArrow(partial(_sums, counted=counted), SUM_SCHEMA)


def _of_block(cells: pa.Table) -> tuple[np.ndarray, np.ndarray, list[tuple[bytes, bytes, bytes]]]:
    """A block's documents, the hashes of their sets, and what the hash blocks have sent back."""
    known, digests, back = np.zeros((0, KNOWN), np.int64), np.zeros((0, 2), np.int64), []
    for kind, a, b, c in zip(*(cells[x].to_pylist() for x in ("kind", "a", "b", "c")), strict=True):
        if kind == 1:
            known, digests = np.frombuffer(a, np.int64).reshape(-1, KNOWN), np.frombuffer(b, "<i8").reshape(-1, 2)
        else:
            back.append((a, b, c))
    return known, digests, back


def _texts(docs: DataFrame) -> DataFrame:
    return text_frame(docs).withColumn("text_hash", F.xxhash64("text"))


def _measured(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, hi, lo, maybe) for each row: its set's size and hash, and whether enough of it occurs elsewhere for a link to another set."""
    rows = _texts(docs)
    # a cell has 12 bytes for each n-gram, a word with its space about 6
    n_bytes = 2 * (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)

    def measure(cells: pa.Table) -> pa.Table:
        known, digests, back = _of_block(cells)
        counts = known[:, 4].copy()
        for a, _, _ in back:
            counts += np.bincount(np.frombuffer(a, np.uint32), minlength=len(counts))
        n, counts = known[:, 2], counts[known[:, 3]]
        return pa.table(
            {
                "doc_id": pa.array(known[:, 0], pa.int64(), mask=known[:, 1] == 0),
                "text_hash": known[:, 5],
                "n_shingles": n,
                "hi": digests[:, 0],
                "lo": digests[:, 1],
                "maybe": (n > 0) & (100 * counts >= percent * n),
            }
        )

    return _summed(rows, size, n_bytes, False).groupBy("block").applyInArrow(measure, "doc_id long, text_hash long, n_shingles long, hi long, lo long, maybe boolean")


def _needed(percent: int, n: Column) -> Column:
    """Shingles that a set of n shares with any partner, at least."""
    return F.ceil(n * percent / 100)


def _enough(percent: int, overlap: Column, n: Column, m: Column) -> Column:
    """Whether sets of n and m that share so many link: 100 * overlap >= percent * (n + m - overlap)."""
    return (100 + percent) * overlap >= percent * (n + m)


def _candidate_sets(docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """(cid, n, grams): one set for each class that may link, its n-grams that another such class has, rare ones first.

    Equal sets have vouched for each other so far; summed again among one document of each class, most of those go too."""
    total = classes.agg(F.count("*"), F.sum("n"), F.max("rows")).first()
    n_classes, n_grams, most_rows = total[0], total[1] or 0, total[2] or 0
    keys = classes.select("hi", "lo", "doc_id", "cid")
    keys = F.broadcast(keys) if n_classes <= MAX_BROADCAST_IDS else keys
    rows = _texts(docs).join(keys.select("doc_id").distinct() if n_classes > MAX_BROADCAST_IDS else keys.select("doc_id"), "doc_id", "left_semi")

    def sets(cells: pa.Table) -> pa.Table:
        known, digests, back = _of_block(cells)
        of = np.concatenate([np.frombuffer(a, np.uint32) for a, _, _ in back] or [np.zeros(0, np.uint32)])
        grams = np.concatenate([np.frombuffer(b, np.int64) for _, b, _ in back] or [np.zeros(0, np.int64)])
        often = np.concatenate([np.frombuffer(c, np.uint32) for _, _, c in back] or [np.zeros(0, np.uint32)])
        counts = np.bincount(of, minlength=len(known))
        keep = (counts > 0) & (100 * counts >= percent * known[:, 2]) & (known[:, 1] > 0)
        held = keep[of]
        of, grams, often = of[held], grams[held], often[held]
        order = np.lexsort((grams, often, of))
        offsets = np.append(0, np.cumsum(counts[keep])).astype(np.int32)
        return pa.table({"doc_id": known[keep, 0], "hi": digests[keep, 0], "lo": digests[keep, 1], "n": known[keep, 2], "grams": pa.ListArray.from_arrays(offsets, grams[order])})

    found = _summed(rows, size, 12 * n_grams, True).groupBy("block").applyInArrow(sets, "doc_id long, hi long, lo long, n long, grams array<long>")
    # another row of the same doc_id may have another set; a repeated one may come twice
    found = found.join(keys, ["hi", "lo", "doc_id"])
    found = found.dropDuplicates(["cid"]) if most_rows > 1 else found
    return found.select("cid", "n", "grams")


def _classes(measured: DataFrame) -> DataFrame:
    """(hi, lo, doc_id, n, rows, cid) of the sets that may link: the smallest document that has one, and a number for it: that document's, or where several sets have the same one, the hash of all but the first."""
    each = measured.where("maybe and doc_id is not null").groupBy("hi", "lo", "doc_id").agg(F.first("n_shingles").alias("n"), F.count("*").alias("rows"))
    first = each.groupBy("hi", "lo").agg(F.min_by(F.struct("doc_id", "n", "rows"), "doc_id").alias("x")).select("hi", "lo", "x.*")
    again = F.row_number().over(Window.partitionBy("doc_id").orderBy("hi", "lo")) > 1
    return first.withColumn("cid", F.when(again, F.col("hi")).otherwise(F.col("doc_id")))


def _meeting_points(sets: DataFrame, percent: int) -> DataFrame:
    """(gram, band, cid, n, rest): the n-grams at which a class meets its partners, and how many of its n-grams, that one included, are left from there on."""
    n = F.col("n")
    each = sets.select("cid", "n", F.size("grams").alias("k"), F.posexplode("grams").alias("i", "gram"))
    at = n - F.col("k") + F.col("i")  # n-grams of its own come first
    band = F.floor(F.log(n.cast("double")) / F.log(F.lit(100 / percent) + 1e-9)).cast("int")
    return each.where(at <= n - _needed(percent, n)).select("gram", band.alias("band"), "cid", "n", (n - at).alias("rest"))


def _blocks_of(sets: DataFrame, percent: int) -> DataFrame:
    """(cid, n, level, block, grams): sets cut in 2^level blocks of n-grams, for the levels from their own size to the largest partner's. Nearly all sets are one block at level 0."""

    def level(n: Column) -> Column:
        return F.greatest(F.lit(0), F.ceil(F.log2(n.cast("double") / SET_BLOCK)).cast("int"))

    n = F.col("n")
    cut = sets.select("cid", "n", "grams", F.explode(F.sequence(level(n), level(n * 100 / percent))).alias("level"))
    blocks = F.expr("if(level = 0, array(struct(0 as block, grams as grams)), transform(sequence(0, cast(shiftleft(1, level) as int) - 1), b -> struct(b as block, filter(grams, g -> (g & (shiftleft(1, level) - 1)) = b) as grams)))")
    return cut.select("cid", "n", "level", F.explode(blocks).alias("x")).select("cid", "n", "level", "x.block", "x.grams")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link. Pairs whose signatures rule a link out go first; the others' overlap counts are accumulated block by block, and held against the sizes."""
    signed = _signatures(sets)
    ends = [signed.select(*(F.col(c).alias(f"{c}_{x}") for c in signed.columns)) for x in "ab"]
    alike = pairs.join(ends[0], F.col("a") == F.col("cid_a")).join(ends[1], F.col("b") == F.col("cid_b")).where(_alike(percent, "{}_a", "{}_b")).select("a", "b", F.greatest("level_a", "level_b").alias("level"))
    blocks = _blocks_of(sets, percent)
    a, b = (blocks.select(F.col("cid").alias(x), "level", "block", F.col("n").alias(f"n_{x}"), F.col("grams").alias(f"grams_{x}")) for x in "ab")
    counted = alike.join(a, ["a", "level"]).join(b, ["b", "level", "block"]).select("a", "b", "n_a", "n_b", F.size(F.array_intersect("grams_a", "grams_b")).alias("overlap"))
    return counted.groupBy("a", "b", "n_a", "n_b").agg(F.sum("overlap").alias("overlap")).where(_enough(percent, F.col("overlap"), F.col("n_a"), F.col("n_b"))).select("a", "b")


def _possible(percent: int, left: str, right: str) -> Column:
    """Whether what is left from the meeting point on suffices."""
    return _enough(percent, F.least(f"{left}.rest", f"{right}.rest"), F.col(f"{left}.n"), F.col(f"{right}.n"))


def _signatures(sets: DataFrame) -> DataFrame:
    """(cid, n, k, level, s0, ...): the number of a class's n-grams and, of the n-grams at each bit, whether they are odd in number."""
    bits = [F.expr(f"aggregate(filter(grams, g -> g & {WORDS - 1} = {w}), 0L, (s, g) -> s ^ shiftleft(1L, cast(shiftrightunsigned(g, 32) & 63 as int)))").alias(f"s{w}") for w in range(WORDS)]
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n").cast("double") / SET_BLOCK)).cast("int"))
    return sets.select("cid", "n", F.size("grams").alias("k"), level.alias("level"), *bits)


def _alike(percent: int, left: str, right: str) -> Column:
    """Whether signatures allow a link: an n-gram that only one of two sets has turns one bit, so sets differ in as many n-grams as bits, at least. left, right: how a side's columns are named."""
    differ = sum((F.bit_count(F.col(left.format(f"s{w}")).bitwiseXOR(F.col(right.format(f"s{w}")))) for w in range(1, WORDS)), F.bit_count(F.col(left.format("s0")).bitwiseXOR(F.col(right.format("s0")))))
    return _enough(percent, (F.col(left.format("k")) + F.col(right.format("k")) - differ) / 2, F.col(left.format("n")), F.col(right.format("n")))


def link_classes(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, component) of the classes with links."""
    points = materialize(_meeting_points(sets, percent), "meeting-points")
    # a linear number of pairs: everyone meets the smallest of its n-gram and band, and of the band below
    hubs = points.groupBy("gram", "band").agg(F.min(F.struct("cid", "n", "rest")).alias("hub")).select("gram", "band", "hub.*")
    near = hubs.unionByName(hubs.withColumn("band", F.col("band") + 1)).alias("h")
    hub_pairs = points.alias("p").join(near, ["gram", "band"]).where(F.col("p.cid") != F.col("h.cid")).where(_possible(percent, "p", "h"))
    first = hub_pairs.select(F.least("p.cid", "h.cid").alias("a"), F.greatest("p.cid", "h.cid").alias("b")).distinct()
    links = materialize(_verified(first, sets, percent), "links")
    parts = materialize(connected_components(links), "components")

    # what is left: pairs in different components, one side outside the n-gram's largest component
    placed = points.join(parts, points.cid == parts.node, "left").select("gram", "band", "cid", "n", "rest", F.coalesce("component", "cid").alias("part"))
    sizes = placed.groupBy("gram", "part").agg(F.count("*").alias("m")).groupBy("gram").agg(F.max_by("part", F.struct("m", "part")).alias("major"), F.sum("m").alias("m"), F.count("*").alias("parts")).where("parts > 1")
    placed = materialize(placed.join(sizes, "gram").withColumn("chunks", F.ceil(F.col("m") / CHUNK).cast("int")).join(_signatures(sets).drop("n", "level"), "cid"), "placed")
    left = placed.where("part != major").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))).alias("l")
    right = placed.withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int")).alias("r")
    different = (F.col("l.part") != F.col("r.part")) & ((F.col("r.part") == F.col("r.major")) | (F.col("l.cid") < F.col("r.cid")))
    rest = left.join(right, (F.col("l.gram") == F.col("r.gram")) & (F.col("l.band") == F.col("r.band")) & (F.col("l.chunk") == F.col("r.chunk")) & different & _possible(percent, "l", "r") & _alike(percent, "l.{}", "r.{}"))
    second = rest.select(F.least("l.cid", "r.cid").alias("a"), F.greatest("l.cid", "r.cid").alias("b")).distinct()
    more = materialize(_verified(second, sets, percent), "links")
    stars = parts.select(F.col("component").alias("a"), F.col("node").alias("b"))
    return connected_components(stars.unionByName(more)) if not more.isEmpty() else parts


def jaccard_components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs."""
    return _components(docs, size, percent).drop("text_hash")


def _components(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id) for each row of docs."""
    measured = materialize(_measured(docs, size, percent), "measured")
    classes = materialize(_classes(measured), "classes")
    parts = link_classes(materialize(_candidate_sets(docs, classes, size, percent), "sets"), percent)
    # equal sets are one class; the smallest document of all linked classes stands for them
    linked = parts.join(classes.select("hi", "lo", "doc_id", "cid"), F.col("cid") == F.col("node"))
    least = linked.groupBy("component").agg(F.min("doc_id").alias("least"))
    linked = linked.join(least, "component").select("hi", "lo", "least")
    full = measured.where("n_shingles > 0")
    own = full.groupBy("hi", "lo").agg(F.min("doc_id").alias("own")).join(linked, ["hi", "lo"], "left").select("hi", "lo", F.coalesce("least", "own").alias("component_id"))
    full = full.join(own, ["hi", "lo"]).select("doc_id", "text_hash", "n_shingles", "component_id")
    return full.unionByName(measured.where("n_shingles = 0").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id")))


def one_of_each_group(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, with all columns, whose doc_id is the smallest of their text's component. Rows without doc_id stay."""
    others = _components(docs, size, percent).where("doc_id <> component_id").select(F.col("doc_id").alias("other_id"), F.col("text_hash").alias("other_text")).distinct()
    keys = F.struct(F.col("doc_id").cast("long").alias("other_id"), F.xxhash64(F.col("text").cast("string")).alias("other_text"))
    return docs.join(others, keys == F.struct(others.other_id, others.other_text), "left_anti")
