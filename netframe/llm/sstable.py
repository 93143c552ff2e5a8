"""Token ids in sorted-string-table shards.

A shard holds documents in ascending order of their identifier. Its layout, little-endian:

    blocks   entries: shared key bytes, other key bytes, value bytes (varints), the other key bytes, the value; then crc32
    index    for each block: first key with its length, offset, length
    Bloom    bits over the keys
    footer   offsets and lengths of index and Bloom filter, entries, ids, width of an id, hash functions, magic

Keys are identifiers as 8 big-endian bytes with the sign turned, so that bytes sort as numbers; a null identifier is the
empty key and comes first. A block's keys share prefixes with the key before. Values are the ids, in 2 bytes each where the
vocabulary allows it. A reader finds a document by the Bloom filter, a binary search of the index and one block.

Shards are written by the tasks of a range partitioning on (doc_id, hash of text): rows that share an identifier are spread
as well. Names come from the partition, and a file is renamed only when whole, so a task that runs again does no harm.

Defined cases: null text is the empty text and has the end id alone. Rows that share an identifier are kept, next to each
other, in the order of the text's hash. An empty table makes no shard. A text of any length is encoded whole and is one entry of a block.
"""

from __future__ import annotations

import bisect
import itertools
import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import partial
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import public_tokenizers
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netframe.llm.common import materialize, of_worker, shared_path, text_frame

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
BLOCK_BYTES = 64 << 10
BLOOM_BITS, BLOOM_HASHES = 10, 7
MAGIC = b"NFSSTAB1"
_FOOTER = struct.Struct("<QQQQQQBB6x8s")


def encode_key(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else ((doc_id + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big")


def decode_key(key: bytes) -> int | None:
    return int.from_bytes(key, "big") - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = data[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


class BloomFilter:
    def __init__(self, bits: np.ndarray, hashes: int):
        self.bits, self.hashes = bits, hashes

    @classmethod
    def of(cls, keys: list[bytes]) -> BloomFilter:
        n = max(64, len(keys) * BLOOM_BITS + 7 & ~7)
        made = cls(np.zeros(n // 8, np.uint8), BLOOM_HASHES)
        for key in keys:
            for p in made._places(key):
                made.bits[p >> 3] |= 1 << (p & 7)
        return made

    def _places(self, key: bytes) -> Iterator[int]:
        h = xxhash.xxh3_64_intdigest(key)
        a, b, n = h & 0xFFFFFFFF, h >> 32 | 1, len(self.bits) * 8
        return ((a + i * b) % n for i in range(self.hashes))

    def __contains__(self, key: bytes) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in self._places(key))


class ShardWriter:
    """Appends documents in order; only one block, the index and the keys are in memory."""

    def __init__(self, out: BinaryIO, width: int):
        self.out, self.width, self.dtype = out, width, "<u2" if width == 2 else "<u4"
        self.block, self.first, self.last = bytearray(), b"", b""
        self.index, self.keys, self.at, self.n_entries, self.n_ids = bytearray(), [], 0, 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        key, value = encode_key(doc_id), ids.astype(self.dtype).tobytes()
        if not self.block:
            self.first, self.last, shared = key, b"", 0
        else:
            shared = len(os.path.commonprefix([self.last, key]))
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.n_entries += 1
        self.n_ids += len(ids)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            self.block += struct.pack("<I", zlib.crc32(self.block))
            self.index += _varint(len(self.first)) + self.first + _varint(self.at) + _varint(len(self.block))
            self.out.write(bytes(self.block))
            self.at += len(self.block)
            self.block = bytearray()

    def close(self) -> None:
        self._flush()
        bloom = BloomFilter.of(self.keys)
        self.out.write(bytes(self.index))
        self.out.write(bloom.bits.tobytes())
        self.out.write(_FOOTER.pack(self.at, len(self.index), self.at + len(self.index), len(bloom.bits), self.n_entries, self.n_ids, self.width, bloom.hashes, MAGIC))


class ShardReader:
    """Reads one document or all of them, in order, from a random-access file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        at, n, bloom_at, bloom_n, self.n_entries, self.n_ids, width, hashes, magic = _FOOTER.unpack(source.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        self.dtype = "<u2" if width == 2 else "<u4"
        data, p = source.read_at(n, at), 0
        self.bloom = BloomFilter(np.frombuffer(source.read_at(bloom_n, bloom_at), np.uint8), hashes)
        self.firsts, self.places = [], []
        while p < n:
            k, p = _read_varint(data, p)
            self.firsts.append(data[p : p + k])
            offset, p = _read_varint(data, p + k)
            length, p = _read_varint(data, p)
            self.places.append((offset, length))

    def _entries(self, block: int) -> Iterator[tuple[bytes, np.ndarray]]:
        offset, length = self.places[block]
        data = self.source.read_at(length, offset)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError(f"block {block} is damaged")
        p, key = 0, b""
        while p < length - 4:
            shared, p = _read_varint(data, p)
            rest, p = _read_varint(data, p)
            n, p = _read_varint(data, p)
            key = key[:shared] + data[p : p + rest]
            p += rest
            yield key, np.frombuffer(data[p : p + n], self.dtype).astype(np.uint32)
            p += n

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for block in range(len(self.places)):
            for key, ids in self._entries(block):
                yield decode_key(key), ids

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of all rows with this identifier."""
        key, found = encode_key(doc_id), []
        if key not in self.bloom:
            return found
        block = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while block < len(self.places) and self.firsts[block] <= key:
            found += [ids for k, ids in self._entries(block) if k == key]
            block += 1
        return found


# -- tokens ---------------------------------------------------------------------------------------------------------

#: Characters for which lower-casing and splitting here are those of the tokenizer (checked one by one in the tests); a text with any other goes to the tokenizer whole.
_OTHER = re.compile(r"[^\x00-\x1b -įı-ſ‐-‧€]")
_LETTERS, _NUMBERS = ("".join(chr(c) for c in range(0x180) if unicodedata.category(chr(c))[0] == kind) for kind in "LN")
_PIECE = re.compile(rf"[{_LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")
_ASCII_PIECE = re.compile(r"[a-z]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\sa-z0-9]+")
#: Pieces whose ids a worker remembers in each of two generations: what occurs again moves to the younger one.
MAX_REMEMBERED = 400_000
#: A vocabulary shows by this text that _PIECE is its way to split and that each piece ends with such a token; with any other, texts go to the tokenizer whole.
END_OF_PIECE = "</w>"
_PROBE = "It's 42 naïve--RE-d I'LL\t'tis x2y «Œuvre»"


class WordTokenizer:
    """The tokenizer's ids. It tokenizes piece by piece, without regard to neighbours, so each piece of a text is encoded once and remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        # a text with an added token's string goes to the tokenizer whole, as _PIECE would split it
        added = sorted({t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()} - {""})
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)")
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)  # tokens that end a piece
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(END_OF_PIECE)]] = True
        self.by_piece = self._splits_alike()
        self.remembered: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _splits_alike(self) -> bool:
        """Whether the tokenizer lower-cases and splits as is done here."""
        splitter, normal = self.tokenizer.pre_tokenizer, self.tokenizer.normalizer
        made, pieces = self.tokenizer.encode(_PROBE, add_special_tokens=False), self._pieces(_PROBE)
        own = [i for p in pieces for i in self.tokenizer.encode(p, add_special_tokens=False).ids]
        return splitter is not None and normal is not None and normal.normalize_str("ÀB") == "àb" and made.ids == own and len(set(made.word_ids)) == len(pieces) == int(self.ends[made.ids].sum())

    @staticmethod
    def _pieces(text: str) -> list[str]:
        return _ASCII_PIECE.findall(text.lower()) if text.isascii() else _PIECE.findall(unicodedata.normalize("NFC", text).lower())

    def _learn(self, new: set[str]) -> None:
        """Takes pieces from the older generation; those of none are encoded as one text, apart."""
        older = self.older
        made = {p: older[p] for p in new if p in older}
        if new := list(new.difference(made)):
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, np.uint32)
            raw, cuts = ids.tobytes(), [0, *((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()]
            made.update(zip(new, [raw[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)], strict=True))
        self.remembered.update(made)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        whole = [i for i, t in enumerate(texts) if not self.by_piece or _OTHER.search(t) or self.added.search(t.lower())]
        if whole:
            for i, e in zip(whole, self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, np.uint32)
        split = {i: self._pieces(t) for i, t in enumerate(texts) if out[i] is None}
        if len(self.remembered) > MAX_REMEMBERED:
            self.older, self.remembered = self.remembered, {}
        if new := set().union(*split.values()).difference(self.remembered):
            self._learn(new)
        look = self.remembered.__getitem__
        for i, pieces in split.items():
            out[i] = np.frombuffer(b"".join(map(look, pieces)), np.uint32)
        return out


def write_shards(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes the shards under path and returns (shard, file, n_entries, n_ids), a row for each."""
    vocabulary = tokenizer or public_tokenizers.path(VOCABULARY)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        coder = of_worker(("sstable", vocabulary), partial(WordTokenizer, vocabulary))
        shard = TaskContext.get().partitionId()
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        name = f"{root}/shard-{shard:06d}.sst"
        own = f"{name}.{TaskContext.get().taskAttemptId()}"
        with store.open_output_stream(own) as out:
            writer = ShardWriter(out, coder.width)
            end = np.array([end_id], np.uint32)
            for batch in itertools.chain([first], batches):
                _add(writer, coder, batch, end)
            writer.close()
        store.move(own, name)
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([name]), pa.array([writer.n_entries], pa.int64()), pa.array([writer.n_ids], pa.int64())], ["shard", "file", "n_entries", "n_ids"])

    rows = text_frame(docs).withColumn("part", F.xxhash64("text"))
    ranged = rows.repartitionByRange("doc_id", "part").sortWithinPartitions("doc_id", "part")
    return materialize(ranged.mapInArrow(write, "shard int, file string, n_entries long, n_ids long"), "shards")


def _add(writer: ShardWriter, coder: WordTokenizer, batch: pa.RecordBatch, end: np.ndarray, step: int = 256) -> None:
    ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
    for i in range(0, len(ids), step):
        for doc_id, own in zip(ids[i : i + step], coder.encode_batch([x or "" for x in texts[i : i + step].to_pylist()]), strict=True):
            writer.add(doc_id, np.concatenate([own, end]))


def read_shards(shards: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, and with_ids: ids) from the files; start counts the ids of all documents before."""
    starts, at = {}, 0
    for row in shards.select("shard", "n_ids").orderBy("shard").collect():  # a row for each file
        starts[row.shard], at = at, at + row.n_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(path)
        for batch in batches:
            for shard, name in zip(batch.column("shard").to_pylist(), batch.column("file").to_pylist(), strict=True):
                with store.open_input_file(name) as source:
                    at, rows = starts[shard], ([], [], [], [], [])
                    for doc_id, ids in ShardReader(source):
                        for held, x in zip(rows, (doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids.astype(np.int32) if with_ids else None), strict=True):
                            held.append(x)
                        at += len(ids)
                        if len(rows[0]) >= 4096:
                            yield _rows(rows, with_ids)
                            rows = ([], [], [], [], [])
                    yield _rows(rows, with_ids)

    n = max(1, min(len(starts), 4096))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return shards.select("shard", "file").repartition(n).mapInArrow(read, schema)


def _rows(rows: tuple, with_ids: bool) -> pa.RecordBatch:
    out = [pa.array(x, pa.int64()) for x in rows[:4]]
    return pa.RecordBatch.from_arrays([*out, *([pa.array(rows[4], pa.list_(pa.int32()))] if with_ids else [])], ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)


def tokenize_to_shards(docs: DataFrame, path: str | None = None, with_ids: bool = False, tokenizer: str | None = None) -> DataFrame:
    """Writes the shards and reads them back."""
    path = path or shared_path(docs.sparkSession, "sstable")
    return read_shards(write_shards(docs, path, tokenizer), path, with_ids)
