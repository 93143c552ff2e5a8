"""Byte-level BPE by two-tier lookup: a minimal perfect hash resolves whole pre-tokens that are in the vocabulary; the
others are merged with a heap over a linked list of their bytes.

Encoding gives the ids that the ranks define (lowest rank first, leftmost first among equals); decoding gives the bytes back.

Defined cases: null text is the empty text and has no ids. Other columns and repeated rows are left as they are. Texts of any length are encoded
whole; an empty table has an empty result. Some characters that were unassigned before Unicode 16 are letters or digits for the regex module but not yet for
the tiktoken library; beside them words may be cut elsewhere than there.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import xxhash
from pyspark.sql import DataFrame

from netframe.llm.common import Remembered, of_worker, sliced, text_frame

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pre-tokens whose ids a worker remembers, in bytes.
REMEMBERED_BYTES = 96 << 20


def load_ranks(path: str) -> list[bytes]:
    """Tokens by rank."""
    with open(path, "rb") as lines:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, lines)}
    return [ranks[i] for i in range(len(ranks))]


class PerfectHash:
    """A minimal perfect hash of byte strings: a first hash picks a bucket, the bucket's seed picks a place that no other key has. n keys have the places 0 to n - 1. A bucket with one key names its place instead, as -1 - place."""

    PER_BUCKET = 4

    def __init__(self, keys: list[bytes]):
        self.n = len(keys)
        self.n_buckets = max(1, self.n // self.PER_BUCKET)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, self.n)
        buckets: list[list[int]] = [[] for _ in range(self.n_buckets)]
        for i, b in enumerate((hashes % np.uint64(self.n_buckets)).tolist()):
            buckets[b].append(i)
        self.seeds, self.index = [0] * self.n_buckets, [-1] * self.n
        ints = hashes.tolist()
        for b in sorted(range(self.n_buckets), key=lambda b: -len(buckets[b])):
            if len(buckets[b]) < 2:
                continue
            seed = 0
            while True:
                places = [self._place(ints[i], seed) for i in buckets[b]]
                if len(set(places)) == len(places) and all(self.index[p] < 0 for p in places):
                    break
                seed += 1
            self.seeds[b] = seed
            for i in buckets[b]:
                self.index[self._place(ints[i], seed)] = i
        free = iter([p for p, i in enumerate(self.index) if i < 0])
        for b, own in enumerate(buckets):
            if len(own) == 1:
                self.seeds[b] = -1 - (p := next(free))
                self.index[p] = own[0]

    def _place(self, h: int, seed: int) -> int:
        if seed < 0:
            return -1 - seed
        x = (h ^ (seed * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
        x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF
        return (x ^ (x >> 32)) % self.n

    def candidate(self, key: bytes) -> int:
        """The number of the only key that may equal this one."""
        h = xxhash.xxh3_64_intdigest(key)
        return self.index[self._place(h, self.seeds[h % self.n_buckets])]


class ByteBPE:
    """Encoder and decoder of one vocabulary; small enough to be broadcast (its size is the vocabulary's)."""

    def __init__(self, tokens: list[bytes], pattern: str = public_tokenizers.PATTERN):
        self.tokens, self.pattern, self.hash = tokens, pattern, PerfectHash(tokens)
        self.ranks = {t: i for i, t in enumerate(tokens)}

    def rank(self, piece: bytes) -> int | None:
        """The id of a whole piece, if the vocabulary has it."""
        i = self.hash.candidate(piece)
        return i if self.tokens[i] == piece else None

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a piece that isn't in the vocabulary as a whole. The ranks of its parts come from a plain table."""
        n, rank = len(piece), self.ranks.get
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or (j := after[i]) >= n or end[j] != stop:
                continue  # one of the two has changed since
            end[i], after[i], alive[j] = stop, after[j], False
            if after[i] < n:
                before[after[i]] = i
                if (r := rank(piece[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if (k := before[i]) >= 0 and (r := rank(piece[k:stop])) is not None:
                heapq.heappush(heap, (r, k, stop))
        return [rank(piece[i : end[i]]) for i in range(n) if alive[i]]

    def piece_ids(self, piece: str) -> list[int]:
        raw = piece.encode()
        found = self.rank(raw)
        return self.merge(raw) if found is None else [found]


class _Worker:
    """The broadcast coder, its compiled pattern and the ids of pre-tokens, remembered as little-endian 32-bit integers."""

    def __init__(self, bpe: ByteBPE):
        packed = [i.to_bytes(4, "little") for i in range(len(bpe.tokens))]
        self.pattern = regex.compile(bpe.pattern)
        self.remembered = Remembered(lambda piece: b"".join([packed[i] for i in bpe.piece_ids(piece)]), REMEMBERED_BYTES)


def load(path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> ByteBPE:
    return ByteBPE(load_ranks(path or public_tokenizers.path(VOCABULARY)), pattern)


def encode_decode(docs: DataFrame, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, and with_ids: ids and decoded text) for each row. decoded comes from the ids alone."""
    shared = docs.sparkSession.sparkContext.broadcast(load(path))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared.value
        worker = of_worker(bpe, partial(_Worker, bpe))
        find, look, tokens = worker.pattern.findall, worker.remembered.__getitem__, bpe.tokens
        for batch in sliced(batches):
            n, sums, back, all_ids, texts = [], [], [], [], []
            for text in batch.column("text"):
                ids = b"".join(map(look, find(text.as_py() or "")))
                numbers = np.frombuffer(ids, "<u4")
                decoded = b"".join(map(tokens.__getitem__, numbers.tolist()))
                n.append(len(numbers))
                sums.append(hashlib.sha256(ids).hexdigest())
                back.append(hashlib.sha256(decoded).hexdigest())
                if with_ids:
                    all_ids.append(numbers.astype(np.int32))
                    texts.append(decoded)
            out = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(sums, pa.string()), pa.array(back, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                out += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(texts, pa.binary()).cast(pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(out, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return text_frame(docs).mapInArrow(encode, schema)
