"""Benchmark decontamination: an Aho-Corasick automaton over all windows of the normalised test texts scans each normalised
document once; hits are mapped back to code points of the original.

Words are runs of letters and digits (ASCII, A-Z lower-cased) and of all characters beyond ASCII. A window is window
consecutive words of an item; a shorter item, unless it has no words, is one window. For the automaton a word is three letters, the
digits of its number among the benchmark's words, each place with its own alphabet: nodes have few branches, and no match starts
within a word. A document's word that no item has ends every match, so only runs of known words as long as the shortest window
are scanned.

Automata are built by tasks and stored in the shared folder: one, or where the benchmark has more than max_block_bytes of
text, one for each hash block of items of about that size. The corpus is read once either way: a task holds a batch of documents
against one automaton after the other, and has one of them in memory at a time.

Defined cases: null and empty texts have no words and no hits. Items without words never occur. Rows of an item_id that
repeats count as one item; null item_ids are left out of n_items. Without items nothing is contaminated. Long texts are scanned whole.
Repeated rows have equal results. An empty table of documents has an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator
from functools import partial

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netframe.llm.common import loaded, of_worker, raw_texts, shared_path, sliced, stored, text_frame

WINDOW = 10
#: Benchmark text for one automaton.
MAX_BLOCK_BYTES = 1 << 19

_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
#: Lower-cases A-Z and makes a space of all that isn't in a word, byte by byte.
_NORMAL = bytes(x + 32 if 65 <= x <= 90 else x if x >= 128 or 48 <= x <= 57 or 97 <= x <= 122 else 32 for x in range(256))
_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_NORMAL).split()


def windows_of(words: list[bytes], window: int) -> list[list[bytes]]:
    if not words:
        return []
    return [words[i : i + window] for i in range(max(1, len(words) - window + 1))]


#: Letters of a word, and of each place's alphabet; what stands for a word that no item has.
PLACES, ALPHABET, FIRST_LETTER, NO_WORD = 3, 128, 0x4000, "\x01"


def spelled(number: int) -> str:
    """A word's letters, by its number. 128 ** 3 words are more than a block of MAX_BLOCK_BYTES can have."""
    return "".join(chr(FIRST_LETTER + k * ALPHABET + number // ALPHABET**k % ALPHABET) for k in range(PLACES))


class WindowAutomaton:
    """Finds windows in sequences of words; a match gives its number of words and the items that have it."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.letters: dict[bytes, str] = {}
        held: dict[str, set[str | None]] = {}
        for item_id, raw in items:
            for part in windows_of(words_of(raw), window):
                held.setdefault("".join([self.letters.setdefault(w, spelled(len(self.letters))) for w in part]), set()).add(item_id)
        self.run = re.compile(f"[^{NO_WORD}]{{{min(map(len, held), default=PLACES)},}}")
        self.automaton = ahocorasick.Automaton()
        for key, ids in held.items():
            self.automaton.add_word(key, (len(key) // PLACES, tuple(sorted(ids, key=str))))
        if held:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes], hit: set[int], items: set[str]) -> None:
        """Adds the numbers of the words that are hit and the items found."""
        if not self.letters or not words:
            return
        spelt, at, passed = "".join(map(self.letters.get, words, itertools.repeat(NO_WORD))), 0, 0
        for run in self.run.finditer(spelt):
            # words before the run: one letter for each without a number, PLACES for the others
            passed += spelt.count(NO_WORD, at, run.start())
            at = run.start()
            first = passed + (at - passed) // PLACES
            for end, (n, ids) in self.automaton.iter(run[0]):
                last = first + end // PLACES
                hit.update(range(last - n + 1, last + 1))
                items.update(ids)


#: Words of an item that one row has; a longer item is several rows that overlap by window - 1 words.
PART_WORDS = 1 << 16


def _parts(window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items with words, normalised, in parts that hold all their windows."""
    for batch in sliced(batches):
        rows = [(i, w[k : k + PART_WORDS + window - 1]) for i, w in zip(batch.column("item_id").to_pylist(), map(words_of, raw_texts(batch)), strict=True) if w for k in range(0, max(1, len(w) - window + 1), PART_WORDS)]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.string()), pa.array([b" ".join(w).decode() for _, w in rows], pa.string())], ["item_id", "text"])


def _automata(docs: DataFrame, benchmark: DataFrame, window: int, max_block_bytes: int) -> list[str]:
    """Files of the automata, in the shared folder."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    items = items.mapInArrow(partial(_parts, window), "item_id string, text string").distinct()
    n_blocks = -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // max_block_bytes)
    folder = shared_path(docs.sparkSession, "automata")

    def build(block: pa.Table) -> pa.Table:
        made = WindowAutomaton(list(zip(block["item_id"].to_pylist(), (x.encode() for x in block["text"].to_pylist()), strict=True)), window)
        return pa.table({"place": [stored(folder, str(block["block"][0].as_py()), made)]})

    blocks = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, n_blocks))))
    return sorted(r.place for r in blocks.groupBy("block").applyInArrow(build, "place string").collect())  # a row for each file


Found = list[tuple[int, set[int], set[str]]]


def _scanned(batches: Iterator[pa.RecordBatch], automata: list[str]) -> Iterator[tuple[pa.RecordBatch, Found]]:
    """Each batch with its rows' number of words, hit words and items."""
    for batch in batches if len(automata) > 1 else sliced(batches):  # an automaton that is read again for each batch wants large ones
        words = [words_of(raw) for raw in raw_texts(batch)]
        found: Found = [(len(w), set(), set()) for w in words]
        for name in automata:
            made = of_worker(("automaton", name), partial(loaded, name))
            for own, (_, hit, items) in zip(words, found, strict=True):
                made.scan(own, hit, items)
        for _, _, items in found:
            items.discard(None)
        yield batch, found


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_block_bytes: int = MAX_BLOCK_BYTES) -> DataFrame:
    """The rows of docs, with all columns, in which no window occurs."""
    automata = _automata(docs, benchmark, window, max_block_bytes)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _scanned(batches, automata):
            yield batch.filter(pa.array([not hit for _, hit, _ in found], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_block_bytes: int = MAX_BLOCK_BYTES, with_spans: bool = True) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and with_spans: spans) for each row of docs. spans: start:end of each run of hit words, in code points of the original text."""
    automata = _automata(docs, benchmark, window, max_block_bytes)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _scanned(batches, automata):
            sums = [hashlib.sha256(",".join(sorted(items)).encode()).hexdigest() for _, _, items in found]
            counts = zip(*((n, len(hit), len(items)) for n, hit, items in found), strict=True) if found else ((), (), ())
            out = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(sums, pa.string()), pa.array([bool(hit) for _, hit, _ in found], pa.bool_())]
            names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
            if with_spans:
                out.append(pa.array([_spans(raw, hit) if hit else "" for raw, (_, hit, _) in zip(raw_texts(batch), found, strict=True)], pa.string()))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(out, names)

    return text_frame(docs).mapInArrow(find, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean" + ", spans string" * with_spans)


def _spans(raw: bytes, hit: set[int]) -> str:
    """Where the hit words are in the original text; neighbouring ones are one span."""
    found: list[list[int]] = []
    for k, match in enumerate(_WORD.finditer(raw.translate(_LOWER).decode("utf-8", "replace"))):
        if k in hit:
            if k - 1 in hit:
                found[-1][1] = match.end()
            else:
                found.append([match.start(), match.end()])
    return ",".join(f"{a}:{b}" for a, b in found)
