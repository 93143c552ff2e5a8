"""Token counts by a linear longest-match automaton: greedy word-piece lengths without building the pieces.

The vocabulary is a trie. Each node has a failure link: where matching goes on after the longest pieces of the node's text
are popped. How many pieces that pops is computed beforehand, so a word is counted in one pass over its characters.

The vocabulary's word starts carry MARK; all other pieces continue a word. Words are what ASCII white space separates. A
word that can't be cut into pieces counts as one unknown token.

Defined cases: null and empty texts have no words and no tokens. A word that holds MARK itself is unknown. Every row has a
result; repeated rows have equal ones, an empty table has none. Texts of any length are counted whole, in time linear in their words.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame

from netframe.llm.common import Remembered, of_worker, raw_texts, sliced, text_frame

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
#: Words whose lengths a worker remembers, in bytes.
REMEMBERED_BYTES = 64 << 20


def load_pieces(path: str) -> list[str]:
    """Pieces of text; control, unknown and byte pieces are left out."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


class Automaton:
    """Trie of the pieces with failure links; as large as the vocabulary, so it is broadcast."""

    NONE = -1

    def __init__(self, pieces: list[str]):
        self.edges: list[dict[str, int]] = [{}]
        ends = [False]
        for piece in pieces:
            at = 0
            for c in piece:
                nxt = self.edges[at].get(c)
                if nxt is None:
                    nxt = self.edges[at][c] = len(self.edges)
                    self.edges.append({})
                    ends.append(False)
                at = nxt
            ends[at] = True
        self.fail, self.popped = [self.NONE] * len(self.edges), [0] * len(self.edges)
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for c, v in self.edges[u].items():
                if ends[v]:
                    self.fail[v], self.popped[v] = 0, 1
                else:
                    z, n = self.fail[u], self.popped[u]
                    while z != self.NONE and c not in self.edges[z]:
                        n += self.popped[z]
                        z = self.fail[z]
                    if z != self.NONE:
                        self.fail[v], self.popped[v] = self.edges[z][c], n
                queue.append(v)

    def count(self, word: str) -> int | None:
        """Pieces of a word that starts with MARK; None if it has no cut."""
        edges, fail, popped = self.edges, self.fail, self.popped
        at = n = 0
        for c in word:
            while (nxt := edges[at].get(c)) is None:
                n += popped[at]
                if (at := fail[at]) < 0:
                    return None
            at = nxt
        while at:
            n += popped[at]
            if (at := fail[at]) < 0:
                return None
        return n


_UNKNOWN = 1 << 40


def _pieces_of(automaton: Automaton, raw: bytes) -> int:
    """Number of pieces of a word; an unknown word is one, and _UNKNOWN beside it."""
    word = raw.decode("utf-8", "replace")
    n = None if MARK in word else automaton.count(MARK + word)
    return 1 + _UNKNOWN if n is None else n


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(load_pieces(path or public_tokenizers.path(VOCABULARY))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        look = of_worker(automaton, partial(Remembered, partial(_pieces_of, automaton), REMEMBERED_BYTES)).__getitem__
        for batch in sliced(batches):
            n_words, sums = [], []
            for raw in raw_texts(batch):
                words = raw.split()
                n_words.append(len(words))
                sums.append(sum(map(look, words)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array([x % _UNKNOWN for x in sums], pa.int64()), pa.array([x // _UNKNOWN for x in sums], pa.int64())], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return text_frame(docs).mapInArrow(count, "doc_id long, n_words long, n_tokens long, n_unknown long")
