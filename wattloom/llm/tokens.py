"""Token counts by greedy longest match, in time linear in the text and without building pieces.

The vocabulary is a trie.  Where a match cannot go on, a failure link leads to the node for what is left after
popping the longest pieces from the front, and a number precomputed with the link says how many pieces those
were.  A word's count is the sum of these numbers on its way through the automaton.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from wattloom.llm.wordtext import chunks

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"  # fixed value: how the vocabulary marks pieces that begin a word
KEPT_WORDS = 300_000  # words whose counts a task keeps


class Automaton:
    """``starts``: pieces that begin a word (without mark); ``rests``: pieces that go on.

    Node 0 is before a word's first letter, node 1 between pieces.  ``fail[v]`` is the node reached when no edge of
    ``v`` fits, -1 if the word cannot be matched; ``pops[v]`` is the number of pieces popped on the way.
    With ``by_bytes`` a letter that is no piece between others counts its UTF-8 bytes.
    """

    def __init__(self, starts: Iterable[str], rests: Iterable[str], by_bytes: bool = False):
        self.first, self.by_bytes = 0, by_bytes
        self.edges: list[dict[str, int]] = [{}, {}]
        whole = [False, False]
        for root, pieces in ((0, starts), (1, rests)):
            for piece in pieces:
                at = root
                for letter in piece:
                    if letter not in self.edges[at]:
                        self.edges[at][letter] = len(self.edges)
                        self.edges.append({})
                        whole.append(False)
                    at = self.edges[at][letter]
                whole[at] = whole[at] or at > 1
        weight = {}
        if by_bytes:
            for letter in {letter for edges in self.edges for letter in edges}:
                at = self.edges[1].get(letter)
                if at is None:
                    at = self.edges[1][letter] = len(self.edges)
                    self.edges.append({})
                    whole.append(False)
                if not whole[at]:
                    whole[at], weight[at] = True, len(letter.encode())
        self.fail, self.pops = [-1] * len(self.edges), [0] * len(self.edges)
        queue = deque((0, 1))
        while queue:  # by length, so that links of shorter strings are there
            at = queue.popleft()
            for letter, to in self.edges[at].items():
                queue.append(to)
                if whole[to]:
                    self.fail[to], self.pops[to] = 1, weight.get(to, 1)
                    continue
                back, popped = self.fail[at], self.pops[at]
                while back >= 0 and letter not in self.edges[back]:
                    popped, back = popped + self.pops[back], self.fail[back]
                if back >= 0:
                    self.fail[to], self.pops[to] = self.edges[back][letter], popped

    @staticmethod
    def of_marked(pieces: Iterable[str], by_bytes: bool) -> "Automaton":
        """For a full piece list: words are matched with the mark before them, and the lone mark is a piece too."""
        made = Automaton((), pieces, by_bytes)
        made.first = made.edges[1].get(MARK, 0)
        return made

    def parts(self) -> tuple:
        return self.edges, self.fail, self.pops, self.first, self.by_bytes

    @staticmethod
    def of_parts(parts: tuple) -> "Automaton":
        made = Automaton.__new__(Automaton)
        made.edges, made.fail, made.pops, made.first, made.by_bytes = parts
        return made

    def count(self, word: str) -> int:
        """Number of pieces of a word; 0 if it has a part that no piece matches."""
        at, total, edges, fail, pops = self.first, 0, self.edges, self.fail, self.pops
        for letter in word:
            while letter not in edges[at]:
                if at == 1 and self.by_bytes:  # a letter of no piece at all
                    total += len(letter.encode())
                    break
                total += pops[at]
                at = fail[at]
                if at < 0:
                    return 0
            else:
                at = edges[at][letter]
        while at != 1:
            total += pops[at]
            at = fail[at]
            if at < 0:
                return 0
        return total


def _plain_pieces(path: str) -> tuple[list[str], bool]:
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    every = range(model.get_piece_size())
    plain = [
        model.id_to_piece(i)
        for i in every
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]
    return plain, any(model.is_byte(i) for i in every)


def piece_vocabulary(path: str = VOCABULARY) -> tuple[list[str], list[str]]:
    """Pieces of a sentencepiece file that begin a word (mark removed) and that go on; no special or byte pieces."""
    plain, _ = _plain_pieces(path)
    starts = [p[len(MARK) :] for p in plain if p.startswith(MARK) and len(p) > len(MARK)]
    return starts, [p for p in plain if MARK not in p]


def marked_automaton(path: str = VOCABULARY) -> Automaton:
    """All pieces of a sentencepiece file, the lone mark too; what no piece matches counts its byte pieces, if there are any."""
    return Automaton.of_marked(*_plain_pieces(path))


def token_counts(
    docs: DataFrame, automaton: Automaton, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_words, n_tokens, n_unknown`` for every row, over its whole text.

    Words are runs without the six ASCII spaces.  A word that the automaton cannot match whole is one token and
    counts in ``n_unknown``; with byte pieces there is none.  A null or empty text has none of anything.  Repeated rows come out each, an empty table
    gives an empty result, other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(automaton.parts())  # as large as the vocabulary
    names = ["doc_id", "n_words", "n_tokens", "n_unknown"]
    schema = StructType([StructField("doc_id", docs.schema[id_col].dataType), *[StructField(n, LongType()) for n in names[1:]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, known = Automaton.of_parts(shared.value).count, {}
        for batch in batches:
            for start, texts in chunks(batch, 1):
                rows = []
                for text in texts:
                    words = text.encode().split()  # bytes split at the six ASCII spaces only
                    if len(known) > KEPT_WORDS:
                        known = {}
                    for w in words:
                        if w not in known:
                            known[w] = count(w.decode())
                    found = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                    missed = int((found == 0).sum())
                    rows.append((len(words), int(found.sum()) + missed, missed))
                columns = [batch.column(0).slice(start, len(texts))]
                columns += [pa.array(c, pa.int64()) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
