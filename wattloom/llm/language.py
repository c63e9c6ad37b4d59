"""Language of texts and of spans inside them.

The script of a word's letters narrows the languages it may be in; among these, a word's score is the mean
log-likelihood of its character n-grams and of the word itself.  A Viterbi pass over the words of a text, with a
penalty for every switch, labels spans; the language with most words is the text's.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType


from wattloom.llm.sampling import sample
from wattloom.llm.wordtext import WordTable, chunks, hashed_pieces, letter_words

BUCKETS = 1 << 16
SWITCH = 6.0  # log-likelihood a change of language must gain
SHORT = 50  # words of a piece that may just as well advance word by word
SLACK = 1e-3  # log-likelihood; closer words are left to the search word by word, which knows how ties go
WEIGHT = 3.0  # of a word's mean n-gram log-likelihood
FIT_DOCUMENTS = 300  # most rows of each language that the model is fitted on
FIT_CHARS = 20_000  # longer texts are used where a language has too few shorter ones
FIT_TOTAL = 100_000_000  # most characters of all languages together
SCRIPT_SHARE = 0.01  # a language uses a script if so much of its letters is in it
UNKNOWN = "und"
FAR = -1e4  # score of a language that a word's script rules out

# Code point ranges of common scripts, by first and last code point.
SCRIPTS = [
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x77F),
    ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("gurmukhi", 0xA00, 0xA7F), ("gujarati", 0xA80, 0xAFF),
    ("tamil", 0xB80, 0xBFF), ("telugu", 0xC00, 0xC7F), ("kannada", 0xC80, 0xCFF), ("malayalam", 0xD00, 0xD7F),
    ("thai", 0xE00, 0xE7F), ("lao", 0xE80, 0xEFF), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("ethiopic", 0x1200, 0x137F), ("khmer", 0x1780, 0x17FF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x2FFFF),
]
NAMES = sorted({name for name, _, _ in SCRIPTS}) + ["other"]
_STARTS = np.array(sorted(low for _, low, _ in SCRIPTS))
_BY_START = {low: (high, NAMES.index(name)) for name, low, high in SCRIPTS}


_ENDS = np.array([_BY_START[s][0] for s in _STARTS.tolist()])
_NAME_AT = np.array([_BY_START[s][1] for s in _STARTS.tolist()])


def scripts(words: list[str]) -> np.ndarray:
    """Number in ``NAMES`` of the script of each word's first letter."""
    codes = np.array([ord(w[0]) for w in words], np.int64)
    at = np.searchsorted(_STARTS, codes, side="right") - 1
    return np.where((at >= 0) & (codes <= _ENDS[at]), _NAME_AT[at], len(NAMES) - 1)


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray  # (languages, BUCKETS) log-likelihoods
    words: np.ndarray
    uses: np.ndarray  # (scripts, languages) bool

    def scores(self, words: list[str]) -> np.ndarray:
        """Score of each word in each language, the best at 0; all 0 if its script is in no language."""
        flat, sizes = hashed_pieces(words, 1, 4, BUCKETS)
        mean = np.add.reduceat(self.grams[:, flat], np.cumsum(np.r_[0, sizes])[:-1], axis=1) / sizes
        own = self.words[:, [zlib.crc32(w.encode()) % BUCKETS for w in words]]
        total = (WEIGHT * mean + own).T
        allowed = self.uses[scripts(words)]
        neutral = ~allowed.any(axis=1)
        allowed = allowed | ~allowed.any(axis=1, keepdims=True)
        total = np.where(allowed, total, FAR)
        return np.where(neutral[:, None], 0, total - total.max(axis=1, keepdims=True)).astype(np.float32)


def fit(texts: list[str], langs: list[str]) -> Model:
    """Count n-grams, words and scripts by language."""
    languages = sorted(set(langs))
    k = len(languages)
    grams, words, used = np.full((k, BUCKETS), 0.05), np.full((k, BUCKETS), 0.01), np.zeros((len(NAMES), k))
    for text, lang in zip(texts, langs):
        at, found = languages.index(lang), letter_words(text)
        if found:
            grams[at] += np.bincount(hashed_pieces(found, 1, 4, BUCKETS)[0], minlength=BUCKETS)
            np.add.at(words[at], [zlib.crc32(w.encode()) % BUCKETS for w in found], 1)
            np.add.at(used[:, at], scripts(found), [len(w) for w in found])
    share = used / np.maximum(1, used.sum(axis=0))
    return Model(
        languages,
        np.log(grams / grams.sum(axis=1, keepdims=True)),
        0.2 * np.log(words / words.sum(axis=1, keepdims=True)),
        share >= SCRIPT_SHARE,
    )


def _advance(scores: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """Best path of each of the concatenated texts, none empty; all of them advance word by word together."""
    k = scores.shape[1]
    order = np.argsort(-sizes, kind="stable")
    offset = (np.cumsum(sizes) - sizes)[order]
    length = sizes[order]
    longest = int(length[0])
    path = np.zeros(len(scores), np.int16)
    alive = np.searchsorted(-length, -np.arange(1, longest + 1), side="right")  # texts of at least t + 1 words
    best = np.zeros((len(sizes), k), np.float32)
    came: list[np.ndarray] = []
    for t in range(longest):
        n = alive[t]
        now = best[:n]
        top = now.argmax(axis=1)
        jump = now[np.arange(n), top] - penalty
        moved = jump[:, None] > now
        came.append(np.where(moved, top[:, None], np.arange(k)).astype(np.int16))
        best[:n] = np.where(moved, jump[:, None], now) + scores[offset[:n] + t]
    state = np.zeros(len(sizes), np.int64)
    for t in range(longest - 1, -1, -1):
        n, before = alive[t], alive[t + 1] if t + 1 < longest else 0
        state[before:n] = best[before:n].argmax(axis=1)
        path[offset[:n] + t] = state[:n]
        state[:n] = came[t][np.arange(n), state[:n]]
    return path


def _runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of runs, one run after another."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _clipped_sums(gain: np.ndarray, at: np.ndarray, start: np.ndarray, bound: float) -> np.ndarray:
    """Sums along ``gain``, the sum so far cut to ``bound`` on either side before each step; at ``at`` it is ``start``.

    A step takes x to clip(x + add, low, high) and so do several; every word's steps are doubled until they have one
    outcome.  ``at`` begins with 0.
    """
    add, low, high = gain.copy(), gain - bound, gain + bound
    low[at] = high[at] = gain[at] + start
    todo, reach = np.flatnonzero(low != high), 1
    while len(todo):
        before, more, least, most = todo - reach, add[todo], low[todo], high[todo]
        lower, upper = np.clip(low[before] + more, least, most), np.clip(high[before] + more, least, most)
        add[todo] = add[before] + more
        low[todo], high[todo] = lower, upper
        todo, reach = todo[lower != upper], 2 * reach
    return low


def _is_main(scores: np.ndarray, main: np.ndarray, sizes: np.ndarray, edges: np.ndarray, penalty: float) -> np.ndarray:
    """Which words are in their piece's ``main`` language on every best path.

    They are if they are so in the easier choice between that language and the best other one for each word, with free
    switches among the others.  ``edges`` is what the main language is ahead by, before and after each piece.
    """
    rows = np.arange(len(scores))
    others = scores.copy()
    others[rows, main] = -np.inf
    gain = scores[rows, main].astype(np.float64) - others.max(axis=1)
    end = np.cumsum(sizes)
    left = _clipped_sums(gain, end - sizes, edges[:, 0], penalty)
    right = _clipped_sums(gain[::-1], (len(gain) - end)[::-1], edges[::-1, 1], penalty)[::-1]
    return left + right - gain > SLACK


def viterbi(scores: np.ndarray, sizes: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """Best language of each word of concatenated texts.

    Staying costs nothing and any switch ``penalty``; of equally good paths the one that stays, then the first
    language.  Words that every best path has in the language with the highest sum are settled first, then the same
    for each piece left between them, while that settles a twentieth of the words; the rest advances word by word, all
    pieces of the batch together, between neighbours that are settled.
    """
    path = np.zeros(len(scores), np.int16)
    if scores.shape[1] < 2 or not len(scores):
        return path
    size = sizes[sizes > 0]
    begin = np.cumsum(size) - size
    first, last = np.zeros(len(scores), bool), np.zeros(len(scores), bool)  # of a text
    first[begin] = last[begin + size - 1] = True
    while len(size) and size.max() > SHORT:
        at = _runs(begin, size)
        piece = scores[at]
        main = np.add.reduceat(piece, np.cumsum(size) - size, axis=0, dtype=np.float64).argmax(axis=1)
        outer = path.take(np.c_[begin - 1, begin + size], mode="clip")  # settled before, if not in another text
        edges = np.where(outer == main[:, None], penalty, -penalty)
        edges[np.c_[first[begin], last[begin + size - 1]]] = 0
        path[at] = np.repeat(main, size)
        is_open = np.zeros(len(scores) + 2, bool)
        is_open[at + 1] = ~_is_main(piece, path[at], size, edges, penalty)
        here = is_open[1:-1]
        begin = np.flatnonzero(here & (first | ~is_open[:-2]))
        size = np.flatnonzero(here & (last | ~is_open[2:])) - begin + 1
        if size.sum() > 0.95 * len(at):
            break
    if not len(size):
        return path
    left, right = ~first[begin], ~last[begin + size - 1]
    wide = size + left + right
    at = _runs(begin - left, wide)
    part, end = scores[at], np.cumsum(wide)
    settled = np.r_[(end - wide)[left], (end - 1)[right]]
    part[settled] = -np.inf
    part[settled, path[at[settled]]] = 0
    inner = np.ones(len(at), bool)
    inner[settled] = False
    path[at[inner]] = _advance(part, wide, penalty)[inner]
    return path


def label_texts(model: Model, table: WordTable, texts: list[str]):
    """Per text: language, score, and spans (first word, words, language)."""
    split = [letter_words(t) for t in texts]
    sizes = np.array([len(ws) for ws in split], np.int64)
    ids = table.ids([w for ws in split for w in ws])
    path = viterbi(table.rows[ids], sizes)
    offset = np.r_[0, np.cumsum(sizes)]
    out = []
    for i, n in enumerate(sizes.tolist()):
        if not n:
            out.append((UNKNOWN, 0.0, []))
            continue
        part = path[offset[i] : offset[i + 1]]
        counts = np.bincount(part, minlength=len(model.languages))
        first = np.r_[0, np.flatnonzero(np.diff(part)) + 1]
        spans = [(int(a), int(b - a), model.languages[part[a]]) for a, b in zip(first, np.r_[first[1:], n])]
        lang = int(counts.argmax())
        out.append((model.languages[lang], float(counts[lang] / n), spans))
    return out


def fit_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"):
    """Texts and languages to fit on: at most ``FIT_DOCUMENTS`` per language and ``FIT_CHARS`` times as many
    characters, shorter texts first (see ``sampling.sample``)."""
    text, lang = F.col(text_col).cast("string"), F.col(lang_col).cast("string")
    rows = docs.filter(lang.isNotNull() & F.col(id_col).isNotNull() & text.isNotNull())
    labelled = rows.select(
        F.col(id_col).alias("k"), F.xxhash64(text).alias("d"), F.char_length(text).alias("n"), lang.alias("y")
    )
    return sample(docs, labelled, FIT_DOCUMENTS, FIT_CHARS, id_col, text_col, FIT_TOTAL)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, spans`` for every row, from its whole text alone.

    ``score`` is the share of the text's letter words labelled ``lang_pred``; ``spans`` gives first word, number of
    words and language of each stretch.  A text that is null or has no letter is ``und`` with score 0 and no spans;
    so is every text if nothing was learned.  Ties go to the language first in order.  Repeated rows come out each,
    an empty table gives an empty result, other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dict(vars(model)))  # a fixed size per language, about 1 MB
    span = StructType([StructField("first", LongType()), StructField("words", LongType()), StructField("lang", StringType())])
    schema = StructType(
        [
            StructField("doc_id", docs.schema[id_col].dataType),
            StructField("lang_pred", StringType()),
            StructField("score", DoubleType()),
            StructField("spans", ArrayType(span)),
        ]
    )
    kinds = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**shared.value)
        table = WordTable(max(1, len(model.languages)), model.scores)
        for batch in batches:
            for start, texts in chunks(batch, 1):
                found = label_texts(model, table, texts) if model.languages else [(UNKNOWN, 0.0, [])] * len(texts)
                lang, score, spans = zip(*found)
                spans = [[dict(zip(("first", "words", "lang"), s)) for s in part] for part in spans]
                columns = [batch.column(0).slice(start, len(texts)), pa.array(lang, pa.string())]
                columns += [pa.array(score, pa.float64()), pa.array(spans, kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def is_held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2
