"""Language identification: script ranges, per-word scores and Viterbi spans.

Character n-grams of the words of labelled documents are counted by language in hashed bins; a word's score for a language
is its n-grams' log-likelihood. The script of a word narrows the candidates to the languages that use it. Viterbi over the
words of a whole text, with a penalty for each switch, labels spans of mixed-language text; the prediction is the language
of the most letters, the score their share. Texts of a batch advance together, longest first.

The model is fitted on a bounded sample: the ``most_docs`` training documents of least hashed id. Training rows need text
and a language; the language, the source and the id of a row are no inputs of its prediction. Null text, or text without a
letter, is ``und`` with score 0. Without training rows all is ``und``. Every row gives a row, also repeated ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 16
RUNS = re.compile(r"[^\W\d_]+").findall
#: First code points of ranges of scripts, in order; what lies between named ranges is "other".
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "indic"), (0x0E00, "thai"), (0x0E80, "other"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1380, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"),
)
NAMES = sorted({n for _, n in SCRIPTS})
STARTS = np.array([s for s, _ in SCRIPTS])
CODES = np.array([NAMES.index(n) for _, n in SCRIPTS])


def letters(text: str) -> list[str]:
    """Runs of letters in lower case; numerals that are no digits, such as fractions and Roman ones, are no letters."""
    found = RUNS(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [x for w in found for x in "".join(c if c.isalpha() else " " for c in w).split()]


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-gram bins of all words one after another, where each word's begin, and each word's script."""
    raw = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = np.array([len(w) + 2 for w in words])
    ends = np.cumsum(n)
    starts = ends - n
    scripts = CODES[np.searchsorted(STARTS, raw[starts + 1].astype(np.int64), side="right") - 1]
    mult = np.uint64(0x9E3779B97F4A7C15)
    two = (raw[:-1] * np.uint64(0x1F123BB5) + raw[1:]) * mult
    three = ((raw[:-2] * np.uint64(0x1F123BB5) + raw[1:-1]) * np.uint64(0x5851F42D4C957F2D) + raw[2:] + np.uint64(1)) * mult
    shift = np.uint64(64 - BITS)
    # A word of n characters and two blanks has n + 1 pairs, then n triples (place p: raw[p:p+3]).
    size = 2 * n - 3
    begin = np.cumsum(size) - size
    out = np.empty(size.sum(), np.int64)
    word = np.repeat(np.arange(len(words)), size)
    k = np.arange(len(out)) - np.repeat(begin, size)
    pair = k < (n - 1)[word]
    out[pair] = (two[starts[word[pair]] + k[pair]] >> shift).astype(np.int64)
    rest = ~pair
    out[rest] = (three[starts[word[rest]] + k[rest] - (n - 1)[word[rest]]] >> shift).astype(np.int64)
    return out, begin, scripts


def viterbi(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """The best state of each step of each sequence; scores[i] has a row a step. Ties stay, then take the first state."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    lengths = np.array([len(scores[i]) for i in order])
    if not len(lengths) or not lengths[0]:
        return [np.zeros(0, np.int64) for _ in scores]
    n_states = scores[order[0]].shape[1]
    flat = np.concatenate([scores[i] for i in order])
    base = np.cumsum(lengths) - lengths
    doc = np.repeat(np.arange(len(order)), lengths)
    step = np.arange(len(flat)) - base[doc]
    perm = np.lexsort((doc, step))
    flat = flat[perm]
    active = np.bincount(step)
    offset = np.cumsum(active) - active
    value = flat[: active[0]].copy()
    best = np.zeros(len(flat), np.uint8)
    switch = np.zeros((len(flat), n_states), bool)
    last = np.zeros(len(order), np.int64)
    for t in range(1, len(active)):
        n, at = active[t], offset[t]
        if n < len(value):
            last[n : len(value)] = value[n:].argmax(axis=1)
            value = value[:n]
        top = value.argmax(axis=1)
        other = value[np.arange(n), top] - penalty
        moves = other[:, None] > value
        best[at : at + n], switch[at : at + n] = top, moves
        value = np.where(moves, other[:, None], value) + flat[at : at + n]
    last[: len(value)] = value.argmax(axis=1)
    path = np.zeros(len(flat), np.uint8)
    state = last.copy()
    for t in range(len(active) - 1, -1, -1):
        n, at = active[t], offset[t]
        now = state[:n]
        path[at : at + n] = now
        if t:
            moved = switch[at : at + n][np.arange(n), now]
            now[moved] = best[at : at + n][moved]
    back = np.empty_like(path)
    back[perm] = path
    out: list[np.ndarray] = [np.zeros(0, np.uint8)] * len(scores)
    for k, i in enumerate(order):
        out[i] = back[base[k] : base[k] + lengths[k]]
    return out


@dataclass
class Model:
    """Log-likelihoods by bin and language, and which scripts a language uses."""

    languages: list[str]
    weights: np.ndarray
    allowed: np.ndarray
    penalty: float = 6.0
    most_words: int = 300_000
    index: dict = field(default_factory=dict)
    table: np.ndarray | None = None

    def score(self, words: list[str]) -> np.ndarray:
        """A row of scores for each word; languages that do not use its script are out, unless none does."""
        bins, begin, scripts = features(words)
        out = np.add.reduceat(self.weights[bins], begin, axis=0)
        use = self.allowed[scripts]
        none = ~use.any(axis=1)
        out[~use & ~none[:, None]] = -1e3
        out[none] = 0
        return out.astype(np.float32)

    def rows(self, lists: list[list[str]]) -> list[np.ndarray]:
        """Scores of each word of each list, from a bounded cache."""
        new = list(set().union(*lists) - self.index.keys())
        if len(self.index) + len(new) > self.most_words:
            self.index, self.table = {}, None
            new = list(set().union(*lists))
        if new:
            had = len(self.index)
            self.index.update(zip(new, range(had, had + len(new)), strict=True))
            scores = self.score(new)
            if self.table is None or had + len(new) > len(self.table):
                grown = np.empty((max(1 << 14, 2 * (had + len(new))), len(self.languages)), np.float32)
                if had:
                    grown[:had] = self.table[:had]
                self.table = grown
            self.table[had : had + len(new)] = scores
        get = self.index.__getitem__
        return [self.table[np.fromiter(map(get, w), np.int64, len(w))] for w in lists]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, np.ndarray]]:
        """(language, score, the language number of each word) of each text."""
        lists = [letters(t or "") for t in texts]
        if not self.languages:
            return [("und", 0.0, np.zeros(len(w), np.uint8)) for w in lists]
        out = []
        for w, path in zip(lists, viterbi(self.rows(lists), self.penalty), strict=True):
            if not w:
                out.append(("und", 0.0, path))
                continue
            share = np.bincount(path, np.fromiter(map(len, w), np.int64, len(w)), len(self.languages))
            out.append((self.languages[int(share.argmax())], float(share.max() / share.sum()), path))
        return out


def fit(df: DataFrame, most_docs: int = 4000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rare: float = 1e-3) -> Model:
    """A model from at most ``most_docs`` rows of df with text and language; the driver gets counts by bin, not texts."""
    own = df.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    some = own.select(F.col(id_col).alias("_id")).orderBy(F.xxhash64("_id"), "_id").limit(most_docs)
    # Ids of most_docs rows at most are broadcast.
    rows = own.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).join(F.broadcast(some.distinct()), "_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if words := letters(text):
                    bins, _, scripts = features(words)
                    c = counts.setdefault(lang, np.zeros((1 << BITS) + len(NAMES), np.int64))
                    c[: 1 << BITS] += np.bincount(bins, minlength=1 << BITS)
                    c[1 << BITS :] += np.bincount(scripts, minlength=len(NAMES))
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(c[at])], names=["lang", "bin", "n"])

    counted = rows.select("text", "lang").mapInArrow(count, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r.lang for r in counted})
    c = np.zeros(((1 << BITS) + len(NAMES), len(languages)))
    for r in counted:
        c[r.bin, languages.index(r.lang)] = r.n
    grams, scripts = c[: 1 << BITS], c[1 << BITS :]
    weights = np.log((grams + 0.2) / (grams.sum(axis=0) + 0.2 * len(grams)))
    allowed = scripts > rare * scripts.sum(axis=0)
    # Only differences between languages matter; the mean is taken off so that long paths stay small.
    return Model(languages, (weights - weights.mean(axis=1, keepdims=True)).astype(np.float32) if languages else weights, allowed)


_MODELS: dict[int, Model] = {}


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", step: int = 1024) -> DataFrame:
    """(id, lang_pred, score) for every row of df."""
    if model.weights.nbytes > 256 << 20:
        raise ValueError("the model is too large to broadcast")
    shared = df.sparkSession.sparkContext.broadcast((model.languages, model.weights, model.allowed, model.penalty))
    key = shared._jbroadcast.id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _MODELS:
            _MODELS.clear()
            _MODELS[key] = Model(*shared.value)
        m = _MODELS[key]
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                found = m.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[id_col, "lang_pred", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, by 5, is 0; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
