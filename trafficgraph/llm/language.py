"""Language identification of whole texts, with spans of mixed-language text.

A text's words are its runs of letters. The script of a word's letters narrows
the languages it can be (those whose training words use the script); each
candidate scores the word by the log-probabilities of its character trigrams,
and a Viterbi pass over the words, with a penalty for every switch of
language, labels them. Neighbouring words of one label form a span; the text's
language is the label that covers most letters and its score their share.

The model is a table of ``BUCKETS`` hashed trigrams by language, fitted on
about ``docs_per_language`` labelled texts of each language (those whose hash
lies below that share of the language's count) and the ``MAX_LANGUAGES`` commonest
languages (junk in the label column then costs the rarest ones), so neither its size nor its cost follows the corpus. Prediction is one pass without a shuffle.

Defined cases: a null text, an empty one, or one without letters (or only
with letters of scripts that no training text uses) is ``und`` with score 0;
with ``compete`` a text with letters always has a language: where its scripts
rule all out, the one whose trigrams fit best, with score 0;
ties go to the language first in alphabetical order; repeated rows are
predicted each; without labelled rows every text is ``und``; other columns are
ignored by ``predict`` and kept by ``keep_known``, which judges a text by the
letters that some language can have, keeps those with other letters only, and
keeps all rows without labelled ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficgraph.llm import textscan as ts

BUCKETS = 1 << 16
DOCS_PER_LANGUAGE = 3000
MAX_LANGUAGES = 256
SWITCH_PENALTY = 12.0
SMOOTHING = 0.1
WORD_SHARE = 0.001           # of a language's training words must use a script
SLICE_BYTES = 1 << 20
PASS_WORDS = 400_000
UNKNOWN = "und"

# First and last code points of the scripts told apart.
SCRIPTS = [
    ("Latin", [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F),
               (0x1E00, 0x1EFF)]),
    ("Greek", [(0x370, 0x3FF), (0x1F00, 0x1FFF)]),
    ("Cyrillic", [(0x400, 0x52F)]),
    ("Armenian", [(0x530, 0x58F)]),
    ("Hebrew", [(0x590, 0x5FF)]),
    ("Arabic", [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)]),
    ("Devanagari", [(0x900, 0x97F)]),
    ("Bengali", [(0x980, 0x9FF)]),
    ("Tamil", [(0xB80, 0xBFF)]),
    ("Telugu", [(0xC00, 0xC7F)]),
    ("Thai", [(0xE00, 0xE7F)]),
    ("Georgian", [(0x10A0, 0x10FF)]),
    ("Hangul", [(0x1100, 0x11FF), (0xAC00, 0xD7AF)]),
    ("Kana", [(0x3040, 0x30FF)]),
    ("Han", [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)]),
]
N_SCRIPTS = len(SCRIPTS) + 1      # 0: any other letter
_tables: list[np.ndarray] = []


def _script_of() -> np.ndarray:
    """Script number of every code point, -1 for what is not a letter."""
    if not _tables:
        t = np.full(0x110000, -1, np.int8)
        t[[c for c in range(0x110000) if chr(c).isalpha()]] = 0
        for i, (_, ranges) in enumerate(SCRIPTS):
            for lo, hi in ranges:
                part = t[lo:hi + 1]
                part[part == 0] = i + 1
        _tables.append(t)
    return _tables[0]


class Words:
    """Letters of a block of texts, their trigram buckets, and the words they form."""

    def __init__(self, texts: pa.Array):
        data, offs = ts.utf8(pc.utf8_lower(texts.cast(pa.large_string())))
        code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((data & 0xC0) != 0x80) if len(code) != len(data) else None
        rows = offs if lead is None else np.searchsorted(lead, offs)     # in code points
        script = _script_of()[code]
        letter = script >= 0
        edge = np.zeros(len(code) + 1, bool)
        edge[rows] = True
        first = letter & (np.concatenate(([True], ~letter[:-1])) | edge[:-1]) if len(code) else letter
        last = letter & (np.concatenate((~letter[1:], [True])) | edge[1:]) if len(code) else letter
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.row = np.searchsorted(self.start, rows)          # words of each text
        self.rows = rows
        # Trigrams are centred on letters; a word is bounded by zeros.
        c = np.where(letter, code, 0).astype(np.uint32)
        left = np.concatenate((np.zeros(1, np.uint32), c[:-1])) if len(c) else c
        left = np.where(first, np.uint32(0), left)
        right = np.concatenate((c[1:], np.zeros(1, np.uint32))) if len(c) else c
        right = np.where(last, np.uint32(0), right)
        at = np.flatnonzero(letter)
        h = (left[at] * np.uint32(0x9E3779B1)) ^ (c[at] * np.uint32(0x85EBCA77)) \
            ^ (right[at] * np.uint32(0xC2B2AE3D))
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        self.bucket = (h >> np.uint32(16)).astype(np.int64)
        self.length = self.end - self.start
        self.first_gram = np.cumsum(self.length) - self.length
        self.script = script[self.start]


class Model:
    """Trigram log-probabilities by language and the scripts of each language."""

    def __init__(self, languages: list[str], grams: np.ndarray, scripts: np.ndarray):
        self.languages = languages
        total = grams.sum(axis=0, keepdims=True)
        self.log_p = np.log((grams + SMOOTHING) / (total + SMOOTHING * BUCKETS)).astype(np.float32)
        words = np.maximum(scripts.sum(axis=0, keepdims=True), 1)
        self.possible = scripts / words >= WORD_SHARE         # script x language

    def scores(self, w: Words) -> np.ndarray:
        """Word x language; -inf where the script rules the language out, all 0
        where it rules out every language."""
        n = len(self.languages)
        if not len(w.start):
            return np.zeros((0, n), np.float32)
        if not n:
            return np.zeros((len(w.start), 0), np.float32)
        s = np.stack([np.add.reduceat(self.log_p[:, j][w.bucket], w.first_gram)
                      for j in range(n)], axis=1)
        can = self.possible[w.script]
        known = can.any(axis=1, keepdims=True)
        return np.where(can, s, np.where(known, -np.inf, 0)).astype(np.float32)


def viterbi(scores: np.ndarray, row: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every word of many texts at once: texts advance together, the
    longest first, so each step is one small array operation."""
    labels = np.zeros(len(scores), np.int32)
    n_words = np.diff(row)
    order = np.argsort(-n_words, kind="stable")
    lens = n_words[order]
    steps = int(lens[0]) if len(lens) else 0
    if not steps or not scores.shape[1]:
        return labels
    begin = row[:-1][order]
    active = np.searchsorted(-lens, -np.arange(steps), "left")      # texts longer than t
    many = scores.shape[1]
    back_switch = np.zeros((int(active.sum()), many), bool)
    back_best = np.zeros(int(active.sum()), np.uint8)
    at = np.concatenate(([0], np.cumsum(active)))
    m = scores[begin[:active[0]]].astype(np.float64)
    for t in range(1, steps):
        k = active[t]
        m = m[:k]
        best = m.argmax(axis=1)
        top = m[np.arange(k), best] - penalty
        switch = m < top[:, None]
        back_switch[at[t]:at[t] + k] = switch
        back_best[at[t]:at[t] + k] = best
        m_next = np.where(switch, top[:, None], m) + scores[begin[:k] + t]
        ended = active[t] - (active[t + 1] if t + 1 < steps else 0)
        if ended:
            stop = slice(k - ended, k)
            labels[begin[stop] + t] = m_next[stop].argmax(axis=1)
        m = m_next
    one = slice(active[1] if steps > 1 else 0, active[0])
    labels[begin[one]] = scores[begin[one]].argmax(axis=1)
    for t in range(steps - 1, 0, -1):
        k = active[t]
        now = labels[begin[:k] + t]
        j = at[t] + np.arange(k)
        labels[begin[:k] + t - 1] = np.where(back_switch[j, now], back_best[j], now)
    return labels


def _labelled(model: Model, texts: pa.Array, penalty: float) -> Iterator[tuple]:
    """Blocks of rows ``(low, high, row, start, end, labels)``: words with their place in
    their text and the number of their language, -1 where none is possible.

    Letters are scanned in slices; a Viterbi pass takes several slices together
    (``PASS_WORDS`` words), as its steps cost alike for few and many texts.
    """
    _, offs = ts.utf8(texts)
    held, low = [], 0
    cuts = list(ts.slices(offs, SLICE_BYTES))
    for j, (lo, hi) in enumerate(cuts):
        w = Words(texts.slice(lo, hi - lo))
        row = np.repeat(np.arange(lo, hi), np.diff(w.row))
        base = w.rows[row - lo]
        held.append((model.scores(w), np.diff(w.row), row, w.start - base, w.end - base,
                     model.possible[w.script].any(axis=1)))
        if j + 1 == len(cuts) or sum(len(x[0]) for x in held) >= PASS_WORDS:
            scores, n, row, start, end, known = map(np.concatenate, zip(*held))
            labels = viterbi(scores, np.concatenate(([0], np.cumsum(n))), penalty)
            yield low, hi, row, start, end, np.where(known, labels, -1)
            held, low = [], hi


def _best_fit(model: Model, texts: pa.Array) -> list[int]:
    """The language whose trigrams fit each text best, scripts aside."""
    best: list[int] = []
    _, offs = ts.utf8(texts)
    for lo, hi in ts.slices(offs, SLICE_BYTES):
        w = Words(texts.slice(lo, hi - lo))
        row = np.repeat(np.repeat(np.arange(hi - lo), np.diff(w.row)), w.length)
        fit = [np.bincount(row, model.log_p[:, j][w.bucket], minlength=hi - lo)
               for j in range(len(model.languages))]
        best.extend(np.stack(fit, axis=1).argmax(axis=1).tolist())
    return best


def _predict(model: Model, texts: pa.Array, penalty: float,
             compete: bool = False) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language of each text, its share of all letters, and of the letters that some
    language can have (1 if a text has others only)."""
    n, many = len(texts), len(model.languages)
    names, shares, possible = [UNKNOWN] * n, np.zeros(n), np.zeros(n)
    if not many:
        return names, shares, possible
    for low, high, row, start, end, labels in _labelled(model, texts, penalty):
        known, row, length = labels >= 0, row - low, end - start
        letters = np.bincount(row[known] * many + labels[known], length[known],
                              minlength=(high - low) * many).reshape(-1, many)
        best = letters.argmax(axis=1)
        most = letters.max(axis=1)
        every = np.bincount(row, length, minlength=high - low)
        shares[low:high] = most / np.maximum(every, 1)
        possible[low:high] = np.where(most > 0, most / np.maximum(letters.sum(axis=1), 1), every > 0)
        names[low:high] = [model.languages[b] if v else UNKNOWN for b, v in zip(best, most)]
        if compete:
            loose = low + np.flatnonzero((most == 0) & (every > 0))
            for i, b in zip(loose.tolist(), _best_fit(model, texts.take(pa.array(loose, pa.int64())))):
                names[i] = model.languages[b]
    return names, shares, possible


def fit(labelled: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> Model:
    """Model of the labelled texts (doc_id, text, lang), read from about
    ``docs_per_language`` of each language."""
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    most = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    chosen = sorted(most, key=lambda r: r["lang"])
    languages = [r["lang"] for r in chosen]
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((N_SCRIPTS, 0)))
    code = F.create_map(*[x for i, r in enumerate(chosen) for x in (F.lit(r["lang"]), F.lit(i))])
    share = F.create_map(*[x for r in chosen for x in (
        F.lit(r["lang"]), F.lit(min(1.0, docs_per_language / r["count"])))])
    h = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = (known.where(h < share[F.col("lang")])
              .select(code[F.col("lang")].alias("_l"), F.col("text").cast("string")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = np.zeros((len(languages), BUCKETS + N_SCRIPTS), np.int64)
        for b in batches:
            lang = np.asarray(b.column(0))
            _, offs = ts.utf8(b.column(1))
            for lo, hi in ts.slices(offs, SLICE_BYTES):
                w = Words(b.column(1).slice(lo, hi - lo))
                word_lang = np.repeat(lang[lo:hi], np.diff(w.row))
                gram_lang = np.repeat(word_lang, w.length)
                for i in np.unique(lang[lo:hi]):
                    grams[i, :BUCKETS] += np.bincount(w.bucket[gram_lang == i], minlength=BUCKETS)
                    grams[i, BUCKETS:] += np.bincount(w.script[word_lang == i], minlength=N_SCRIPTS)
        i, k = np.nonzero(grams)
        for a in range(0, len(i), 1 << 16):
            part = slice(a, a + (1 << 16))
            yield pa.RecordBatch.from_arrays(
                [pa.array(i[part], pa.int32()), pa.array(k[part], pa.int32()),
                 pa.array(grams[i[part], k[part]], pa.int64())], ["l", "k", "n"])

    counts = (sample.mapInArrow(ts.returning(count), "l int, k int, n long")
              .groupBy("l", "k").agg(F.sum("n").alias("n")).toPandas())
    grams = np.zeros((BUCKETS + N_SCRIPTS, len(languages)))
    grams[counts["k"], counts["l"]] = counts["n"]
    return Model(languages, grams[:BUCKETS], grams[BUCKETS:])


def predict(docs: DataFrame, model: Model, penalty: float = SWITCH_PENALTY,
            compete: bool = False) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row of ``docs`` (doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            lang, score, _ = _predict(held.value, b.column(1), penalty, compete)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                ["doc_id", "lang_pred", "score"])

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(ts.returning(run), "doc_id long, lang_pred string, score double"))


def label_spans(docs: DataFrame, model: Model, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """Spans of one language each: ``doc_id, span, lang, char_start, char_end`` (characters
    of the lower-cased text, end exclusive)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    out = pa.schema([("doc_id", pa.int64()), ("span", pa.int64()), ("lang", pa.string()),
                     ("char_start", pa.int64()), ("char_end", pa.int64())])

    def run(batches):
        names = [*held.value.languages, UNKNOWN]
        for b in batches:
            for _, _, row, start, end, labels in _labelled(held.value, b.column(1), penalty):
                if not len(row):
                    continue
                new = np.concatenate(([True], (np.diff(labels) != 0) | (np.diff(row) != 0)))
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(labels)) - 1
                r = row[first]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(r)),
                     pa.array(np.arange(len(first)) - np.searchsorted(r, r), pa.int64()),
                     pa.array([names[i] for i in labels[first]], pa.string()),
                     pa.array(start[first], pa.int64()), pa.array(end[last], pa.int64())], schema=out)

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(ts.returning(run), "doc_id long, span long, lang string, char_start long, char_end long"))


def held_out() -> F.Column:
    """Rows never learned from: crc32 of the id's digits is 2 modulo 4 (null id: not)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def keep_known(docs: DataFrame, model: Model, min_score: float = 0.5,
               penalty: float = SWITCH_PENALTY) -> DataFrame:
    """``docs`` (all columns) whose ``text`` has a language with that share or more of the
    letters that some language can have, or letters of other scripts only."""
    if not model.languages:
        return docs
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            lang, _, share = _predict(held.value, b.column(at), penalty, compete=True)
            yield b.filter(pa.array((np.array(lang, object) != UNKNOWN) & (share >= min_score), pa.bool_()))

    return docs.mapInArrow(ts.returning(run), docs.schema)
