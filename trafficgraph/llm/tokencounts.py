"""Token counts of a unigram vocabulary without the tokens: count-only Viterbi.

An Aho-Corasick automaton over the vocabulary gives every piece that ends at a
character; dynamic programming carries the best score and the number of pieces
up to there, and nothing else. Rules of the unigram tokenizer of the
``tokenizers`` library: spaces become U+2581 and one is put in front of a text;
scores add up in double precision from left to right; of equal scores the
piece that starts first wins; a character that no piece covers scores the
lowest score less 10 and counts its UTF-8 bytes (vocabularies with byte
pieces) or, with its unknown neighbours together, one piece.

No piece may hold U+2581 after another character (checked), so a text falls
into independent words there; words repeat, and the counts of short ones are
cached (at most ``CACHE_WORDS`` of ``CACHE_CHARS`` characters, so the cache's bytes are
bounded). Dynamic programming keeps as many places as the longest piece has
characters, so memory does not follow the length of a word either.
(With scores that are not whole numbers, sums by word may round differently
than sums by text; this can only matter between segmentations whose scores
agree to the last bits.) One pass over the documents, no shuffle.

Defined cases: null and empty texts have no tokens and score 0; repeated rows
are counted each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficgraph.llm import textscan as ts

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_WORDS = 400_000
CACHE_CHARS = 24             # longer words are counted anew each time
_WORDS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """``(piece, score)`` of a sentencepiece model file, by id (0 is unknown)."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


class Counter:
    """Counts and best scores of the pieces of texts."""

    def __init__(self, vocabulary: list[tuple[str, float]], cache: int = CACHE_WORDS):
        import ahocorasick
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _ in vocabulary):
            raise ValueError(f"a piece holds {SPACE} after another character")
        if not any(p == SPACE for p, _ in vocabulary):
            raise ValueError(f"{SPACE} is no piece")
        self.matches = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        pieces = {p for p, _ in vocabulary}
        self.places = 1 << max(map(len, pieces)).bit_length()      # more than the longest piece
        self.by_bytes = all(f"<0x{b:02X}>" in pieces for b in range(256))
        self.runs = any(p.startswith(SPACE * 2) for p in pieces)
        best = self.best

        class Words(dict):
            """A word (without its leading space) -> complex(pieces, score)."""
            def __missing__(self, word):
                found = complex(*best(SPACE + word))
                if len(word) <= CACHE_CHARS and len(self) < cache:
                    self[word] = found
                return found
        self.words = Words()

    def best(self, word: str) -> tuple[int, float]:
        """Number of pieces and score of the best segmentation of ``word``."""
        # Scores, counts and marks of the last places, at the place modulo their number.
        n, last = len(word), self.places - 1
        score, count, unknown = [0.0] * (last + 1), [0] * (last + 1), [False] * (last + 1)
        matches = self.matches.iter(word)
        match = next(matches, None)
        for e in range(1, n + 1):
            ends, single = [], False
            while match is not None and match[0] == e - 1:
                size, s = match[1]
                ends.append((e - size, s))
                single = single or size == 1
                match = next(matches, None)
            top, at, unk = None, -1, False
            for start, s in sorted(ends):
                total = s + score[start & last]
                if top is None or total > top:
                    top, at = total, start
            if not single:
                total = self.unknown + score[e - 1 & last]
                if top is None or total > top:
                    top, at, unk = total, e - 1, True
            before = count[at & last]
            if not unk:
                pieces = before + 1
            elif self.by_bytes:
                pieces = before + len(word[at].encode("utf-8"))
            else:
                pieces = before + (not unknown[at & last])
            score[e & last], count[e & last], unknown[e & last] = top, pieces, unk
        return count[n & last], score[n & last]

    def __call__(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        if SPACE in text or self.runs and (text[0] == " " or "  " in text):
            found = [self.best(w) for w in _WORDS.findall(SPACE + text.replace(" ", SPACE))]
            return sum(x[0] for x in found), sum(x[1] for x in found)
        total = sum(map(self.words.__getitem__, text.split(" ")), 0j)
        return int(total.real), total.imag


def count_tokens(docs: DataFrame, vocabulary: str | list[tuple[str, float]]) -> DataFrame:
    """``doc_id, n_tokens, score`` of every row of ``docs`` (doc_id, text).

    ``vocabulary``: ``(piece, score)`` by id, or the path of a sentencepiece
    model that every executor can read.
    """
    def run(batches):
        counter = Counter(read_vocabulary(vocabulary) if isinstance(vocabulary, str) else vocabulary)
        for b in batches:
            n, score = [], []
            for text in b.column(1):
                found = counter(text.as_py() or "")
                n.append(found[0])
                score.append(found[1])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(score, pa.float64())],
                ["doc_id", "n_tokens", "score"])

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(ts.returning(run), "doc_id long, n_tokens long, score double"))
