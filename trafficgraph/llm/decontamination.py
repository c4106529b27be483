"""Benchmark decontamination by greedy string tiling.

Words are maximal runs of letters, marks and digits of any script, lower-cased;
each character of a script written without spaces (Han, Kana, Thai and others in
``textscan.UNSPACED``) is a word of its own. Runs of five words
that a document shares with a benchmark item (Karp-Rabin hashes looked up in a
sorted seed index) make the pair a candidate; then the longest match of the
pair over words that no tile covers yet is marked as a tile, again and again,
until no match of five words is left. Each longest match is found by running
Karp-Rabin: hashes of all unmarked runs of one length, the length by bisection.
The share of the item's words under tiles is its coverage. Since tiles may lie
in any order, a passage whose parts were moved is caught as well.

The benchmark is a query set held by the tasks in blocks of at most
``block_words`` words (one pass over the documents each), so what is shipped
is bounded at any benchmark size; documents are never shuffled.

Defined cases: null and empty texts match nothing; items of fewer than five
words are found by their whole sequence of words if ``short_items`` is set, and
never otherwise; items without words are never found; repeated rows and repeated items are reported each;
an empty table on either side gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficgraph.llm import textscan as ts

MIN_WORDS = 5                # shortest tile
MIN_COVERAGE = 0.6           # share of an item's words under tiles that contaminates
BLOCK_WORDS = 2_000_000      # benchmark words held by a task
SLICE_BYTES = 2 << 20
_B = 0xD6E8FEB86659FD93

SCHEMA = ("doc_id long, item_id long, item_words long, covered_words long, coverage double, "
          "n_tiles long, longest_tile long, "
          "tiles array<struct<doc_word: long, item_word: long, n_words: long>>")


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row starts and hashes of the words of lower-cased texts."""
    data, offs = ts.utf8(texts)
    data, cuts = ts.unicode_words(data)
    first, _, _, h = ts.words(data, offs, ts.PUNCT, cuts=cuts)
    return first, h


class Grams:
    """Inverted index of runs of ``k`` words: hash -> items."""

    def __init__(self, words: list[np.ndarray], k: int):
        grams = [ts.rolling(w, k) for w in words]
        key = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        order = np.argsort(key, kind="stable")
        self.keys, first = np.unique(key[order], return_index=True)
        self.first = np.append(first, len(key))
        self.item = item[order]
        self.bits = np.zeros(1 << 20, bool)      # fixed size: rules most words out
        self.bits[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``grams`` of seeds, and which seeds."""
        at = np.flatnonzero(self.bits[(grams >> np.uint64(44)).astype(np.int64)])
        if not len(self.keys) or not len(at):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.keys, grams[at]), len(self.keys) - 1)
        ok = self.keys[k] == grams[at]
        return at[ok], k[ok]


class Seeds(Grams):
    """Inverted index of a block of items: seed hash -> items; with ``short_items``
    ``whole`` has one more for each length below ``k``."""

    def __init__(self, ids: list[int | None], texts: list[str], k: int, short_items: bool = False):
        self.ids, self.k = ids, k
        first, h = word_hashes(pc.utf8_lower(pa.array(texts, pa.large_string())))
        self.words = [h[first[i]:first[i + 1]] for i in range(len(texts))]
        super().__init__(self.words, k)
        lengths = sorted({len(w) for w in self.words if 0 < len(w) < k}) if short_items else []
        self.whole = {n: Grams([w if len(w) == n else w[:0] for w in self.words], n) for n in lengths}


def _prefix(words: np.ndarray) -> np.ndarray:
    """acc[i] such that a run's hash is ``acc[i + n] - acc[i] * B**n``."""
    n = len(words)
    pw = np.full(n + 1, pow(_B, -1, 1 << 64), np.uint64)
    pw[0] = 1
    pw = np.multiply.accumulate(pw)
    acc = np.zeros(n + 1, np.uint64)
    np.cumsum(words * pw[:n], out=acc[1:])
    fw = np.full(n + 1, _B, np.uint64)
    fw[0] = 1
    return acc * np.multiply.accumulate(fw)


def _runs(acc: np.ndarray, marked: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of unmarked runs of ``n`` words and their hashes."""
    if len(marked) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    under = np.concatenate(([0], np.cumsum(marked)))
    at = np.flatnonzero(under[n:] == under[:-n])
    return at, acc[at + n] - acc[at] * np.uint64(pow(_B, n, 1 << 64))


def greedy_tiles(doc: np.ndarray, item: np.ndarray, k: int,
                 marked_doc: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two sequences of word hashes.

    Returns ``(doc position, item position, words)`` in the order of marking:
    the longest match over unmarked words first, ties by the item's position,
    then the document's. ``marked_doc`` words never match.
    """
    md = np.zeros(len(doc), bool) if marked_doc is None else marked_doc.copy()
    mi = np.zeros(len(item), bool)
    ad, ai = _prefix(doc), _prefix(item)
    tiles, longest = [], min(len(doc), len(item))

    def common(n):
        pd_, hd = _runs(ad, md, n)
        pi, hi = _runs(ai, mi, n)
        hit = np.flatnonzero(np.isin(hi, hd))
        return (pd_, hd, pi, hi, hit) if len(hit) else None

    while longest >= k:
        lo, hi_, best = k - 1, longest, None      # a match of lo exists, none of hi_ + 1
        while lo < hi_:
            mid = (lo + hi_ + 1) // 2
            found = common(mid)
            if found:
                lo, best = mid, found
            else:
                hi_ = mid - 1
        if best is None:
            break
        pd_, hd, pi, hi, hit = best
        order = np.argsort(hd, kind="stable")
        for j in hit.tolist():       # all matches of this length that are still free
            if mi[pi[j]:pi[j] + lo].any():
                continue
            at = int(np.searchsorted(hd[order], hi[j]))
            while at < len(order) and hd[order[at]] == hi[j]:
                p = int(pd_[order[at]])
                if not md[p:p + lo].any():
                    tiles.append((p, int(pi[j]), lo))
                    md[p:p + lo] = True
                    mi[pi[j]:pi[j] + lo] = True
                    break
                at += 1
        longest = lo
        if not common(lo):
            longest = lo - 1
    return tiles


def _contaminations(batch_texts, seeds: Seeds, min_coverage: float):
    """``(row, item, tiles)`` of a string column, in blocks of rows."""
    k = seeds.k
    low = pc.utf8_lower(batch_texts.cast(pa.large_string()))
    for lo, hi in ts.slices(ts.utf8(low)[1], SLICE_BYTES):
        first, h = word_hashes(low.slice(lo, hi - lo))
        for n, short in seeds.whole.items():
            at, seed = short.find(np.where(ts.whole_runs(first, len(h), n), ts.rolling(h, n), np.uint64(0)))
            row = np.searchsorted(first, at, "right") - 1
            _, once = np.unique(row * len(short.keys) + seed, return_index=True)       # the first place
            for r, p, s in zip(row[once].tolist(), at[once].tolist(), seed[once].tolist()):
                for i in short.item[short.first[s]:short.first[s + 1]].tolist():
                    yield lo + r, i, n, [(p - int(first[r]), 0, n)]
        grams = ts.rolling(h, k)
        grams = np.where(ts.whole_runs(first, len(h), k), grams, np.uint64(0))
        at, seed = seeds.find(grams)
        row = np.searchsorted(first, at, "right") - 1
        cut = np.flatnonzero(np.diff(row)) + 1
        for a, s in zip(np.split(at, cut), np.split(seed, cut)):
            if not len(a):
                continue
            r = int(np.searchsorted(first, a[0], "right")) - 1
            present = np.unique(s)
            # Items by how many of their seeds the document has: tiles cannot
            # cover more than k words for each.
            n = seeds.first[present + 1] - seeds.first[present]
            held = np.concatenate([seeds.item[seeds.first[x]:seeds.first[x + 1]] for x in present]
                                  ) if len(n) else present
            items, times = np.unique(held, return_counts=True)
            near = np.ones(first[r + 1] - first[r], bool)       # words outside every seed
            for j in range(k):
                near[a - first[r] + j] = False
            doc = h[first[r]:first[r + 1]]
            keep = np.flatnonzero(~near)
            # One blocked word stands between regions that do not touch.
            gap = np.flatnonzero(np.diff(keep) > 1) + 1
            words = np.insert(doc[keep], gap, 0)
            blocked = np.insert(np.zeros(len(keep), bool), gap, True)
            place = np.insert(keep, gap, -1)
            for i, t in zip(items.tolist(), times.tolist()):
                item = seeds.words[i]
                if t * k < min_coverage * len(item):
                    continue
                tiles = greedy_tiles(words, item, k, blocked)
                covered = sum(x[2] for x in tiles)
                if covered and covered >= min_coverage * len(item):
                    yield lo + r, i, covered, [(int(place[p]), q, n) for p, q, n in tiles]


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[tuple[list, list]]:
    """Items in blocks of at most ``block_words`` words (one item at least)."""
    ids, texts, held = [], [], 0
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    for item, text in items.where(F.col("text").isNotNull()).toLocalIterator():
        n = len(text) // 2 + 1
        if ids and held + n > block_words:
            yield ids, texts
            ids, texts, held = [], [], 0
        ids.append(item)
        texts.append(text)
        held += n
    if ids:
        yield ids, texts


def find_contamination(docs: DataFrame, benchmark: DataFrame, min_coverage: float = MIN_COVERAGE,
                       min_words: int = MIN_WORDS, block_words: int = BLOCK_WORDS,
                       short_items: bool = False) -> DataFrame:
    """Pairs of ``docs`` (doc_id, text) and ``benchmark`` (item_id, text) rows with
    tiles over at least ``min_coverage`` of the item's words, and their tiles."""
    spark: SparkSession = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for ids, texts in _blocks(benchmark, block_words):
        held = spark.sparkContext.broadcast(Seeds(ids, texts, min_words, short_items))

        def run(batches, held=held):
            seeds = held.value
            for b in batches:
                rows = []
                for r, i, covered, tiles in _contaminations(b.column(1), seeds, min_coverage):
                    n = len(seeds.words[i])
                    rows.append({"doc_id": b.column(0)[r].as_py(), "item_id": seeds.ids[i],
                                 "item_words": n, "covered_words": covered, "coverage": covered / n,
                                 "n_tiles": len(tiles), "longest_tile": max(x[2] for x in tiles),
                                 "tiles": [{"doc_word": p, "item_word": q, "n_words": m}
                                           for p, q, m in sorted(tiles)]})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

        part = base.mapInArrow(ts.returning(run), SCHEMA)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], SCHEMA) if out is None else out


_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_words", pa.int64()),
                    ("covered_words", pa.int64()), ("coverage", pa.float64()),
                    ("n_tiles", pa.int64()), ("longest_tile", pa.int64()),
                    ("tiles", pa.list_(pa.struct([("doc_word", pa.int64()),
                                                  ("item_word", pa.int64()),
                                                  ("n_words", pa.int64())])))])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_coverage: float = MIN_COVERAGE,
                      min_words: int = MIN_WORDS, block_words: int = BLOCK_WORDS,
                      short_items: bool = False) -> DataFrame:
    """``docs`` (all columns) without the rows whose ``text`` covers an item."""
    spark = docs.sparkSession
    out = docs
    at = docs.columns.index("text")
    for ids, texts in _blocks(benchmark, block_words):
        held = spark.sparkContext.broadcast(Seeds(ids, texts, min_words, short_items))

        def run(batches, held=held):
            for b in batches:
                bad = {x[0] for x in _contaminations(b.column(at), held.value, min_coverage)}
                if bad:
                    keep = np.ones(b.num_rows, bool)
                    keep[list(bad)] = False
                    b = b.filter(pa.array(keep))
                yield b

        out = out.mapInArrow(ts.returning(run), docs.schema)
    return out
