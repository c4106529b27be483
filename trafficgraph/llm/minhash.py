"""Near-duplicate texts: banded MinHash, odd sketches, confirmation on full sets.

A text's set holds the hashes of its distinct runs of five words (words: runs of
anything but white space, A-Z as a-z); a shorter text's whole sequence is its
only element. Texts are linked when their Jaccard similarity reaches the
threshold.

1. One pass gives every text its set's size and digest, the keys of its MinHash
   bands, and its odd sketch: its ``BOTTOM`` smallest values under one more
   permutation (bottom-k MinHash samples) folded into a bitmap of parities.
   Two sketches differ in at most as many bits as their samples differ in
   elements, and in nearly as many at high similarities. Samples of sets of
   at most ``BOTTOM`` elements are the sets themselves: there the XOR
   population count rules pairs out with certainty and almost exactly.
2. Texts of one set become one numbered class, so copies never meet.
3. Classes that share a band key meet one class of the key only (a star, not all
   pairs): the one with the most others over all its keys, the middle of a group of near
   copies. Sizes and sketches rule candidates out, full sets confirm the nearest one
   left for each class, and the trees of links are components.
4. While keys whose classes are still in different components have many likely pairs for
   their rows (judged by those that meet in a round), rounds of stars join them first:
   each class outside its key's largest component meets one class of that component and
   one of the others by key, and the nearest likely one of all its keys is confirmed. What
   a round makes grows with the rows of the keys, so a large group of near copies becomes
   one component without its pairs.
5. What is open then pairs the classes outside the key's largest component with those
   of other components, again ruled out and confirmed alike. No candidate is dropped:
   every pair that shares a key is either in one component or was compared.

With 30 bands of 6 samples a pair at the threshold of 0.85 shares no key with
probability 7e-7; sketches rule out no linked pair of at most ``BOTTOM``
elements, and longer ones beyond six standard deviations only.

Full sets are computed again for the texts that have likely partners, rather
than stored for all. The same plan holds at every size: a bitmap of the ids' hashes,
at most ``BITMAP_WORDS`` rows of 64 bits, is broadcast, and only texts whose bit is
set are shuffled to the join with the ids themselves; dropping texts goes alike.
The bitmap rules out no id that is in it, and the join decides. Joins on a text with
many partners are left to adaptive execution to split.

Defined cases: null, empty and blank texts have empty sets (size 0), link with
nothing and are kept; rows with a null id link with nothing, have no
component, and are kept; repeated rows share
their component (``drop_near_duplicates`` leaves one of the rows of an id and text);
texts of one id are judged each by their own set;
an empty table gives no rows; other columns are ignored or kept.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficgraph.llm import textscan as ts
from trafficgraph.operators.components import connected_components
from trafficgraph.operators.materialize import drop_table, write_table
from trafficgraph.operators.skew import DEFAULT_HOT_ROWS, hot_keys, salted_join

SHINGLE = 5
SIMILARITY = 85              # percent
BANDS, ROWS = 30, 6
SAMPLES = BANDS * ROWS
BOTTOM = 1024                # bottom-k samples folded into the sketch
SKETCH_WORDS = 16            # 64-bit words of the parity bitmap
SKETCH_BITS = 64 * SKETCH_WORDS
PAIRS_A_ROW = 8              # pairs left for a row of their keys from which classes are joined in rounds,
LIKELY_A_ROW = 1             # where so many of them are likely
ROUND_SHARE = 0.8            # of its pairs at most are left by a round that another one follows
BITMAP_WORDS = 1 << 21       # rows of the broadcast bitmap at most, 134 million bits
SLICE_BYTES = 2 << 20
MINHASH_ROWS = 2048          # set elements hashed at a time
SKETCH = [f"s{i}" for i in range(SKETCH_WORDS)]

_rng = np.random.default_rng(20240607)
_A = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
_BAND = np.arange(1, BANDS + 1, dtype=np.uint64)


def text_sets(texts, k: int = SHINGLE):
    """The sorted distinct shingle hashes of each text, in order."""
    data, offs = ts.utf8(texts)
    for lo, hi in ts.slices(offs, SLICE_BYTES):
        o = offs[lo:hi + 1] - offs[lo]
        first, _, _, h = ts.words(data[offs[lo]:offs[hi]], o)
        grams = ts.rolling(h, k)
        for r in range(hi - lo):
            a, z = int(first[r]), int(first[r + 1])
            if z - a >= k:
                yield np.unique(grams[a:z - k + 1])
            elif z > a:      # marked with its length, so it equals no longer run
                yield ts.mix(ts.rolling(h[a:z], z - a) + np.uint64(z - a))
            else:
                yield np.zeros(0, np.uint64)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """``SAMPLES`` minima of a set under affine permutations of 32-bit hashes."""
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(h), MINHASH_ROWS):
        block = np.multiply.outer(h[i:i + MINHASH_ROWS], _A)
        block += _B
        np.minimum(best, block.min(axis=0), out=best)
    return best


def band_keys(samples: np.ndarray) -> np.ndarray:
    key = _BAND.copy()
    for col in samples.reshape(BANDS, ROWS).T:
        key = ts.mix(key * np.uint64(0x9E3779B97F4A7C15) + col)
    return key.view(np.int64)


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """Parity bitmap of a sorted set's smallest hashes: each flips one bit."""
    bit = (ts.mix(shingles[:BOTTOM]) & np.uint64(SKETCH_BITS - 1)).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=SKETCH_BITS) & 1).astype(np.uint8)).view(np.int64)


def expected_bits(differ: float) -> float:
    """Expected XOR population count of sketches whose samples differ in so many elements."""
    return SKETCH_BITS / 2 * (1 - math.exp(-2 * differ / SKETCH_BITS))


def most_bits_of_long(similarity: int) -> int:
    """XOR count that linked sets of more than ``BOTTOM`` elements stay below.

    Their samples differ most where one set holds the other: then a share of
    ``1 - similarity`` of either sample. Added are six standard deviations of
    the sampling and of the sketch.
    """
    j, m = similarity / 100, SKETCH_BITS
    differ = 2 * BOTTOM * (1 - j)
    slope = math.exp(-2 * differ / m)
    sampled = 2 * math.sqrt(BOTTOM * j * (1 - j)) * slope
    sketched = m / 4 * (1 - slope ** 2) - differ * slope ** 2
    return math.ceil(expected_bits(differ) + 6 * math.sqrt(sampled ** 2 + max(sketched, 0)))


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, n, set_hi, set_lo, keys, s0..s15`` of ``docs`` (doc_id, text)."""
    names = ["doc_id", "n", "set_hi", "set_lo", "keys", *SKETCH]

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                n, sets, keys, sketch = [], [], [], []
                for s in text_sets(part.column(1)):
                    n.append(len(s))
                    sets.append(_digest(s))
                    keys.append(band_keys(minhash(s)) if len(s) else np.zeros(0, np.int64))
                    sketch.append(odd_sketch(s))
                sets, sketch = np.array(sets), np.array(sketch)
                first = np.concatenate(([0], np.cumsum([len(x) for x in keys])))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(sets[:, 0]), pa.array(sets[:, 1]),
                     pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(np.concatenate(keys))),
                     *(pa.array(np.ascontiguousarray(sketch[:, i])) for i in range(SKETCH_WORDS))], names)

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(ts.returning(run), "doc_id long, n long, set_hi long, set_lo long, keys array<long>, "
                        + ", ".join(f"{c} long" for c in SKETCH)))


def _bits(a: str, b: str) -> Column:
    """Bits in which two sketches differ."""
    return sum((F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in SKETCH), F.lit(0))


def _likely(a: str, b: str, similarity: int) -> Column:
    """Pairs whose sizes allow the similarity and whose sketches do not rule it out.

    Linked sets differ in at most ``(1 - J) / (1 + J)`` of the sum of their sizes.
    """
    differ = _bits(a, b)
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    short = differ * (100 + similarity) <= (100 - similarity) * (na + nb)
    return ((100 * F.least(na, nb) >= similarity * F.greatest(na, nb))
            & F.when(F.greatest(na, nb) <= BOTTOM, short)
            .otherwise(differ <= most_bits_of_long(similarity)))


def _in_bitmap(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` with ``_in``: false only for rows whose id is not in ``ids`` (doc_id).

    A broadcast of at most ``BITMAP_WORDS`` rows whatever the number of ids; the rows of
    ``docs`` stay where they are.
    """
    def place(col):
        return F.pmod(F.xxhash64(F.col(col).cast("long")), F.lit(64 * BITMAP_WORDS))

    def bit(at):
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))

    words = (ids.select(F.shiftright(place("doc_id"), 6).alias("_word"), bit(place("doc_id")).alias("_bit"))
             .groupBy("_word").agg(F.bit_or("_bit").alias("_bits")))
    held = docs.withColumn("_word", F.shiftright(place("doc_id"), 6)).join(F.broadcast(words), "_word", "left")
    seen = F.coalesce("_bits", F.lit(0).cast("long")).bitwiseAND(bit(place("doc_id"))) != 0
    return held.withColumn("_in", F.col("doc_id").isNotNull() & seen).drop("_word", "_bits")


def _digest(shingles: np.ndarray) -> np.ndarray:
    return np.frombuffer(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), np.int64)


def _confirm(pairs: DataFrame, docs: DataFrame, classes: DataFrame, similarity: int) -> DataFrame:
    """The ``pairs`` (a, b) of classes whose full sets reach the similarity."""
    ids, _ = write_table(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(classes, "cls")
                         .select("cls", F.col("id").alias("doc_id"), "set_hi", "set_lo"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    wanted = (_in_bitmap(texts, ids).where("_in").join(ids, "doc_id")
              .select("cls", "set_hi", "set_lo", "text"))

    def sets(batches):
        for b in batches:
            hi, lo = b.column(1).to_numpy(), b.column(2).to_numpy()
            # Other texts of the id belong to other classes.
            found = [s.tobytes() if tuple(_digest(s)) == (hi[i], lo[i]) else None
                     for i, s in enumerate(text_sets(b.column(3)))]
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], ["id", "shingles"])
            yield out.filter(out.column(1).is_valid())

    full, _ = write_table(wanted.mapInArrow(ts.returning(sets), "id long, shingles binary"))

    def linked(batches):
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column(2), b.column(3))):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * both >= similarity * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep))

    with_b = pairs.join(full.select(F.col("id").alias("b"), F.col("shingles").alias("_sb")), "b")
    both = with_b.join(full.select(F.col("id").alias("a"), F.col("shingles").alias("_sa")), "a")
    return write_table(both.select("a", "b", "_sa", "_sb").mapInArrow(ts.returning(linked), "a long, b long").distinct())[0]


def _labels(edges: DataFrame) -> DataFrame:
    return connected_components(edges, "a", "b", keys=(), vertex="id", component="component")


def _nearest(near: DataFrame) -> DataFrame:
    """Of the likely pairs ``_of, _c, _far`` the nearest ``_c`` of each ``_of``."""
    return near.groupBy("_of").agg(F.min(F.struct("_far", "_c"))["_c"].alias("_c"))


def _judged(met: DataFrame, marks: DataFrame, similarity: int) -> DataFrame:
    """``_of, _c`` of ``met`` with whether they are ``_likely``, and how ``_far`` their sketches are."""
    a, b = marks.alias("a"), marks.alias("b")
    return (met.join(a, F.col("_of") == F.col("a.id")).join(b, F.col("_c") == F.col("b.id"))
            .select("_of", "_c", _likely("a", "b", similarity).alias("_likely"),
                    (_bits("a", "b") / (F.col("a.n") + F.col("b.n"))).alias("_far")))


def _flat(links: DataFrame) -> DataFrame:
    """The links (a, b) of a forest, each class ``a`` to the one above it, with ``b`` the class
    four links up, or the last one before: the same components, mostly stars."""
    for _ in range(2):
        above = links.select(F.col("a").alias("_b"), F.col("b").alias("_top"))
        links = (links.join(above, F.col("b") == F.col("_b"), "left")
                 .select("a", F.coalesce("_top", "b").alias("b")))
    return write_table(links)[0]


def _joined_in_rounds(members: DataFrame, marks: DataFrame, links: DataFrame, tried: DataFrame, docs: DataFrame,
                      classes: DataFrame, similarity: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``(links, tried, rest, every)``: links and tried pairs (a, b) of all rounds, the rows of
    keys whose classes are in several components yet, with sketches (``key, id, component, ..``),
    and those of them outside their key's largest component (and ``_main``, that component).

    ``links`` come as a forest, nearly flat. A round lets every class outside its key's
    largest component meet one class of that component and one of the others, dealt
    anew by a hash, and confirms the nearest likely one: its rows grow with the keys'
    rows. Rounds go on while the likely pairs left are many for the rows, as far as those
    that met show, and the pairs get fewer.
    """
    labels, before, turn, spent = links.select(F.col("a").alias("id"), F.col("b").alias("component")), None, 0, []
    while True:
        placed, placed_path = write_table(members.select("key", "id").join(labels, "id", "left")
                                .select("key", "id", F.coalesce("component", "id").alias("component")))
        # Anew in every round: one class of the largest component and one of the others.
        dealt = F.struct(F.xxhash64("key", "id", F.lit(turn)).alias("_at"), F.col("id"), F.col("component"))
        by_part = placed.groupBy("key", "component").agg(F.count("*").alias("_n"), F.min(dealt).alias("_y"))
        open_keys, open_path = write_table(
            by_part.groupBy("key").agg(F.max(F.struct("_n", "component", "_y")).alias("_main"),
                                       F.count("*").alias("_parts"), F.sum("_n").alias("_all"))
            .where(F.col("_parts") > 1)
            .select("key", F.col("_main.component").alias("_main"), F.col("_main._y").alias("_y"), "_all",
                    (F.col("_all") - F.col("_main._n")).alias("_rest")))
        outside, outside_path = write_table(
            placed.join(open_keys.select("key", "_main", "_y"), "key").where(F.col("component") != F.col("_main")))
        for path in spent:          # this round's tables stand for the last one's
            drop_table(placed.sparkSession, path)
        spent = [placed_path, open_path, outside_path]
        still = placed.join(open_keys, "key", "left_semi")
        left = open_keys.agg(F.sum(F.col("_all").cast("double") * F.col("_rest")).alias("pairs"),
                             F.sum("_all").alias("rows")).first()
        done = links, tried, outside.drop("_y").join(marks, "id"), still.join(marks, "id")
        if (not left["rows"] or left["pairs"] <= PAIRS_A_ROW * left["rows"]
                or before is not None and left["pairs"] > ROUND_SHARE * before):
            return done
        before, turn = left["pairs"], turn + 1
        other = outside.groupBy("key").agg(F.min(dealt).alias("_x"))
        met = (outside.select("key", F.col("id").alias("_of"), "component", "_y").join(other, "key")
               .select("_of", "component", F.explode(F.array("_x", "_y")).alias("_c"))
               .where(F.col("_c.component") != F.col("component"))
               .select("_of", F.col("_c.id").alias("_c")).distinct())
        judged, judged_path = write_table(_judged(met, marks, similarity))
        spent.append(judged_path)
        found = judged.agg(F.count("*").alias("met"), F.count(F.when(F.col("_likely"), 1)).alias("likely")).first()
        if left["pairs"] * found["likely"] <= LIKELY_A_ROW * left["rows"] * found["met"]:
            return done
        pairs, _ = write_table(_nearest(judged.where("_likely"))
                               .select(F.least("_of", "_c").alias("a"), F.greatest("_of", "_c").alias("b")).distinct())
        links = links.unionByName(_confirm(pairs, docs, classes, similarity))
        tried = tried.unionByName(pairs)
        members, labels = still, _labels(links)


def near_duplicate_sets(docs: DataFrame, similarity: int = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """``(signatures, sets)``: the written signatures (``doc_id, n, set_hi, set_lo``) and, for
    every non-empty set, ``set_hi, set_lo, copies, component`` (smallest id reachable)."""
    signed, _ = write_table(signatures(docs))
    known = signed.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes, _ = write_table(known.groupBy("set_hi", "set_lo")
                             .agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"))
                             .withColumn("cls", F.monotonically_increasing_id()))     # fixed by the table
    # One row for each class, with the band keys and sketch of its smallest document. From
    # here to the links ``id`` is the class's number.
    leaders = (known.join(classes.select("set_hi", "set_lo", F.col("id").alias("doc_id"), "cls"),
                          ["set_hi", "set_lo", "doc_id"])
               .select(F.col("cls").alias("id"), "n", "keys", *SKETCH))
    banded = leaders.select("id", F.explode("keys").alias("key"))
    shared = (banded.groupBy("key").agg(F.min("id").alias("_low"), F.max("id").alias("_high"), F.count("*").alias("_n"))
              .where(F.col("_low") < F.col("_high")).select("key", "_n"))
    members, _ = write_table(banded.join(shared, "key").distinct())          # key, id, _n
    sketches = leaders.drop("keys").dropDuplicates(["id"])
    marks, _ = write_table(sketches.join(members.groupBy("id").agg(F.sum("_n").alias("_met")), "id"))

    # The centre of a key is the class that meets the most others over all its keys: every link
    # of a star leads to a class that meets more, so the links are a forest.
    centres = (members.join(marks.select("id", "_met"), "id").groupBy("key")
               .agg(F.max(F.struct("_met", "id"))["id"].alias("_c")))
    stars = (members.join(centres, "key").where(F.col("id") != F.col("_c"))
             .select(F.col("id").alias("_of"), "_c").distinct())
    near = _judged(stars, marks, similarity).where("_likely")
    first, _ = write_table(_nearest(near).select(F.col("_of").alias("a"), F.col("_c").alias("b")))
    links = _flat(_confirm(first, docs, classes, similarity))
    tried = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    links, tried, rest, every = _joined_in_rounds(members, marks, links, tried, docs, classes, similarity)
    a, b = rest.alias("a"), every.alias("b")
    # Both in the rest: once; one of them in the main component: from the other.
    once = (F.col("b.component") == F.col("a._main")) | (F.col("a.id") < F.col("b.id"))
    more = (a.join(b, (F.col("a.key") == F.col("b.key"))
                      & (F.col("a.component") != F.col("b.component")) & once
                      & _likely("a", "b", similarity))
            .select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).distinct())
    more, _ = write_table(more.join(tried, ["a", "b"], "left_anti"))
    if more.limit(1).count():
        links = links.unionByName(_confirm(more, docs, classes, similarity))
    parts, _ = write_table(classes.join(_labels(links).withColumnRenamed("id", "cls"), "cls", "left")
                           .select("cls", "id", "set_hi", "set_lo", "copies",
                                   F.coalesce("component", "cls").alias("_part")))
    lowest, _ = write_table(parts.groupBy("_part").agg(F.min("id").alias("component"), F.count("*").alias("_n")))
    n_hot = lowest.where(F.col("_n") > DEFAULT_HOT_ROWS).limit(1).count()
    hot = hot_keys(lowest, ["_part"], "_n") if n_hot else None
    sets = (salted_join(parts, lowest.drop("_n"), ["_part"], hot, ["cls"])
            .select("set_hi", "set_lo", "copies", "component"))
    return signed.select("doc_id", "n", "set_hi", "set_lo"), write_table(sets)[0]


def near_duplicates(docs: DataFrame, similarity: int = SIMILARITY,
                    hot_rows: int = DEFAULT_HOT_ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs`` (doc_id, text)."""
    signed, sets = near_duplicate_sets(docs, similarity)
    key = ["set_hi", "set_lo"]
    n_hot = sets.where(F.col("copies") > hot_rows).limit(1).count()
    hot = hot_keys(sets, key, "copies", hot_rows) if n_hot else None
    joined = salted_join(signed, sets.select(*key, "component"), key, hot, ["doc_id"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                         F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """``docs`` (all columns) with one row of each component: its smallest id.

    Rows equal in id and text are one; rows of one id with different texts stay or go
    together, and stay while one of the texts does."""
    names = docs.columns
    own = [c if c in ("doc_id", "text") else f"_c{i}" for i, c in enumerate(names)]   # no name clashes with ours
    plain = docs.toDF(*own)
    judged, _ = write_table(near_duplicates(plain, similarity).select("doc_id", "kept")
                            .where(F.col("doc_id").isNotNull()).groupBy("doc_id")
                            .agg(F.max("kept").alias("kept"), F.count("*").alias("rows")))
    # Ids to decide on: those that go, and repeated ones, which stay while one of their texts does.
    odd, _ = write_table(judged.where(~F.col("kept") | (F.col("rows") > 1))
                         .select(F.col("doc_id").alias("_id"), "kept"))
    marked = _in_bitmap(plain, odd.select(F.col("_id").alias("doc_id")))
    free = marked.where(~F.col("_in")).drop("_in")
    met = marked.where("_in").drop("_in")
    met = met.join(odd, met["doc_id"].cast("long") == odd["_id"], "left")
    alone = met.where(F.col("_id").isNull()).select(*own)
    again = met.where("kept").select(*own).dropDuplicates(["doc_id", "text"])
    return free.select(*own).unionByName(alone).unionByName(again).toDF(*names)
