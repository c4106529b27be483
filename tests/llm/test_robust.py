"""Rows that must not be lost, and labels that must not stop a fit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trafficgraph.llm import language, minhash
from trafficgraph.llm.packing import TokenIds
from trafficgraph.llm.queries import tokenizer_path
from trafficgraph.llm.ship import prepare


def words(start, n=40):
    return " ".join(f"w{i}" for i in range(start, start + n))


@pytest.mark.parametrize("bitmap", [1, minhash.BITMAP_WORDS])
def test_texts_of_one_id_are_not_lost(spark, monkeypatch, bitmap):
    """Also with a bitmap so small that most other ids are in it."""
    monkeypatch.setattr(minhash, "BITMAP_WORDS", bitmap)
    prepare(spark)
    rows = [(1, words(0)), (1, words(500)), (2, words(500) + " end"), (3, words(900)), (3, words(900)),
            (4, words(0)), (5, words(2000)), (6, words(2000)), (None, words(0)), (None, None), (8, ""), (9, None)]
    rows += [(7, words(2000)), (7, words(3000)), (10, words(3000) + " end")]      # one text of 7 copies 5's
    rows += [(100 + i, words(5000 + 100 * i)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = [tuple(r) for r in minhash.drop_near_duplicates(df, 80).collect()]
    want = [r for r in dict.fromkeys(rows) if r[0] not in (2, 4, 6, 10)]
    assert sorted(left, key=repr) == sorted(want, key=repr)
    clash = df.limit(1).select("*", *[F.lit(1).alias(c) for c in ("kept", "_in", "_id", "rows", "kept")])
    out = minhash.drop_near_duplicates(clash, 80)
    assert out.columns == clash.columns and out.count() == 1
    assert minhash.drop_near_duplicates(df.limit(0), 80).count() == 0


def test_near_copies_meet_without_all_pairs(spark, monkeypatch):
    """A group of near copies becomes one component without its pairs; the rest is compared whole."""
    prepare(spark)
    rng = np.random.default_rng(11)
    texts = []
    for _ in range(200):
        w = [f"w{j}" for j in range(300)]
        for j in rng.choice(300, int(rng.integers(3, 7)), replace=False):
            w[j] = f"x{rng.integers(10 ** 6)}"
        texts.append(w)
    confirmed, confirm = [], minhash._confirm

    def counted(pairs, *args):
        confirmed.append(pairs.count())
        return confirm(pairs, *args)
    monkeypatch.setattr(minhash, "_confirm", counted)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, 80).collect()}
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in texts]
    want = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if want[a] != want[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((want[a], want[b]))
                want = [low if c == high else c for c in want]
    assert got == dict(enumerate(want))
    assert sum(confirmed) <= 6 * len(texts)


def linked_sets(texts, percent):
    """The smallest place reachable from each word list by links of at least ``percent``."""
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in texts]
    part = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if part[a] != part[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((part[a], part[b]))
                part = [low if c == high else c for c in part]
    return dict(enumerate(part))


def copies(rng, stem, n, low, high, words=200):
    """``n`` texts that change ``low`` to ``high`` words of one."""
    texts = []
    for _ in range(n):
        w = [f"{stem}{j}" for j in range(words)]
        for j in rng.choice(words, int(rng.integers(low, high + 1)), replace=False):
            w[j] = f"x{rng.integers(10 ** 6)}"
        texts.append(w)
    return texts


@pytest.mark.parametrize("rounds", [False, True])
def test_large_groups_need_no_rounds_of_components(spark, monkeypatch, rounds):
    """A group of near copies around a middle, and texts that share keys but no link: one pass of stars
    and one of components. Rounds made to run all the same change no component."""
    prepare(spark)
    rng = np.random.default_rng(3)
    texts = copies(rng, "w", 150, 1, 4) + copies(rng, "v", 250, 7, 9)
    order = rng.permutation(len(texts))
    texts = [texts[i] for i in order]
    if rounds:
        monkeypatch.setattr(minhash, "PAIRS_A_ROW", 0)
        monkeypatch.setattr(minhash, "LIKELY_A_ROW", 0)
    calls, confirmed, labels, confirm = [], [], minhash._labels, minhash._confirm

    def counted(pairs, *args):
        confirmed.append(pairs.count())
        return confirm(pairs, *args)
    monkeypatch.setattr(minhash, "_confirm", counted)
    monkeypatch.setattr(minhash, "_labels", lambda edges: calls.append(1) or labels(edges))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, 80).collect()}
    want = linked_sets(texts, 80)
    assert got == want and max(np.bincount(list(want.values()))) > 100
    if rounds:
        assert len(calls) > 1
    else:
        assert len(calls) == 1 and sum(confirmed) <= 2 * len(texts)


def test_flat_forest_keeps_its_components(spark):
    links = [(i, i + 1) for i in range(100, 120)] + [(i, 300) for i in range(200, 210)] + [(400, 401)]
    df = spark.createDataFrame(links, "a long, b long")
    flat = minhash._flat(df)
    assert flat.count() == len(links) and {tuple(r) for r in flat.collect()} >= {(100, 104), (117, 120), (200, 300)}
    same = [{(r["id"], r["component"]) for r in minhash._labels(x).collect()} for x in (df, flat)]
    assert same[0] == same[1]


def test_more_labels_than_languages(spark):
    prepare(spark)
    texts = [(i, f"hello world number {i}", "en") for i in range(20)]
    junk = [(100 + i, f"zz qq {i}", f"x{i:04d}") for i in range(300)]
    df = spark.createDataFrame(texts + junk, "doc_id long, text string, lang string")
    model = language.fit(df)
    assert len(model.languages) == language.MAX_LANGUAGES and "en" in model.languages
    assert model.languages == sorted(model.languages)


def test_encoder_equals_tokenizer_on_hard_texts():
    encode = TokenIds(tokenizer_path("byte_bpe_50k.json"))
    import numpy as np
    for text in ["", " ", "a  b", "\n\n a\tb", "it's we'LL 'S don't", "x" * 5000, "é" * 300 + " ü", "1234567 89",
                 "日本語 text", "a b", "  lead", "trail  ", "</s>", "<|endoftext|>", "$$%%&& ...", "A1b2 C3"]:
        ids = encode.tok.encode(text, add_special_tokens=False).ids
        assert encode(text) == np.array(ids, "<u4").tobytes(), text
