"""Operators against plain Python versions on small fixtures, and their defined edge cases."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trafficgraph.llm import (chat, decontamination, embeddings, language, licenses, minhash,
                              packing, quality, tokencounts, urlfilter)
from trafficgraph.llm import textscan as ts
from trafficgraph.llm.queries import ORACLE, QUERIES, SITE_RULES, tokenizer_path

DATA = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, _p string, key string, n long"
EDGE_TEXTS = [(1, None), (2, ""), (3, "  \n\t"), (4, "one two"), (4, "one two"), (None, "the of and to in a b c"),
              (None, None), (6, "x" * 300_000), (7, "word " * 40_000), (8, "!!! ??? 123"), (9, "漢字 かな"),
              (10, "a" * 5 + " " * 5000 + "b")]


@pytest.fixture(scope="module")
def edge_docs(spark):
    """Nulls, empties, repeated rows, very long texts, and columns whose names clash."""
    return spark.createDataFrame([(i, t, None, None, None, "x", "y", 1) for i, t in EDGE_TEXTS], DOC)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def rows(df):
    return [r.asDict() for r in df.collect()]


# -- 1 licenses ---------------------------------------------------------------

def test_license_spans(spark):
    mit = licenses.TEMPLATES["MIT"]
    cut = " ".join(mit.split()[:-6])                                  # most of the template
    changed = mit.replace("without restriction", "with no limits at all")
    texts = {1: "Before. " + mit + " After.", 2: changed, 3: cut, 4: " ".join(mit.split()[:20]),
             5: "é released UNDER the mit license. And again: Released under the MIT License.",
             6: "Released under nothing."}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = collections.defaultdict(list)
    for r in rows(licenses.scan_licenses(df)):
        got[r["doc_id"]].append(r)
    assert [x["coverage"] for x in got[1] if x["license"] == "MIT"] == [1.0]
    full = next(x for x in got[1] if x["license"] == "MIT")
    assert texts[1][full["char_start"]:full["char_end"]] == mit.rstrip(".")
    assert 0.9 < next(x for x in got[2] if x["license"] == "MIT")["coverage"] < 1
    assert 0.8 <= next(x for x in got[3] if x["license"] == "MIT")["coverage"] < 1
    assert 4 not in got and 6 not in got
    assert [texts[5][x["char_start"]:x["char_end"]] for x in got[5]] == [
        "released UNDER the mit license", "Released under the MIT License"]


def test_every_license_line_has_a_row(spark):
    """Against alignments of every template with the whole text, without fingerprints or band."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.where("text LIKE '%icense%'").select("doc_id", "text").collect()}
    lines = {"MIT License": "MIT-line", "CC BY-NC 4.0": "CC-BY-NC-short", "Apache License": "Apache-2.0-line",
             "GNU General Public License, version 3": "GPL-line"}
    got = collections.defaultdict(set)
    for r in rows(licenses.scan_licenses(docs)):
        got[r["doc_id"]].add(r["license"])
    assert texts and set(got) == set(texts)
    index = licenses.Index(licenses.TEMPLATES)
    for doc, text in texts.items():
        words, best = ts.hash_words([text], ts.PUNCT)[0], []
        for name, template in zip(index.names, index.words):
            matched, _, _, a, z = licenses.align(template, words, 0, len(words) + len(template)) or [0] * 5
            if matched >= 0.8 * len(template):
                best.append((len(template) + z - a - 2 * matched, -matched, name))
        assert min(best)[2] in got[doc]
        assert {name for line, name in lines.items() if line in text} == got[doc]


def test_license_variants_are_told_apart(spark):
    """Every template's own text reports it whole, no other version or variant, and an
    opening alone never as the whole notice."""
    names = list(licenses.TEMPLATES)
    df = spark.createDataFrame(list(enumerate(licenses.TEMPLATES.values())), "doc_id long, text string")
    got = collections.defaultdict(dict)
    for r in rows(licenses.scan_licenses(df)):
        got[names[r["doc_id"]]][r["license"]] = r["coverage"]
    for name in names:
        assert got[name][name] == 1.0
        for other in got[name]:
            family = other.removesuffix("-opening").removesuffix("-line")
            assert other == name or name.startswith(family) or (name[:3], family) == ("BSD", "BSD"), (name, other)
        if name.endswith("-opening") and name != "MPL-2.0-opening":      # its rest is one address
            assert name.removesuffix("-opening") not in got[name]


@given(st.lists(st.integers(0, 3), min_size=1, max_size=12), st.lists(st.integers(0, 3), min_size=1, max_size=12))
@settings(max_examples=60, deadline=None)
def test_wide_band_equals_smith_waterman(a, b):
    m, n = len(a), len(b)
    s = np.zeros((m + 1, n + 1), int)
    for i, j in itertools.product(range(1, m + 1), range(1, n + 1)):
        s[i, j] = max(0, s[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), s[i - 1, j] - 1, s[i, j - 1] - 1)
    got = licenses.align(np.array(a, np.uint64), np.array(b, np.uint64), 0, m + n)
    if s.max() == 0:
        assert got is None
    else:
        matched, i0, i1, t0, t1 = got
        # the span's own best score is the best of all
        assert matched * 2 >= s.max() and 0 <= i0 < i1 <= m and 0 <= t0 < t1 <= n


def test_winnowing_finds_any_five_shared_words():
    rng = np.random.default_rng(0)
    for _ in range(200):
        shared = rng.integers(0, 1 << 60, 5, dtype=np.uint64)
        x, y = (np.concatenate([rng.integers(0, 1 << 60, rng.integers(0, 9), dtype=np.uint64), shared,
                                rng.integers(0, 1 << 60, rng.integers(0, 9), dtype=np.uint64)]) for _ in range(2))
        gx, gy = ts.rolling(x, licenses.GRAM), ts.rolling(y, licenses.GRAM)
        assert set(gx[licenses.winnow(gx)]) & set(gy[licenses.winnow(gy)])


# -- 2 token counts -----------------------------------------------------------

@pytest.fixture(scope="module")
def unigram():
    from tokenizers import Tokenizer, models, normalizers
    vocab = tokencounts.read_vocabulary(tokenizer_path("piece_bpe_32k.model"))
    tok = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    tok.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    return vocab, tok


def test_counts_equal_the_tokenizer(spark, documents, unigram):
    vocab, tok = unigram
    got = {r["doc_id"]: r["n_tokens"] for r in rows(tokencounts.count_tokens(
        documents, tokenizer_path("piece_bpe_32k.model")))}
    for r in documents.collect():
        assert got[r["doc_id"]] == len(tok.encode(r["text"] or "").ids), r["doc_id"]


@given(st.lists(st.sampled_from(["a", "th", "ing", " ", "  ", "▁", "é", "漢", "\n", "😀", "<s>", "<0x0A>", "\\"]),
                max_size=25).map("".join))
@settings(max_examples=150, deadline=None)
def test_hostile_texts_count_alike(text):
    from tokenizers import Tokenizer, models, normalizers
    if not _COUNTER:
        vocab = tokencounts.read_vocabulary(tokenizer_path("piece_bpe_32k.model"))
        tok = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
        tok.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
        _COUNTER.append((tokencounts.Counter(vocab), tok))
    counter, tok = _COUNTER[0]
    assert counter(text)[0] == len(tok.encode(text).ids)


_COUNTER: list = []


@given(st.text(alphabet="abc ", max_size=10))
@settings(max_examples=80, deadline=None)
def test_ties_and_unknown_runs(text):
    from tokenizers import Tokenizer, models, normalizers
    vocab = [("<unk>", 0.0), ("▁", -2.0), ("a", -1.0), ("aa", -2.0), ("▁a", -3.0), ("ba", -2.0), ("▁b", -3.0)]
    tok = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=False))
    tok.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    assert tokencounts.Counter(vocab)(text)[0] == len(tok.encode(text).ids)


# -- 3 language ---------------------------------------------------------------

def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(1)
    for _ in range(40):
        n = rng.integers(0, 6, 5)
        row = np.concatenate(([0], np.cumsum(n)))
        scores = (rng.normal(size=(row[-1], 3)) * 3).astype(np.float32)
        got = language.viterbi(scores, row, 2.0)
        for a, z in zip(row[:-1], row[1:]):
            def value(path):
                return sum(scores[a + i, p] for i, p in enumerate(path)) - 2 * sum(
                    x != y for x, y in zip(path, path[1:]))
            if z > a:
                best = max(map(value, itertools.product(range(3), repeat=z - a)))
                assert value(got[a:z]) == pytest.approx(best, abs=1e-4)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", language.held_out())
    model = language.fit(docs.where(~F.col("held_out")))
    got = {r["doc_id"]: r["lang_pred"] for r in rows(language.predict(docs, model))}
    test = [r for r in docs.where("held_out").select("doc_id", "lang").collect()]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in test)
    assert np.mean([got[r["doc_id"]] == r["lang"] for r in test]) > 0.97


def test_spans_of_mixed_text_and_scripts(spark):
    en, de, ru = "the house and the garden of the king", "das haus und der garten des kaisers", "дом и сад короля"
    train = spark.createDataFrame([(1, " ".join([en] * 3), "en"), (2, " ".join([de] * 3), "de"),
                                   (3, ru, "ru"), (4, "x", None)], "doc_id long, text string, lang string")
    model = language.fit(train)
    assert model.languages == ["de", "en", "ru"]
    text = f"{en}. {de} 12 {ru}"
    df = spark.createDataFrame([(1, text), (2, "漢字"), (3, "42"), (4, None)], "doc_id long, text string")
    spans = sorted(rows(language.label_spans(df, model)), key=lambda r: (r["doc_id"], r["span"]))
    assert [(r["lang"], text[r["char_start"]:r["char_end"]]) for r in spans if r["doc_id"] == 1] == [
        ("en", en), ("de", de), ("ru", ru)]
    assert [r["lang"] for r in spans if r["doc_id"] == 2] == ["und"]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows(language.predict(df, model))}
    assert [got[i] for i in (2, 3, 4)] == [("und", 0.0)] * 3


def test_texts_of_unlearned_scripts_have_a_language_and_stay(spark, scratch):
    import corpus_pipeline as cp
    en, de, ru = "the house and the garden of the king", "das haus und der garten des kaisers", "дом и сад короля"
    texts = [(1, " ".join([en] * 3), "en"), (2, " ".join([de] * 3), "de"), (3, " ".join([en] * 2), "en"),
             (4, " ".join([de] * 2), "de"), (5, ru, None), (6, "漢字", None), (7, en + " " + " ".join([ru] * 5), None),
             (8, "42 !", None), (9, None, None), (10, "", None)]
    schema = "doc_id long, text string, lang string"
    df = spark.createDataFrame(texts, schema)
    model = language.fit(df)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows(language.predict(df, model, compete=True))}
    assert all(got[i][0] in ("de", "en") and got[i][1] == 0 for i in (5, 6))
    assert got[7][0] == "en" and 0 < got[7][1] < cp.MIN_LANGUAGE_SHARE
    assert [got[i] for i in (8, 9, 10)] == [("und", 0.0)] * 3
    old = {r["doc_id"]: r["lang_pred"] for r in rows(language.predict(df, model))}
    assert all(old[i] == got[i][0] for i in (1, 2, 3, 4, 7))
    kept = language.keep_known(df, model, cp.MIN_LANGUAGE_SHARE)
    assert sorted(r["doc_id"] for r in rows(kept)) == [1, 2, 3, 4, 5, 6, 7]
    none = df.withColumn("lang", F.lit(None).cast("string"))
    assert cp.language_stage(spark, none, DATA).count() == len(texts)
    df.write.parquet(f"{scratch}/documents.parquet")
    queried = rows(QUERIES["op3_language"](spark, scratch))
    assert {r["doc_id"] for r in queried if r["lang_pred"] == "und"} == {8, 9, 10}


# -- 4 embeddings -------------------------------------------------------------

def brute_links(data, least):
    """``{row: (links, component)}`` by all pairs."""
    n = len(data)
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
          and lab is not None and i is not None for i, v, lab in data]
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    links = [0] * n
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and data[i][2] == data[j][2] and len(data[i][1]) == len(data[j][1]):
                a, b = np.array(data[i][1], float), np.array(data[j][1], float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= least:
                    links[i] += 1
                    parent[find(i)] = find(j)
    small = {}
    for i in range(n):
        if ok[i]:
            small[find(i)] = min(small.get(find(i), data[i][0]), data[i][0])
    return [(data[i][0], links[i], small[find(i)] if ok[i] else data[i][0]) for i in range(n)]


@pytest.mark.parametrize("block", [7, 1024])
def test_grid_join_equals_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", block)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    data = [(i, (centres[rng.integers(12)] + 0.12 * rng.normal(size=8)).astype(np.float32).tolist(), int(i % 3 == 0))
            for i in range(150)]
    data += [(200 + i, data[3][1], data[3][2]) for i in range(40)]            # copies
    data += [(300, None, 1), (301, [0.0] * 8, 1), (302, [float("nan")] + [1.0] * 7, 1), (303, data[0][1], None),
             (304, data[0][1][:4], 1), (305, [], 1), (306, [float("inf")] * 8, 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").repartition(5)
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in rows(embeddings.similar_vectors(df)))
    assert got == sorted(brute_links(data, 0.93))
    extra = df.limit(0).withColumn("id", F.lit(1)).withColumn("copies", F.lit(2))
    assert embeddings.similar_vectors(extra).count() == 0


# -- 5 decontamination --------------------------------------------------------

def plain_tiles(doc, item, k):
    """Greedy string tiling by comparing all positions; covered words."""
    md, mi, tiles = [False] * len(doc), [False] * len(item), []
    while True:
        best = (0,)
        for q, p in itertools.product(range(len(item)), range(len(doc))):
            n = 0
            while (q + n < len(item) and p + n < len(doc) and item[q + n] == doc[p + n]
                   and not mi[q + n] and not md[p + n]):
                n += 1
            if n > best[0]:
                best = (n, q, p)
        if best[0] < k:
            return tiles
        n, q, p = best
        tiles.append((p, q, n))
        md[p:p + n] = [True] * n
        mi[q:q + n] = [True] * n


@given(st.lists(st.integers(1, 3), max_size=25), st.lists(st.integers(1, 3), max_size=14))
@settings(max_examples=120, deadline=None)
def test_tiles_equal_plain_tiling(doc, item):
    got = decontamination.greedy_tiles(np.array(doc, np.uint64), np.array(item, np.uint64), 2)
    assert sorted(got) == sorted(plain_tiles(doc, item, 2))


def test_reordered_passages_are_caught(spark):
    words = [f"w{i}" for i in range(30)]
    item = " ".join(words)
    moved = " ".join(words[15:] + ["x", "y"] + words[:15])
    docs = spark.createDataFrame([(1, f"Pre {item} post"), (2, "A " + moved.upper()), (3, " ".join(words[:12])),
                                  (4, None), (5, ""), (6, " ".join(words[::-1])), (None, item), (1, item)],
                                 "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "w0 w1"), (7, item)], "item_id long, text string")
    got = sorted((r["doc_id"] or 0, r["item_id"], r["coverage"], r["n_tiles"]) for r in rows(
        decontamination.find_contamination(docs, bench)))
    assert got == [(0, 7, 1.0, 1)] * 2 + [(1, 7, 1.0, 1)] * 4 + [(2, 7, 1.0, 2)] * 2
    blocks = decontamination.find_contamination(docs, bench, block_words=5)      # one item a block
    assert sorted((r["doc_id"] or 0, r["item_id"], r["coverage"], r["n_tiles"]) for r in rows(blocks)) == got
    kept = decontamination.drop_contaminated(docs, bench)
    assert sorted(r["doc_id"] for r in rows(kept)) == [3, 4, 5, 6]
    assert decontamination.find_contamination(docs, bench.limit(0)).count() == 0
    assert decontamination.drop_contaminated(docs.limit(0), bench).count() == 0


def test_words_of_all_scripts_and_short_items(spark):
    zh, ja, th = "今天天气很好，我们去公园。", "猫がすきです。毎日あそびます", "วันนี้อากาศดีมาก"
    curly = "it’s a “plain” test—of words and more"
    plain = "it's a \"plain\" test - of words\u00a0and more"
    docs = spark.createDataFrame([(1, f"前文{zh}后文"), (2, f"x {ja} y"), (3, f"ก{th}ข"), (4, plain.upper()),
                                  (5, "ΤΟ ΣΠΙΤΙ ΤΟΥ ΑΝΘΡΩΠΟΥ ΕΙΝΑΙ ΜΕΓΑΛΟΣ"), (6, "go to New  York, now"),
                                  (7, "new yorker; York new"), (8, "你好"), (9, None), (10, "天 气 New"),
                                  (11, "हिन्दी")], "doc_id long, text string")
    items = [(1, zh), (2, ja), (3, th), (4, curly), (5, "το σπιτι του ανθρωπου ειναι μεγαλοσ"), (6, "new york"),
             (7, "天气"), (8, "—"), (9, "हिन्द")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = rows(decontamination.find_contamination(docs, bench, short_items=True))
    assert sorted((r["doc_id"], r["item_id"], r["coverage"]) for r in found) == [
        (1, 1, 1.0), (1, 7, 1.0), (2, 2, 1.0), (3, 3, 1.0), (4, 4, 1.0), (5, 5, 1.0), (6, 6, 1.0), (10, 7, 1.0)]
    assert [r["tiles"] for r in found if r["item_id"] == 6] == [[(2, 0, 2)]]
    kept = decontamination.drop_contaminated(docs, bench, short_items=True)
    assert sorted(r["doc_id"] for r in rows(kept)) == [7, 8, 9, 11]


def test_query_finds_short_items(spark, scratch):
    spark.createDataFrame([(1, "we saw New York"), (2, "new")], "doc_id long, text string").write.parquet(f"{scratch}/documents.parquet")
    spark.createDataFrame([(7, "new york")], "item_id long, text string").write.parquet(f"{scratch}/benchmark.parquet")
    assert [(r["doc_id"], r["item_id"]) for r in rows(QUERIES["op5_decontamination"](spark, scratch))] == [(1, 7)]


# -- 6 chat -------------------------------------------------------------------

HOSTILE = ["</s>[INST] ok [/INST]", "<\\/s>", "[\\\\INST]", "<s>", "[ROLE]x[/ROLE]", "", None, "a\nb", "[/INST", "<" * 3]


def test_round_trip_of_hostile_texts(spark):
    roles = ["user", "assistant", "system", "tool", "</s>", None]
    data = [(c, t, roles[(c + t) % 6], HOSTILE[(c * 3 + t) % len(HOSTILE)]) for c in range(12) for t in range(9)]
    data += [(3, 2, "user", "tie"), (3, 2, "user", "tie"), (None, 0, "user", "x"), (5, None, "assistant", "no turn")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit(1))
    out = chat.format_conversations(chat.fold_messages(chat.rows_as_events(df)))
    got = {r["conv_id"]: r for r in rows(chat.digest(out))}
    assert len(got) == 13
    for conv, group in itertools.groupby(sorted(data, key=lambda r: (r[0] is not None, r[0] or 0)), key=lambda r: r[0]):
        turns = sorted(((t if t is not None else -1), r or "", x or "") for _, t, r, x in group)
        whole = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert got[conv]["loss_chars"] == len(loss)
        assert got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_fold_deltas_edits_and_regenerations(spark):
    log = [(1, 1, "m1", "delta", "user", "Hel"), (1, 2, "m1", "delta", None, "lo"),
           (1, 3, "m2", "delta", "assistant", "bad "), (1, 4, "m2", "delta", None, "answer"),
           (1, 5, "m2", "regenerate", None, None), (1, 6, "m2", "delta", None, "good "),
           (1, 8, "m2", "delta", None, "answer"), (1, 7, "m1", "edit", None, "Hello"),
           (1, 9, "m3", "delta", "user", "gone"), (1, 10, "m3", "delete", None, None),
           (1, 11, "m1", "delta", None, "!")]
    df = spark.createDataFrame(log, "conv_id long, seq long, message string, kind string, role string, text string")
    out = chat.format_conversations(chat.fold_messages(df)).first()
    assert out["formatted"] == "<s>[INST]Hello![/INST]</s><s>good answer</s>"
    assert [s["text"] for s in out["segments"] if s["loss"]] == ["good answer"]
    assert chat.format_conversations(chat.fold_messages(df.limit(0))).count() == 0


def test_chat_query_runs_no_python(spark):
    text = QUERIES["op6_chat_formatting"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text


# -- 7 url filter -------------------------------------------------------------

def test_site_rules(spark):
    cases = {"HTTP://WWW.Example.COM/en/x?a=b#c": ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
             "x://a.example.com/en/": ("a.example.com", "/en/", "example.com/en/", "block"),
             "x://xexample.com/en/": ("xexample.com", "/en/", "com/", "allow"),
             "x://example.com": ("example.com", "", None, "allow"),
             "x://b.net/fr/1?q=://": ("b.net", "/fr/1", "net/fr/", "block"),
             "x://b.net/FR/1": ("b.net", "/FR/1", None, "allow"),
             "a://b://c/d": ("b:", "//c/d", None, "allow"), "://h#f": ("h", "", None, "allow"),
             "no url": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow")}
    df = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id long, url string")
    df = df.withColumn("tokens", F.lit("clash"))
    got = urlfilter.judge_urls(df, df.select("url", F.lit(True).alias("bad")).limit(0), SITE_RULES)
    by = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows(got)}
    assert [by[i] for i in range(len(cases))] == list(cases.values())


def test_mined_rules_match_by_all_tokens(spark):
    urls = [f"http://{h}.example.net/{p}/{i}" for i, (h, p) in enumerate(
        itertools.product(["blog", "www", "m"], ["fr", "en", "pills"])) for _ in range(20)]
    bad = [("blog" in u and "/fr/" in u) or "pills" in u for u in urls]
    labelled = spark.createDataFrame(list(zip(urls, bad)), "url string, bad boolean")
    mined = {tuple(map(tuple, r["groups"])): r["confidence"] for r in rows(urlfilter.mine_rules(labelled, min_confidence=0.9))}
    assert mined == {(("p:pills",),): 1.0, (("h:blog",), ("p:fr",)): 1.0}       # needless longer rules are gone
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in rows(
        urlfilter.judge_urls(pages, labelled, [], min_confidence=0.9))}
    assert [got[i] == "block" for i in range(len(urls))] == bad
    text = urlfilter.judge_urls(pages, labelled, SITE_RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text


def test_hosts_below_the_share_are_mined(spark):
    """A host of 0.9 % of the labelled urls, all bad; another as rare whose labels are as all others'."""
    hosts = ["spam"] * 27 + ["rare"] * 27 + ["few"] * 9 + ["www"] * 2937
    labelled = [(f"http://{h}.example.net/p/{i}", h in ("spam", "few") or i % 5 == 0) for i, h in enumerate(hosts)]
    assert 27 < urlfilter.MIN_SUPPORT * len(labelled)
    df = spark.createDataFrame(labelled, "url string, bad boolean")
    assert [r["groups"] for r in rows(urlfilter.mine_rules(df))] == [[["h:spam"]]]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(labelled)], "page_id long, url string")
    got = rows(urlfilter.judge_urls(pages, df, []))
    assert {r["host"] for r in got if r["verdict"] == "block"} == {"spam.example.net"}
    # Support by count: 20 bad urls at any size, a share from two million labelled urls on.
    assert [urlfilter.least_support(n) * n for n in (10, 500, 10_000, 1_000_000, 10_000_000)] == pytest.approx(
        [19.5, 19.5, 19.5, 19.5, 100])


def plain_rules(labelled, least_bad, min_confidence, min_lift):
    """Minimal token sets of bad urls, by every subset of every bad url's tokens."""
    n, bad = len(labelled), [t for t, b in labelled if b]
    share = len(bad) / n
    every = set.intersection(*(set(t) for t, _ in labelled))
    found = {}
    for size in range(1, max(len(t) for t in bad) + 1):
        for combo in {c for t in bad for c in itertools.combinations(sorted(set(t) - every), size)}:
            hits = sum(set(combo) <= set(t) for t in bad)
            c = hits / sum(set(combo) <= set(t) for t, _ in labelled)
            if hits >= least_bad and c >= min_confidence and c >= min_lift * share:
                found[combo] = c
    return {r: c for r, c in found.items()
            if not any(set(p) < set(r) and found[p] >= c for p in found)}


def test_rules_equal_a_plain_miner(spark):
    rng = np.random.default_rng(8)
    urls = [f"http://{rng.choice(['a', 'b', 'c'])}.site.org/{rng.choice(['x', 'y'])}/{rng.choice(['s', 't', 'u'])}"
            + ("?k=1&l=2&m=3" if rng.random() < 0.4 else "") for _ in range(600)]
    bad = [bool(("//a." in u and "/x/" in u or "/t?k" in u) and rng.random() < 0.9 or rng.random() < 0.05) for u in urls]
    df = spark.createDataFrame(list(zip(urls, bad)), "url string, bad boolean")
    tokens = [r[0] for r in df.select(urlfilter.url_tokens(F.col("url"))).collect()]
    mined = rows(urlfilter.mine_rules(df))
    # A rule stands for one token of each of its groups.
    got = {tuple(sorted(c)): pytest.approx(r["confidence"]) for r in mined for c in itertools.product(*r["groups"])}
    want = plain_rules(list(zip(tokens, bad)), urlfilter.MIN_COUNT, urlfilter.MIN_CONFIDENCE, urlfilter.MIN_LIFT)
    assert want == got and any(len(g) == 3 for r in mined for g in r["groups"])
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    blocked = [any(set(c) <= set(t) for c in want) for t in tokens]
    for hot in (1, 1_000_000):              # hot token sets are split
        judged = {r["page_id"]: r["verdict"] for r in rows(urlfilter.judge_urls(pages, df, [], hot_rows=hot))}
        assert [judged[i] == "block" for i in range(len(urls))] == blocked


def test_few_bad_urls_make_no_rule_and_constant_keys_are_one_group(spark):
    few = [(f"http://h{i % 4}.org/p/{'z' if i < 19 else 'q'}", i < 19) for i in range(90)]
    df = spark.createDataFrame(few, "url string, bad boolean")
    assert rows(urlfilter.mine_rules(df)) == []
    keys = "&".join(f"utm{chr(97 + i)}=1" for i in range(25))
    many = [(f"http://www.org/p/{i}?{keys}" if i < 60 else f"http://www.org/p/{i}", i < 60) for i in range(2500)]
    mined = rows(urlfilter.mine_rules(spark.createDataFrame(many, "url string, bad boolean")))
    assert [(len(r["groups"]), len(r["groups"][0]), r["confidence"]) for r in mined] == [(1, 25, 1.0)]
    empty = spark.createDataFrame([], "page_id long, url string")
    assert urlfilter.judge_urls(empty, df, []).count() == 0


# -- 8 quality ----------------------------------------------------------------

def test_quality_separates_labels(spark):
    d = "/root/testdata/sf0.01"
    scored = QUERIES["op8_quality"](spark, d)
    labels = spark.read.parquet(f"{d}/labels.parquet")
    joined = scored.withColumnRenamed("quality", "q").join(labels, "doc_id").select("kept", "quality").collect()
    assert np.mean([r["kept"] == bool(r["quality"]) for r in joined]) > 0.98


def test_sparse_sites_shrink(spark):
    # Equal texts: only sites tell documents apart.
    data = [(i, "the same words again", "good" if i < 200 else "bad" if i < 400 else f"s{i}", "p") for i in range(420)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(i < 200 or i % 2 == 0 and i >= 400)) for i in range(420)],
                                   "doc_id long, quality int")
    got = {r["doc_id"]: r for r in rows(quality.score_documents(docs, labels))}
    assert got[0]["quality"] > 0.9 and got[200]["quality"] < 0.1
    sparse = [got[i]["quality"] for i in range(400, 420)]
    assert all(0.1 < q < 0.9 for q in sparse) and min(sparse) < 0.5 < max(sparse)   # between, pulled both ways


def test_quality_edge_cases(spark, edge_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {round(r["quality"], 6) for r in rows(quality.score_documents(edge_docs, none))} == {0.5}
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, None), (6, 0), (7, 0), (9, 1), (None, 1)], "doc_id long, quality int")
    out = quality.score_documents(edge_docs, labels)
    assert out.count() == len(EDGE_TEXTS) and all(0 < r["quality"] < 1 for r in rows(out))
    assert quality.keep_good(edge_docs, none).columns == edge_docs.columns
    assert quality.keep_good(edge_docs, none).count() == len(EDGE_TEXTS)
    assert quality.keep_good(edge_docs.limit(0), labels).count() == 0


# -- 9 minhash ----------------------------------------------------------------

def brute_components(data, percent=85):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, t in data:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    ids = list(range(len(data)))

    def find(x):
        while ids[x] != x:
            x = ids[x]
        return x
    for i, j in itertools.combinations(range(len(data)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and data[i][0] is not None and data[j][0] is not None \
                and 100 * both >= percent * len(sets[i] | sets[j]):
            ids[find(i)] = find(j)
    small = {}
    for i, (d, _) in enumerate(data):
        if d is not None:
            small[find(i)] = min(small.get(find(i), d), d)
    return [(d, len(s), None if d is None else small[find(i)]) for i, ((d, _), s) in enumerate(zip(data, sets))]


def test_near_duplicates_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    data, n = [], 0
    for group in range(12):
        base = [f"w{rng.integers(400)}" for _ in range(int(rng.integers(3, 140)))]
        for _ in range(int(rng.integers(1, 9))):
            words = list(base)
            for _ in range(int(rng.integers(0, 1 + len(words) // 30))):       # about the threshold
                words[rng.integers(len(words))] = f"x{rng.integers(10 ** 6)}"
            data.append((n, " ".join(words)))
            n += 1
    data += [(n + i, data[0][1].upper().replace(" ", " \n")) for i in range(5)]
    data += [(500, None), (501, ""), (502, " \t"), (503, "one two"), (504, "ONE  two"), (505, "one two three"),
             (None, data[0][1]), (None, None)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4).withColumn("n", F.lit(1)).withColumn("key", F.lit("k"))
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows(minhash.near_duplicates(df))), key=repr)
    assert got == sorted(brute_components(data), key=repr)
    kept = minhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    want = {d for d, _, c in brute_components(data) if d == c and d is not None}
    assert sorted(r["doc_id"] for r in rows(kept) if r["doc_id"] is not None) == sorted(want)
    assert kept.where("doc_id IS NULL").count() == 2
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_repeated_rows_leave_one(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "z"), (3, "z")],
                               "doc_id long, text string")
    assert [r["kept"] for r in rows(minhash.near_duplicates(df).orderBy("doc_id"))] == [True, True, False, True, True]
    assert sorted(r["doc_id"] for r in rows(minhash.drop_near_duplicates(df))) == [1, 3]


def test_chain_through_different_components_is_found(spark, monkeypatch):
    # Neighbours of a chain are linked, its ends are not: later rounds must join what the stars leave.
    words = [f"w{i}" for i in range(100)]
    data = []
    for i in range(10):
        w = list(words)
        for j in range(i):
            w[j * 10] = f"x{j}"
        data.append((9 - i if i % 2 else 20 + i, " ".join(w)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows(minhash.near_duplicates(df)))
    assert got == sorted(brute_components(data))


def test_odd_sketches_bound_and_estimate_differences():
    rng = np.random.default_rng(7)

    def bits(x, y):
        return int(np.bitwise_count((minhash.odd_sketch(x) ^ minhash.odd_sketch(y)).view(np.uint64)).sum())
    for n, d in [(30, 2), (400, 40), (1000, 90), (1000, 160)]:
        seen = []
        for _ in range(40):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[d // 2:], rng.integers(0, 1 << 63, d // 2, dtype=np.uint64)]))
            seen.append(bits(a, b))
        assert max(seen) <= d and abs(np.mean(seen) - minhash.expected_bits(d)) < 4
    most = minhash.most_bits_of_long(85)
    for _ in range(40):          # long sets at the threshold: one in the other, and alike in size
        a = np.unique(rng.integers(0, 1 << 63, 6000, dtype=np.uint64))
        inner = np.sort(rng.choice(a, int(len(a) * 0.85), replace=False))
        swap = np.unique(np.concatenate([rng.choice(a, 5514, replace=False),
                                         rng.integers(0, 1 << 63, 486, dtype=np.uint64)]))
        assert bits(a, inner) <= most and bits(a, swap) <= most


# -- 10 packing ---------------------------------------------------------------

def packed(spark, df, **options):
    return packing.pack_documents(df, tokenizer_path("byte_bpe_50k.json"), **options)


def check_packing(out, texts, window=2048):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    by_seq = collections.defaultdict(list)
    for r in out:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
        assert r["length"] == len(r["ids"]) // 4 > 0
    for pieces in by_seq.values():
        at = 0
        for off, n in sorted(pieces):
            assert off == at
            at += n
        assert at <= window
    want = collections.Counter(
        (d, np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for d, t in texts)
    for d in {d for d, _ in texts}:
        own = sorted((r for r in out if r["doc_id"] == d), key=lambda r: r["start"])
        total = b"".join(r["ids"] for r in own)
        assert len(total) == sum(len(k[1]) * n for k, n in want.items() if k[0] == d)
        if sum(n for k, n in want.items() if k[0] == d) == 1:
            assert want[d, total] == 1
            assert [r["start"] for r in own] == np.concatenate(
                ([0], np.cumsum([r["length"] for r in own])[:-1])).tolist()
    return [sum(n for _, n in p) for p in by_seq.values()]


def test_packing_round_trip(spark, documents):
    full = check_packing(rows(packed(spark, documents)), [(r["doc_id"], r["text"]) for r in documents.collect()])
    padding = sum(2048 - n for n in full if n & (n - 1))
    assert padding < 0.01 * sum(full)


def test_packing_edge_cases(spark):
    texts = [(1, None), (2, ""), (3, "a  b\n\n c \t d"), (4, "x <|endoftext|> y"), (5, "漢字 😀 don't  "),
             (6, "word " * 9000), (7, "same"), (7, "same"), (None, "null id"), (8, "\x1c\u00a0 é\u0301"), (9, " lead")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("ids", F.lit(1))
    for tokens in (1 << 22, 64):
        check_packing(rows(packed(spark, df, buffer_tokens=tokens)), texts)
    assert packed(spark, df.limit(0)).count() == 0
    r = next(r for r in rows(packing.with_digest(packed(spark, df))) if r["doc_id"] == 1)
    assert r["ids_crc32"] == zlib.crc32((1).to_bytes(4, "little")) and r["doc_tokens"] == 1


@given(st.lists(st.integers(1, 16), max_size=40))
@settings(max_examples=100, deadline=None)
def test_segment_tree_equals_plain_best_fit(lengths):
    window, offset = packing.best_fit_decreasing(np.array(lengths, np.int64), 16)
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= n
        else:
            room.append(16 - n)
    got = collections.Counter()
    for w, n in zip(window.tolist(), lengths):
        got[w] += n
    assert sorted(got.values()) == sorted(16 - r for r in room)
    for w in got:
        at = 0
        for off, n in sorted((o, n) for v, o, n in zip(window.tolist(), offset.tolist(), lengths) if v == w):
            assert off == at
            at += n


# -- all ----------------------------------------------------------------------

def test_documents_operators_take_edge_cases(spark, edge_docs):
    lang = language.fit(spark.createDataFrame([(1, "the of and to in", "en")], "doc_id long, text string, lang string"))
    n = len(EDGE_TEXTS)
    assert licenses.scan_licenses(edge_docs).count() == 0
    counts = rows(tokencounts.count_tokens(edge_docs, tokenizer_path("piece_bpe_32k.model")))
    assert len(counts) == n and {r["n_tokens"] for r in counts if r["doc_id"] in (1, 2)} == {0}
    assert language.predict(edge_docs, lang).count() == n
    assert language.predict(edge_docs, language.fit(edge_docs)).where("lang_pred = 'und'").count() == n
    assert language.keep_known(edge_docs, lang).columns == edge_docs.columns
    assert minhash.near_duplicates(edge_docs).count() == n
    empty = edge_docs.limit(0)
    for out in (licenses.scan_licenses(empty), tokencounts.count_tokens(empty, tokenizer_path("piece_bpe_32k.model")),
                language.predict(empty, lang), language.label_spans(empty, lang)):
        assert out.count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_equal_their_sql(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(ORACLE[name])
    names = [c[0] for c in want.description]
    want = sorted(map(repr, want.fetchall()))
    got = QUERIES[name](spark, DATA).select(*names)
    assert sorted(repr(tuple(r)) for r in got.collect()) == want


def test_pipeline_equals_its_stages_in_plain_python(spark):
    import corpus_pipeline as cp
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    left, kept = docs, None
    for name, stage in cp.STAGES[:-1]:
        left = stage(spark, left, DATA).cache()
        assert left.columns == docs.columns
        ids = {r["doc_id"] for r in left.collect()}
        kept = ids if kept is None else kept & ids
        assert ids == kept
    texts = [(r["doc_id"], r["text"]) for r in left.collect()]
    assert len({c for _, _, c in brute_components(texts)}) == len(texts)            # no near duplicates left
    item_words = [re.findall(r"\w+", r["text"].lower()) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    for _, t in texts:
        joined = " ".join(re.findall(r"\w+", t.lower()))
        assert not any(" ".join(w) in joined for w in item_words if len(w) >= 5)
    bad = {r["doc_id"] for r in spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 0").collect()}
    assert len(bad & kept) <= 0.02 * max(len(kept), 1)
    out = rows(cp.run(spark, DATA))
    assert {r["doc_id"] for r in out} == kept
    assert {f for f in out[0]} == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}


def test_pipeline_drops_near_copies_from_80_percent(spark):
    import corpus_pipeline as cp
    words = [f"w{i}" for i in range(104)]                       # 100 shingles
    near = words[:50] + ["x", "y"] + words[52:]                 # 6 differ: 94 / 106 = 0.89
    other = [w if i not in (20, 70) else "z" for i, w in enumerate(words)]     # 10 differ: 90 / 110 = 0.82
    far = [w if i not in (15, 45, 75) else "q" for i, w in enumerate(words)]   # 15 differ: 85 / 115 = 0.74
    data = [(i, " ".join(w)) for i, w in enumerate([words, other, far])]
    data += [(i + 10, " ".join("v" + x for x in w)) for i, w in enumerate([words, near])]
    df = spark.createDataFrame(data, "doc_id long, text string")
    kept = {r["doc_id"] for r in rows(cp.near_duplicate_stage(spark, df, DATA))}
    assert kept == {d for d, _, c in brute_components(data, 80) if c == d} == {0, 2, 10}
    assert {r["doc_id"] for r in rows(minhash.drop_near_duplicates(df))} == {0, 1, 2, 10}      # op9 stays at 85
