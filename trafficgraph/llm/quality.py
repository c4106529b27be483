"""Quality of documents: a document classifier combined with site posteriors.

Hierarchical empirical Bayes. A logistic classifier on a few measures of the
whole text (letter case, repetition, symbols, word lengths) gives each document
a probability of being good. Sites are hosts and paths below them. A host's
posterior is the Beta mean of its documents (a label where there is one, the
classifier's probability elsewhere) under a prior with the global mean; a
path's posterior has its host's mean as prior. The strengths of both priors
come from the spread between sites (method of moments), so sparse sites shrink
towards their host and the global mean. A document's quality adds its own
log-odds, relative to the global mean, to the log-odds of its path.

Sites come from grouped aggregation with map-side sums; sites with very many
documents are split by a salt when they are joined back. The classifier is
fitted on about ``max_labelled`` labelled ids at most (a hash share of
them, one row an id); site counts cover all documents.

Defined cases: a null text counts as empty, which has measures of its own;
null hosts and paths count as empty strings; several labels of one document
are averaged; a null label is no label; repeated rows each count; without
labels of both kinds the classifier gives every document the share of good
labels (0.5 without any); an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficgraph.llm import textscan as ts
from trafficgraph.operators.materialize import write_table
from trafficgraph.operators.skew import DEFAULT_HOT_ROWS, hot_keys, salted_join

MAX_LABELLED = 20_000
_SHARES = 1 << 30            # steps of the sample's share
MIN_QUALITY = 0.5
MIN_STRENGTH, MAX_STRENGTH = 5.0, 1e6
RIDGE = 1.0
SLICE_BYTES = 2 << 20
FEATURES = ("log_words", "word_length", "upper", "digits", "stops", "symbols", "pipes", "lines",
            "same_as_last", "same_as_before_last", "distinct", "capital_words", "non_ascii")


def _class(values: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(values)] = True
    return t


_UPPER = _class(range(65, 91))
_DIGIT = _class(range(48, 58))
_STOP = _class(b".,;:?'\"-")
_LETTER = _class([*range(65, 91), *range(97, 123)])
_SYMBOL = ~(_LETTER | _DIGIT | _STOP | ts.SPACES | _class(range(128, 256)) | _class(b"|"))
_LINE, _PIPE, _HIGH = _class(b"\n"), _class(b"|"), _class(range(128, 256))


def features(texts: pa.Array) -> np.ndarray:
    """One row of measures for each text."""
    data, offs = ts.utf8(texts)
    out = np.zeros((len(texts), len(FEATURES)))
    for lo, hi in ts.slices(offs, SLICE_BYTES):
        d, o = data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        first, start, end, h = ts.words(d, o)
        n = np.diff(first)
        size = np.maximum(np.diff(o), 1)
        many = np.maximum(n, 1)
        row = np.repeat(np.arange(hi - lo), n)

        def share(table, d=d, o=o, size=size):
            total = np.concatenate(([0], np.cumsum(table[d])))
            return (total[o[1:]] - total[o[:-1]]) / size

        def repeats(k, h=h, row=row, many=many, m=hi - lo):
            same = (h[k:] == h[:-k]) & (row[k:] == row[:-k])
            return np.bincount(row[k:][same], minlength=m) / many

        order = np.lexsort((h, row))
        fresh = np.ones(len(h), bool)
        fresh[1:] = (np.diff(h[order]) != 0) | (np.diff(row[order]) != 0)
        out[lo:hi] = np.stack([
            np.log1p(n), np.bincount(row, end - start, hi - lo) / many / 10,
            share(_UPPER), share(_DIGIT), share(_STOP), share(_SYMBOL), share(_PIPE), share(_LINE),
            repeats(1), repeats(2), np.bincount(row[order][fresh], minlength=hi - lo) / many,
            np.bincount(row, _UPPER[d[start]], hi - lo) / many, share(_HIGH)], axis=1)
    return out


@dataclass
class Classifier:
    """Logistic model on standardised measures."""
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weight + self.bias
        return np.clip(1 / (1 + np.exp(-np.clip(z, -30, 30))), 1e-4, 1 - 1e-4)


def fit_classifier(x: np.ndarray, y: np.ndarray) -> Classifier:
    """Ridge logistic regression by Newton steps; a constant if labels are of one kind."""
    k = len(FEATURES)
    share = float(np.clip(y.mean(), 1e-4, 1 - 1e-4)) if len(y) else 0.5
    if not len(y) or y.min() == y.max():
        return Classifier(np.zeros(k), np.ones(k), np.zeros(k), float(np.log(share / (1 - share))))
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = np.column_stack([np.clip((x - mean) / scale, -8, 8), np.ones(len(x))])
    w = np.zeros(k + 1)
    pull = np.append(np.full(k, RIDGE), 1e-6)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pull),
                               z.T @ (y - p) - pull * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return Classifier(mean, scale, w[:-1], float(w[-1]))


def _labels(labels: DataFrame) -> DataFrame:
    return (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
            .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
            .agg(F.avg(F.col("quality").cast("double")).alias("label")))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Classifier:
    """Classifier fitted on about ``max_labelled`` labelled ids at most."""
    # All ids, or a hash share of them: at most about max_labelled pairs of numbers, small
    # enough to broadcast at any size, and no task meets those of all partitions.
    known = _labels(labels)
    n = known.count()
    if n > max_labelled:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(_SHARES)) < _SHARES * max_labelled // n)
    chosen = F.broadcast(known)
    sample = (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
              .join(chosen, "doc_id").select("doc_id", "label", "text"))

    def measure(batches):
        for b in batches:
            x = features(b.column(2))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1])
                 .cast(pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    measured = sample.mapInArrow(ts.returning(measure), "doc_id long, label double, x array<double>")
    # One row an id, the smallest of its texts' measures: repeated ids bring no more rows.
    rows = (measured.groupBy("doc_id").agg(F.min(F.struct("label", "x")).alias("_row"))
            .select("doc_id", "_row.*").toPandas().sort_values("doc_id"))
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(FEATURES))
    return fit_classifier(x, (rows["label"].to_numpy() >= 0.5).astype(float))


def _with_probability(docs: DataFrame, model: Classifier, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` (``_host`` and ``_path`` among them) and ``_p``."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep)
    at, kept = docs.columns.index("text"), [docs.columns.index(c) for c in docs.columns if c in keep]

    def run(batches):
        for b in batches:
            p = model.probability(features(b.column(at)))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), pa.array(p)],
                                             [*(b.schema.names[i] for i in kept), "_p"])

    return docs.mapInArrow(ts.returning(run), f"{fields}, _p double")


def _sited(docs: DataFrame, host: str | Column, path: str | Column) -> DataFrame:
    col = lambda c: F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))
    return docs.withColumns({"_host": col(host), "_path": col(path)})


@dataclass
class Sites:
    """Posteriors of all paths (``_host, _path, _site, _n``), and the global mean."""
    paths: DataFrame
    mean: float
    host_strength: float
    path_strength: float


def _strength(groups: DataFrame, centre: Column) -> float:
    """Beta prior strength from the spread of group rates about ``centre``
    (``n, good`` columns): method of moments, from one row of sums."""
    n, rate = F.col("n"), F.col("good") / F.col("n")
    r = groups.agg(F.sum(n).alias("n"), F.sum(n * n).alias("nn"), F.count("*").alias("k"),
                   F.sum(n * (rate - centre) * (rate - centre)).alias("between"),
                   F.sum(n * centre * (1 - centre)).alias("binomial")).first()
    if not r["n"] or r["k"] < 2:
        return MAX_STRENGTH
    spread = r["binomial"] / r["n"]
    free = r["n"] - r["nn"] / r["n"]
    tau = (r["between"] - (r["k"] - 1) * spread) / max(free, 1e-9)
    if tau <= spread / MAX_STRENGTH:
        return MAX_STRENGTH
    return float(min(max(spread / tau - 1, MIN_STRENGTH), MAX_STRENGTH))


def site_posteriors(scored: DataFrame, labels: DataFrame) -> Sites:
    """Posteriors from ``scored`` (doc_id, _host, _path, _p) by grouped sums."""
    value = F.coalesce("label", "_p")
    counts, _ = write_table(scored.join(_labels(labels), "doc_id", "left")
                            .groupBy("_host", "_path").agg(F.count("*").alias("n"),
                                                           F.sum(value).alias("good")))
    total = counts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    mean = float(np.clip(total["good"] / total["n"], 1e-4, 1 - 1e-4)) if total["n"] else 0.5
    hosts = counts.groupBy("_host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    s_host = _strength(hosts, F.lit(mean))
    hosts = hosts.select("_host", ((F.col("good") + s_host * mean) / (F.col("n") + s_host)).alias("_m"))
    paths = counts.join(hosts, "_host")
    s_path = _strength(paths, F.col("_m"))
    paths, _ = write_table(paths.select(
        "_host", "_path", F.col("n").alias("_n"),
        ((F.col("good") + s_path * F.col("_m")) / (F.col("n") + s_path)).alias("_site")))
    return Sites(paths, mean, s_host, s_path)


def _quality(p: Column, site: Column, mean: float) -> Column:
    odds = lambda x: F.log(x / (1 - x))
    z = odds(p) - F.lit(float(np.log(mean / (1 - mean)))) + odds(site)
    return 1 / (1 + F.exp(-z))


def score_documents(docs: DataFrame, labels: DataFrame, host: str | Column = "source",
                    path: str | Column = "lang", max_labelled: int = MAX_LABELLED,
                    hot_rows: int = DEFAULT_HOT_ROWS, keep_columns: bool = False) -> DataFrame:
    """Quality of ``docs`` (doc_id, text, and the columns or expressions of their host and
    path) from ``labels`` (doc_id, quality): ``p_document, p_site, quality`` after ``doc_id``,
    or after all columns of ``docs``."""
    sited = _sited(docs, host, path)
    model = train(docs, labels, max_labelled)
    narrow = sited.select(F.col("doc_id").cast("long").alias("doc_id"),
                          F.col("text").cast("string").alias("text"), "_host", "_path")
    scored = _with_probability(narrow, model, ["doc_id", "_host", "_path"])
    if not keep_columns:
        scored, _ = write_table(scored)
    sites = site_posteriors(scored, labels)
    if keep_columns:        # texts are read again rather than shuffled
        scored = _with_probability(sited, model, sited.columns)
    n_hot = sites.paths.where(F.col("_n") > hot_rows).limit(1).count()
    hot = hot_keys(sites.paths, ["_host", "_path"], "_n", hot_rows) if n_hot else None
    out = salted_join(scored, sites.paths.select("_host", "_path", "_site"), ["_host", "_path"],
                      hot, ["doc_id"], "left")
    names = docs.columns if keep_columns else ["doc_id"]
    return out.select(*names, F.col("_p").alias("p_document"), F.col("_site").alias("p_site"),
                      _quality(F.col("_p"), F.col("_site"), sites.mean).alias("quality"))


def keep_good(docs: DataFrame, labels: DataFrame, min_quality: float = MIN_QUALITY, **options) -> DataFrame:
    """``docs`` (all columns) whose quality is ``min_quality`` or more."""
    own = [f"_c{i}" for i in range(len(docs.columns))]      # names of docs never clash with ours
    plain = {"doc_id", "text", options.get("host", "source"), options.get("path", "lang")}
    named = docs.toDF(*[c if c in plain else o for c, o in zip(docs.columns, own)])
    out = score_documents(named, labels, keep_columns=True, **options)
    return out.where(F.col("quality") >= min_quality).select(*named.columns).toDF(*docs.columns)
