"""URL filters: fixed site rules, then association rules; DataFrame functions only.

Site rules are ``(host, path, verdict)``: a rule fits its host and all
subdomains when the url's path starts with the rule's; the longest wins. Urls
without one get the method's verdict. Spark's FP-growth mines combinations of
url tokens (host labels, path parts, query keys) that go with bad labels;
rules are pruned by support, confidence and lift. At any size a rule needs
``MIN_COUNT`` bad urls (more where these are less than ``LEAST_SUPPORT`` of the
labelled urls, which bounds the combinations); rules rarer than ``min_support``
must beat the share of bad labels by ``MIN_DEVIATIONS`` standard deviations, so that
chance makes none of many rare combinations. Tokens that always occur together among
the labelled urls (equal counts and 128-bit sums of their urls' hashes) are mined
as one group: any of them stands for it, as rules of each alone would be as
confident, and mining time does not double with each. A rule is dropped where a rule of
fewer of its groups is as confident. A url is blocked if it holds a token of every
group of a rule. Matching goes by an inverted index: each rule stands under
the tokens of its rarest group, distinct token sets are looked up there and checked,
so neither urls nor a common token meet all rules. Token sets of very many urls
are split by a salt when their verdict is joined back.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; path: then up to ``?``, ``#`` or the end.

Defined cases: a null url, or one without ``://``, has an empty host and path,
no site rule and no tokens, and is allowed; ties of equally long site rules go
to the first in alphabetical order; repeated rows are judged each; without
labelled urls no rules are mined; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficgraph.operators.materialize import write_table
from trafficgraph.operators.skew import DEFAULT_HOT_ROWS, hot_keys, salted_join

ALLOW, BLOCK = "allow", "block"
MIN_SUPPORT = 0.01
MIN_COUNT = 20               # bad urls that a rule rests on at least
LEAST_SUPPORT = 1e-5
MIN_DEVIATIONS = 5.0
MIN_CONFIDENCE = 0.6
MIN_LIFT = 1.5
_BAD = "label:bad"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)$"


def _part(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, group), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(_part(url, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return _part(url, 2)


def url_tokens(url: Column) -> Column:
    """Sorted distinct tokens of a url: ``h:`` labels of the host, ``p:`` words of the path
    and ``q:`` keys of the query; tokens of digits alone name pages and are left out."""
    def tokens(prefix: str, text: Column, pattern: str) -> Column:
        kept = F.filter(F.split(F.lower(text), pattern), lambda t: t.rlike("[^0-9]"))
        return F.transform(kept, lambda t: F.concat(F.lit(prefix), t))
    query = F.regexp_extract(_part(url, 3), r"(?s)^\?([^#]*)", 1)
    keys = F.regexp_replace(query, r"=[^&]*", "")
    return F.array_sort(F.array_distinct(F.concat(
        tokens("h:", host_of(url), r"[.:@]"), tokens("p:", path_of(url), r"[^\p{L}\p{N}]+"),
        tokens("q:", keys, "&"))))


def site_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """``struct<rule, verdict>`` of the longest site rule that fits, else null."""
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    held = F.array(*[F.struct(F.lit(h.lower()).alias("host"), F.lit(p).alias("path"),
                              F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))
                     for h, p, v in ordered])
    fits = F.filter(held, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"])))
                    & F.startswith(path, r["path"]))
    first = F.get(fits, F.lit(0))
    return F.when(first.isNotNull(), F.struct(first["rule"].alias("rule"), first["verdict"].alias("verdict")))


def least_support(n: int) -> float:
    """Support mined at ``n`` labelled urls; half an url less, so that rounding raises no count."""
    return max((MIN_COUNT - 0.5) / n, LEAST_SUPPORT)


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT,
               min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT) -> DataFrame:
    """Rules ``groups, confidence, support, anchors`` from ``labelled`` (url, bad): arrays of
    tokens that always occur together, and the rarest of them."""
    spark = labelled.sparkSession
    known = labelled.where(F.col("bad").isNotNull()).select(url_tokens(F.col("url")).alias("tokens"), "bad")
    n = known.count()
    least = least_support(n) if n else 2.0
    if least > 1:
        return spark.sql("SELECT array(array('')) AS groups, 0D AS confidence, 0D AS support, array('') AS anchors LIMIT 0")
    # A token of every url adds nothing to any combination; rarer ones than the support
    # cannot be in a rule. Sums of hashes tell which tokens have the same urls.
    sets = known.groupBy("tokens").agg(F.count("*").alias("_n"))
    each = sets.select("_n", F.explode("tokens").alias("token"),
                       *(F.pmod(F.xxhash64(F.lit(i), "tokens"), F.lit(1 << 62)).cast("decimal(38,0)").alias(f"_h{i}")
                         for i in range(2)))
    useful = (each.groupBy("token").agg((F.sum("_n") / n).alias("share"), *(F.sum(f"_h{i}").alias(f"_h{i}") for i in range(2)))
              .where((F.col("share") < 1) & (F.col("share") >= least)))
    groups, _ = write_table(useful.groupBy("share", "_h0", "_h1").agg(F.array_sort(F.collect_list("token")).alias("group"))
                            .select("share", "group", F.col("group")[0].alias("token")))
    # Items of a token set: the first tokens of its groups.
    named = (sets.select("tokens", F.explode("tokens").alias("token")).join(groups.select("token"), "token")
             .groupBy("tokens").agg(F.collect_list("token").alias("_items")))
    bad = F.when(F.col("bad"), F.array(F.lit(_BAD))).otherwise(F.array().cast("array<string>"))
    items = known.join(named, "tokens", "left").select(
        F.concat(F.coalesce("_items", F.array().cast("array<string>")), bad).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=min_confidence).fit(items)
    base = F.col("confidence") / F.col("lift")
    deviations = (F.col("confidence") - base) / F.sqrt(
        base * (1 - base) / (F.col("support") / F.col("confidence") * n))
    rules, _ = write_table(
        model.associationRules.where((F.col("consequent")[0] == _BAD) & (F.col("lift") >= min_lift))
        .where((F.col("support") >= min_support) | (deviations >= MIN_DEVIATIONS))
        .select(F.array_sort("antecedent").alias("tokens"), "confidence", "support"))
    # The rarest group of each rule, and rules that a part of their groups makes needless.
    index = rules.select("*", F.explode("tokens").alias("token"))
    anchors = (index.join(groups, "token").groupBy("tokens")
               .agg(F.min(F.struct("share", "token", "group")).alias("_a"), F.collect_list("group").alias("groups"))
               .select("tokens", F.col("_a.token").alias("_first"), F.col("_a.group").alias("anchors"),
                       F.array_sort("groups").alias("groups")))
    rules = rules.join(anchors, "tokens")
    wider = (index.join(rules.select(F.col("_first").alias("token"), F.col("tokens").alias("_part"),
                                     F.col("confidence").alias("_c")), "token")
             .where((F.size("_part") < F.size("tokens")) & (F.col("_c") >= F.col("confidence"))
                    & (F.size(F.array_except("_part", "tokens")) == 0))
             .select("tokens").distinct())
    return (rules.join(wider, "tokens", "left_anti")
            .select("groups", "confidence", "support", "anchors"))


def blocked_sets(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct ``tokens`` of ``urls`` that hold a token of every group of a rule, and
    their ``urls``."""
    sets = urls.groupBy("tokens").agg(F.count("*").alias("urls"))
    looked_up = sets.select("tokens", "urls", F.explode("tokens").alias("anchor"))
    return (looked_up.join(rules.select("groups", F.explode("anchors").alias("anchor")), "anchor")
            .where(F.forall("groups", lambda g: F.arrays_overlap(g, "tokens")))
            .groupBy("tokens").agg(F.first("urls").alias("urls")))


def judge_urls(pages: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str, str]],
               hot_rows: int = DEFAULT_HOT_ROWS, **mining) -> DataFrame:
    """``page_id, host, path, rule, verdict, mined`` of every row of ``pages`` (page_id, url).

    ``labelled`` (url, bad) are the urls to mine; ``rules`` the site rules.
    ``mined`` is the association rules' own verdict.
    """
    url = F.col("url").cast("string")
    read = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"),
                        url_tokens(url).alias("tokens"))
    hits, _ = write_table(blocked_sets(read, mine_rules(labelled, **mining)))
    n_hot = hits.where(F.col("urls") > hot_rows).limit(1).count()
    hot = hot_keys(hits, ["tokens"], "urls", hot_rows) if n_hot else None
    judged = salted_join(read, hits.select("tokens", F.lit(True).alias("_hit")), ["tokens"], hot, ["page_id"], "left")
    fixed = site_rule(F.col("host"), F.col("path"), rules)
    mined = F.when(F.coalesce("_hit", F.lit(False)), BLOCK).otherwise(ALLOW)
    return (judged.withColumn("_site", fixed)
            .select("page_id", "host", "path", F.col("_site.rule").alias("rule"),
                    F.coalesce("_site.verdict", mined).alias("verdict"), mined.alias("mined")))
