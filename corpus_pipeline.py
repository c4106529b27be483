"""A corpus pipeline over ``documents``: each stage calls one operator of ``trafficgraph.llm``.

Stages take ``(spark, docs, sf_dir)`` and return a DataFrame that ``run``
writes as Parquet below ``spark.checkpoint.dir`` and reads again as the next
stage's documents. All but the last return the columns of ``documents``.

1. ``language``: texts without letters, or whose language covers too few of the
   letters that some language can have, go; without labelled rows all stay.
2. ``quality``: texts whose quality, combined from classifier and sites, is low, go.
3. ``near_duplicates``: one document of each component of a similarity of 0.8 or more stays.
4. ``decontamination``: texts that hold a benchmark passage, or a short item whole, go.
5. ``packing``: what is left becomes pieces of token windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trafficgraph.llm import decontamination, language, minhash, packing, quality
from trafficgraph.llm.queries import tokenizer_path
from trafficgraph.llm.ship import prepare
from trafficgraph.operators.materialize import drop_table, write_table

MIN_LANGUAGE_SHARE = 0.35
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 2500
SIMILARITY = 80              # percent; the query op9_minhash has its own


def _start(spark: SparkSession) -> None:
    """Ship the package, and hand texts to Python in smaller batches: stages follow each other in
    executors whose heap has grown, so what Python holds at once counts."""
    prepare(spark)
    if spark.conf.get(BATCH_CONF) == "10000":        # Spark's default: nothing else was asked for
        spark.conf.set(BATCH_CONF, str(BATCH_ROWS))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; the model learns from the rows of ``docs`` itself."""
    _start(spark)
    model = language.fit(docs.where(~language.held_out()))
    return language.keep_known(docs, model, MIN_LANGUAGE_SHARE)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _start(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _start(spark)
    return minhash.drop_near_duplicates(docs, SIMILARITY)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _start(spark)
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"),
                                             short_items=True)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _start(spark)
    return packing.with_digest(packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json")))


STAGES = [("language", language_stage), ("quality", quality_stage),
          ("near_duplicates", near_duplicate_stage), ("decontamination", decontamination_stage),
          ("packing", packing_stage)]

# Language models, classifiers, tilings and tokenizers are beyond SQL: the
# pipeline is tested against plain Python versions of its stages instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; the last one's rows."""
    _start(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs, path = write_table(stage(spark, docs, sf_dir))
        if before:
            drop_table(spark, before)      # one stage's copy of the corpus is enough
        before = path
    return docs
