"""From raw documents to shards: language, near duplicates, benchmark, mixing, sharding."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attemptlog.llm import decontaminate, langid, mixing, ngram_join, sharding
from attemptlog.session import checkpoint_dir, cut_lineage

#: Documents that fit the language told for them less well are rejected; 0 is chance at any number of languages.
#: Chosen on held-out rows of sf0.1: the least of 4,990 fits is 0.93.
MIN_LANGUAGE_FIT = 0.7
#: Near duplicates share at least 80 of 100 distinct five-word shingles.
SHINGLE_WORDS, NEAR = 5, (80, 100)
N_SHARDS = 40
#: Bytes of an Arrow batch between Spark and Python, for all stages.
BATCH_BYTES = 4 << 20


def _small_batches(spark: SparkSession) -> None:
    """Rows go to Python by bytes, not by ten thousand: texts are long.  A smaller setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is told: rows without letters (also null
    texts) and rows whose n-grams do not fit the language told go.  Without any
    labelled language nothing is learned and nothing rejected but rows without letters."""
    _small_batches(spark)
    model = langid.learn_languages(docs)
    told = (langid.judge(spark, model)(F.col("text"))["fit"] >= MIN_LANGUAGE_FIT) if model.families \
        else F.col("text").rlike(r"\p{L}")
    return docs.filter(told)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: the row with the least id
    (of repeated rows with that id, one).  Rows without words are no duplicates;
    rows with a null id stay only if their group has no other."""
    _small_batches(spark)
    numbered = cut_lineage(docs.withColumn("_row", F.monotonically_increasing_id()))   # ids change with the file splits
    groups = ngram_join.ngram_components(numbered, SHINGLE_WORDS, *NEAR, doc_id="_row", also=["doc_id"])
    member = cut_lineage(groups.filter("n_shingles > 0").select(F.col("component_id").alias("_group"), "_row", "doc_id"))
    first = member.groupBy("_group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))["_row"].alias("_first"))
    gone = cut_lineage(member.join(first, "_group").filter("_row != _first").select("_row"))
    few = gone.count() <= ngram_join.BROADCAST_ROWS
    return numbered.join(F.broadcast(gone) if few else gone, "_row", "left_anti").select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove the documents that hold ten consecutive words of a benchmark item (an item of
    fewer words: all of it).  Null and empty texts hold none and stay, repeated rows go or stay
    together, an empty benchmark removes nothing."""
    _small_batches(spark)
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources meet their targets.  A document
    taken k times gives k rows.  A null source is a source; documents without words count
    nothing and take only the whole repetitions of their source; repeated rows are taken alike."""
    plan = mixing.plan_mix(mixing.measure(docs))
    own = F.struct(*[F.col(c) for c in docs.columns]).alias("_doc")     # names of the plan cannot clash
    rows = docs.select(own, F.col("source").alias("_source"), mixing.word_count(F.col("text")).alias("size"),
                       mixing.document_uid(F.col("doc_id"), F.col("text")).alias("uid"))
    taken = mixing.copies_of(rows, plan, "_source").filter("copies > 0")
    return taken.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_doc.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row; equal texts share a shard, as do null texts.  An empty table
    gives an empty result."""
    return sharding.assign_shards(docs, N_SHARDS).select("doc_id", "size", "text_crc32", "shard", "slot")


STAGES = [("language_id", identify_language), ("ngram_jaccard_join", drop_near_duplicates),
          ("benchmark_decontamination", drop_benchmark), ("mix_sources", mix_sources), ("sharding", shard)]

#: A trained classifier decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and
    read again as the next one's documents."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
