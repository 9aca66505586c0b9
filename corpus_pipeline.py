"""A corpus from raw documents: quality, near duplicates, benchmark leaks, personal data, source weights.

Each stage takes the documents its predecessor wrote and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` applies them in order, written as Parquet and read again in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqmodel.llm import decontaminate, mixing, parity_join, pii, qda
from seqmodel.llm.ragged import SMALL_SLICE_BYTES
from seqmodel.sources.scratch import drop_since, mark, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def _small_batches(spark: SparkSession) -> None:
    """Texts go to Python workers 1 MB at a time, unless the session says how much.

    By default a batch is 10 000 rows or 64 MB, so mostly all texts of a task: the executor holds it outside its heap, in a
    buffer that doubles as it grows, and the worker holds it as well; both keep that memory in the stages after. Stages
    are run after they return, so the setting stays until ``run`` ends.
    """
    if spark.conf.get(_BATCH_BYTES, None) is None:
        spark.conf.set(_BATCH_BYTES, str(SMALL_SLICE_BYTES))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier does not reject."""
    _small_batches(spark)
    return qda.accepted(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


_LINKED = parity_join.Similarity(size=5, num=80, den=100, slack=1)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by shared five-word shingles (Jaccard 0.8) the smallest id stays.

    Rows are judged one by one where ids are null or occur twice: a row of a group stays whatever became of others of
    its id, null ids come last, and of rows of equal id and text one stays.
    """
    _small_batches(spark)
    docs = docs.select(COLUMNS)
    if not docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        return _near_duplicate_rows(docs)
    start = mark()
    groups = parity_join.linked_groups(docs, _LINKED)
    copies = written(groups.where("component_id <> doc_id").select("doc_id").distinct(), "copies", lookup=True)
    del groups
    drop_since(spark, start, copies)
    return docs.join(copies, "doc_id", "left_anti").select(COLUMNS)


def _near_duplicate_rows(docs: DataFrame) -> DataFrame:
    start = mark()
    named = docs.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(docs.where("doc_id is null"))
    rows = written(named.withColumn("__row", F.monotonically_increasing_id()), "document-rows")
    groups = parity_join.linked_groups(rows.select("__row", "text"), _LINKED, id_col="__row").select("__row", "component_id")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), "__row")
    first = groups.join(rows.select("__row", place.alias("place")), "__row").groupBy("component_id").agg(F.min("place").alias("place"))
    kept = written(first.select(F.col("place.__row").alias("__row")), "kept", lookup=True)
    del groups, first
    drop_since(docs.sparkSession, start, rows, kept)
    return rows.join(kept, "__row", "left_semi").select(COLUMNS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become surrogates; ``n_chars`` follows the new text."""
    _small_batches(spark)
    rows = pii.with_surrogates(docs.select(COLUMNS), key="pii-surrogates-1", count_col="__replaced")
    changed = F.when(F.col("__replaced") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return rows.withColumn("n_chars", changed).select(COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every time a document is read, with its place in the training order; each is read at least once."""
    return mixing.mixed(docs.select(COLUMNS), mixing.Mixture(budget=None))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
]

#: The classifier, the sketches and the hashed orders are no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    unset = spark.conf.get(_BATCH_BYTES, None) is None
    try:
        for name, stage in STAGES[:-1]:
            start = mark()
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
            drop_since(spark, start, docs)
    finally:
        if unset:
            spark.conf.unset(_BATCH_BYTES)
    return STAGES[-1][1](spark, docs, sf_dir)
