"""From documents to token ids: quality rules, near duplicates, personal data, mix, tokens.

Each stage takes (spark, docs, sf_dir), docs being what its predecessor wrote,
and returns a DataFrame; all but the last return the columns of documents.
What a stage decides is found on ids and figures alone; texts then go through
one exchange at most.

Defined cases: rows that share a doc_id, or have none, are separate documents;
rows alike in all columns are told apart by their number; null and empty texts
fail the quality rules; an empty table gives an empty result; further columns
are dropped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import tokenized
from .common import removed, with_checkpoints, word_count
from .mixing import mix_sources
from .ngram_join import near_duplicates
from .pii import find_pii, redacted
from .quality import quality
from .queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with _row, a hash of all its columns; rows that share it are alike."""
    return docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("_row"))


def _nth() -> Column:
    """The number, from 1, of a row among those that share its _row; after a join on _row it needs no exchange."""
    return F.row_number().over(Window.partitionBy("_row").orderBy("_row"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    judged = quality(docs.select(*COLUMNS))
    # The generator stands between the flags and their filter, which else would be moved below them and compute them once more.
    one = judged.select(*COLUMNS, F.explode_outer(F.when(F.col("kept"), F.array(F.lit(True)))).alias("_kept"))
    return one.where(F.col("_kept").isNotNull()).select(*COLUMNS)


def near_duplicate_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document, that with the smallest doc_id (null last); documents linked with nothing stay, whatever their doc_id."""
    rows = _keyed(docs)
    groups = near_duplicates(rows.select("_row", "text"), doc_id="_row").select(F.col("doc_id").alias("_row"), "component_id", (F.col("n_shingles") == 0).alias("_alone"))
    # Groups are named by a _row; the document that stays is chosen by doc_id.
    ids = rows.select("_row", "doc_id").distinct()
    first = groups.where("not _alone").distinct().join(ids, "_row").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))["_row"].alias("_row"))
    kept = first.select("_row", F.lit(False).alias("_alone")).unionByName(groups.where("_alone").select("_row", "_alone").distinct())
    return rows.join(kept, "_row").withColumn("_n", _nth()).where(F.col("_alone") | (F.col("_n") == 1)).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data replaced by its kind in brackets."""
    clean = find_pii(docs.select(*COLUMNS)).withColumn("text", redacted(F.col("text"), F.col("pii")))
    return clean.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix of the sources takes."""
    rows = _keyed(docs)
    slim = rows.select("doc_id", "source", word_count(F.col("text")).alias("size"), "_row")
    # Rows that are alike share what they take, the first of them a copy more.
    taken = mix_sources(slim, text=None).groupBy("_row").agg(F.sum("copies").alias("_all"), F.count("*").alias("_alike")).where("_all > 0")
    own = F.floor(F.col("_all") / F.col("_alike")) + (F.col("_n") <= F.col("_all") % F.col("_alike")).cast("long")
    out = rows.join(taken, "_row").withColumn("_n", _nth()).withColumn("_own", own).where("_own > 0")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_own")))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, round_trip."""
    return tokenized(docs.select("doc_id", "lang", "source", "text"), vocabulary()).drop("text")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicate_join", near_duplicate_join),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("tokens", tokens),
]
#: SQL has no byte-pair encoder; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents; what each returns is written to the shared folder and read again, and goes once the next has read it."""
    with_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            removed(spark, before)
        before = path
    return docs
