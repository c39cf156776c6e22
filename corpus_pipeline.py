"""From raw documents to packed training sequences: five stages, each a table in and a table out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laborloom.llm import jaccard_join, language_id, mixing, packing, secret_scans
from laborloom.llm.common import by_ids, crc_mod, saved, table
from laborloom.llm.queries import tokenizer_path


BATCH_ROWS = 1_000


def smaller_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in batches of few rows, so that a task holds little beside them.

    A session setting, because batches are cut when a stage runs; a smaller one of the session's own stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those without letters, or without one language of at least 30 per cent, go."""
    smaller_batches(spark)
    model = language_id.learn_languages(docs.filter(crc_mod("doc_id", 4) != 2))
    rated = language_id.identify(docs, model, into="__language")
    known = (F.col("__language.lang") != language_id.UNKNOWN) & (F.col("__language.score") >= 0.3)
    return rated.filter(known).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.8 or more: that of the smallest doc_id.

    A document is a doc_id with a text: rows without a doc_id take part like others (and come last in their group), two
    texts under one doc_id are two documents, and of rows equal in both one stays.
    """
    smaller_batches(spark)
    row = F.xxhash64("doc_id", "text")
    found = jaccard_join.jaccard_components(docs.select(row.alias("__row"), "text"), n=5, per_cent=80, key="__row")
    rows = docs.select(row.alias("__row"), "doc_id").groupBy("__row").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    rows = saved(rows.join(found, "__row"), "document_groups")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row"))
    kept = rows.groupBy("component_id").agg(first.alias("first")).select(F.col("first.__row").alias("__row"), F.lit(True).alias("kept"))
    judged = rows.join(kept, "__row", "left")
    others = saved(judged.filter("kept IS NULL").select("__row"), "duplicates")
    repeated = saved(judged.filter("kept AND copies > 1").select("__row"), "repeated_rows")
    once = by_ids(docs.withColumn("__row", row), others, "__row", "left_anti")
    single = by_ids(once, repeated, "__row", "left_anti")
    same = by_ids(once, repeated, "__row", "left_semi").withColumn("__second", F.xxhash64(F.lit(1), "text"))
    same = same.dropDuplicates(["doc_id", "__row", "__second"])
    return single.select(*docs.columns).unionByName(same.select(*docs.columns))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the secrets in its text masked and n_chars counted anew where the text changed.

    Columns named like those of the scan are the caller's and stay as they are.
    """
    own = {name: f"__own_{name}" for name in ("base_spans", "secret_spans") if name in docs.columns}
    found = secret_scans.find_secrets(docs.withColumnsRenamed(own))
    hidden = F.size("secret_spans") > 0
    masked = found.withColumn("text", secret_scans.redacted(F.col("text"), F.col("secret_spans")))
    length = F.when(hidden, F.char_length("text")).otherwise(F.col("n_chars"))
    masked = masked.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType)).drop("base_spans", "secret_spans")
    return masked.withColumnsRenamed({theirs: name for name, theirs in own.items()}).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: repeats as copies, the document in which a source's last block ends cut there."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens."""
    smaller_batches(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", keep_languages),
    ("near_duplicates", drop_near_duplicates),
    ("secret_scans", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# Tokenization and the learned language model have no SQL form; tests/llm/test_pipeline.py holds each stage against a
# plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
