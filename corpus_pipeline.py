"""A corpus from language to packed sequences: every stage reads what the one before has written.

A stage takes (spark, docs, sf_dir) and gives the documents it keeps, in the columns of `documents` (extra ones stay); the
last gives the packing. Decisions reach rows by id and text, so rows that repeat an id with other texts are judged
each by its own. Only rows whose id may be concerned are shuffled with their texts.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm.common import SPACES, letters, maybe_in
from statloom.llm.exact_dedup import exact_dedup
from statloom.llm.language_id import NO_MODEL, fit, predict
from statloom.llm.packing import best_fit_packing
from statloom.llm.simhash import fingerprints, simhash_groups
from statloom.llm.substring_dedup import substring_dedup
from statloom.session import settle

#: Not expressible in SQL: trained classifier, XXH64 fingerprints, packing order.
ORACLE_SQL = None


def _rows(docs: DataFrame) -> DataFrame:
    """Each row whole in one column, beside its id and text."""
    return docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from all labelled rows; a document goes if it has no letter or no text, or is of no learned language (most of its n-grams
    were never learned). One that is ambiguous otherwise stays: a clean text may quote another language. If nothing is labelled,
    every text with a letter stays."""
    model = fit(docs.select("lang", "text"))
    found = predict(_rows(docs), model, "row", "text")
    return found.where(F.col("reason").isNull() | (F.col("reason") == NO_MODEL)).select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of equal texts stays: the longest original, then the smallest id; of repeated rows one."""
    groups = settle(exact_dedup(docs.select("doc_id", "text")).where("group_size > 1").select("doc_id", "kept", "text_sha256"))
    told = groups.select(F.col("doc_id").alias("of"), F.col("kept"), F.col("text_sha256").alias("sha")).dropDuplicates(["of", "sha"])
    rows = _rows(docs).withColumn("key", F.xxhash64("doc_id"))
    keys = groups.select(F.xxhash64("doc_id").alias("key"))
    hit = maybe_in(rows, "key", keys).withColumn("own", F.sha2(F.translate(letters("text"), SPACES, ""), 256))
    hit = hit.join(told, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("own") == F.col("sha")), "left")
    alone = hit.where("sha IS NULL").select("row")
    first = hit.where("kept").dropDuplicates(["doc_id", "own"]).select("row")
    return maybe_in(rows, "key", keys, keep=False).select("row").union(alone).union(first).select("row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each SimHash component stays (shingles of three words, three bits)."""
    groups = simhash_groups(docs.select("doc_id", "text"), width=3, distance=3)
    gone = settle(groups.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "fingerprint").distinct())
    rows = _rows(docs).withColumn("key", F.xxhash64("doc_id"))
    keys = gone.select(F.xxhash64("doc_id").alias("key"))
    hit = fingerprints(maybe_in(rows, "key", keys).select("row", "text"), "row", "text", 3)
    hit = hit.withColumn("own", F.lower(F.lpad(F.hex("print"), 16, "0")))
    told = gone.select(F.col("doc_id").alias("of"), F.col("fingerprint").alias("fp"))
    hit = hit.join(told, F.col("id.doc_id").eqNullSafe(F.col("of")) & (F.col("own") == F.col("fp")), "left_anti")
    return maybe_in(rows, "key", keys, keep=False).select("row").union(hit.select(F.col("id").alias("row"))).select("row.*")


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages of 50 words that a smaller id has too go; a text that loses some is its kept words joined by spaces."""
    cut = substring_dedup(_rows(docs), length=50, carry="row")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("row.text"))
    cut = cut.withColumn("new", text)
    changed = {"text": F.col("new"), "n_chars": F.when(F.col("n_removed") > 0, F.length("new")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)}
    return cut.select(*(changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 512 to 4,096 words."""
    return best_fit_packing(docs.select("doc_id", "text"))


STAGES = [("language_id", language), ("exact_dedup", exact), ("simhash_near_dedup", near), ("substring_dedup", repeats), ("best_fit_packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = settle(docs)
    return docs
