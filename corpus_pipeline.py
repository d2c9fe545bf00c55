"""A training corpus from `documents`: quality, exact copies, near copies, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again for the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.llm import exact_dedup, mixing, quality, sentencepiece_codec, simhash
from quillsift.llm.common import forget, settle, settle_alone, sha256_hex, table, text_or_empty

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _meet(docs: DataFrame, keys: DataFrame, how: str, key: Column | None = None) -> DataFrame:
    """`docs` joined to `keys` by doc_id, null ids included, and by `key` if it is given, which the keys hold as column key."""
    own = docs.select(*COLUMNS) if key is None else docs.select(*COLUMNS, key.alias("own_key"))
    at = own["doc_id"].eqNullSafe(keys["doc_id"])
    met = own.join(keys, at if key is None else at & (own["own_key"] == keys["key"]), how)
    return met if how != "inner" else met.drop(keys["doc_id"])


def _shared(rows: DataFrame) -> DataFrame:
    """The ids that several rows have. Only these are told apart by their texts, which few rows have to move for."""
    return settle(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))


def _kept(docs: DataFrame, fates: DataFrame, key: Column) -> DataFrame:
    """The rows of `docs` that stay by `fates` (doc_id, key, kept); rows that repeat an id and a key stay once. Rows of a sole id meet their fate by the id."""
    fates = settle(fates)
    shared = _shared(fates)
    if not shared.head(1):
        return _meet(docs, settle(fates.where("NOT kept").select("doc_id")), "left_anti")
    gone = settle(fates.where("NOT kept").select("doc_id").union(shared).distinct())
    stay = settle(fates.where("kept").select("doc_id", "key").distinct())
    again = _meet(_meet(docs, shared, "left_semi"), stay, "left_semi", key).dropDuplicates(["doc_id", "own_key"])
    return _meet(docs, gone, "left_anti").union(again.select(*COLUMNS))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls good; it learns from the labels of `docs` that are not held out.

    Each row is judged by its text alone, repeated rows alike, rows without an id too; null and empty texts have the score of no indicator. An empty table
    gives an empty table, as do labels of one class 0 only.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select(*COLUMNS), model).where("predicted = 1").select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts (null: empty), of the document with the largest id, a null id being the smallest; a row that is there twice is kept once."""
    groups = exact_dedup.exact_groups(docs)
    fates = groups.select("doc_id", F.col("text_sha256").alias("key"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))
    return _kept(docs, fates, sha256_hex(text_or_empty()))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: of the smallest id, null last, then of the least text hash. Rows that share an id but not a text are judged each on its own."""
    groups = settle(simhash.near_duplicates(docs).select("doc_id", F.col("mark").alias("key"), "component"))
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    best = settle(groups.groupBy("component").agg(F.min(rank).alias("best")))
    return _kept(docs, groups.join(best, "component").select("doc_id", "key", rank.eqNullSafe(F.col("best")).alias("kept")), F.xxhash64(text_or_empty()))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix takes them, in the order of the curriculum.

    Each row has its own copies; rows that repeat an id and a text are planned one by one and interchangeable. Rows of size 0 and texts that are null aren't taken.
    """
    placed = settle(mixing.copies(mixing.plan(docs, whole=True)).select("doc_id", F.col("mark").alias("key"), "position"))
    shared = _shared(docs)
    if not shared.head(1):
        copies = _meet(docs, placed.drop("key"), "inner")
    else:
        alone = _meet(_meet(docs, shared, "left_anti"), placed.drop("key"), "inner")
        rows = _meet(docs, shared, "left_semi").withColumn("own_key", F.xxhash64(text_or_empty())).dropDuplicates(["doc_id", "own_key"])
        copies = alone.select(*COLUMNS, "position").union(_meet(rows, placed, "inner", F.col("own_key")).select(*COLUMNS, "position"))
    return copies.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id").select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's ids; decoding them gives its text back. Null and empty texts have none; repeated rows and null ids stay as they are."""
    return sentencepiece_codec.encode(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("source mixing", mix),
    ("sentencepiece encoding", token_ids),
]

#: SQL has neither the classifier nor the fingerprints nor the encoder; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in their order. Each stage's result is settled and what it needed on the way is deleted, its input too; the last one's input stays, as the result reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, settle_alone(lambda: stage(spark, docs, sf_dir))  # noqa: B023 - called at once
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
