"""Exact duplicates by content-defined chunk recipes, in DataFrame operations only.

A text is cut where its own characters say so: after `low` characters at least, at the next mark (a blank after
one of a few letters), after `high` at most. Each chunk is named by its xxHash64 and verified by its SHA-256: the
chunk dictionary has one entry for each distinct pair, and the identifier is the hash with the entry's rank
among entries of the same hash (1 unless the hash collides). Documents are then compared by their ordered lists of identifiers.
Texts are read once and never shuffled; what moves is about 50 bytes a chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, sha256_hex, text_or_empty

LOW, HIGH = 800, 8192


def chunks(text: Column, low: int = LOW, high: int = HIGH) -> Column:
    """The chunks of a text, in order; together they are the text. An empty text is one empty chunk."""
    pattern = rf"(?s).{{{low},{high}}}?(?:[aeirtnlo][,.]?[ \n](?=[a-fA-F])|\z)|.{{1,{high}}}"
    return F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: int = LOW, high: int = HIGH) -> DataFrame:
    """(row, doc_id, text_sha256, parts): each row's chunks as ordered (hash, digest) pairs."""
    text = text_or_empty(text_col)
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("doc_id"),
        sha256_hex(text).alias("text_sha256"),
        F.transform(chunks(text, low, high), lambda c: F.struct(F.xxhash64(c).alias("hash"), F.unhex(F.sha2(F.encode(c, "UTF-8"), 256)).alias("digest"))).alias("parts"),
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: int = LOW, high: int = HIGH) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each row of `docs`.

    A null text counts as empty. Of equal texts the largest id stays (a null id is the smallest); of repeated rows
    with that id, one stays. Other columns are ignored; an empty table gives an empty table.
    """
    made = settle(recipes(docs, id_col, text_col, low, high))
    parts = made.select("row", F.posexplode("parts").alias("pos", "part")).select("row", "pos", "part.hash", "part.digest")
    entries = parts.groupBy("hash", "digest").agg(F.count("*").alias("uses"))
    named = entries.select("hash", "digest", F.row_number().over(Window.partitionBy("hash").orderBy("digest")).alias("rank"))
    ids = parts.join(named, ["hash", "digest"]).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "hash", "rank"))).alias("ids"))
    lists = ids.select("row", F.transform("ids", lambda x: F.struct(x["hash"].alias("hash"), x["rank"].alias("rank"))).alias("ids"))
    own = settle(made.select("row", "doc_id", "text_sha256").join(lists, "row"))
    # written out, so that the join below is one of two plain tables, whose hot lists can be split between tasks
    groups = settle(own.groupBy("ids").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("group_size")))
    return own.join(groups, "ids").select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256"
    )
