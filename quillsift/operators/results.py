"""From blocks of text to findings: flat rows, nested maps, counts and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.registry import detect
from ..functions.text import normalize

FLAT = ["filename", "datatype", "key", "value"]


def findings(blocks: DataFrame, detectors: list[str] | None = None, mode: str = "distinct", lookaround: bool = False) -> DataFrame:
    """(filename, block, datatype, key, value) of every block (filename, block, content); distinct inside a block, no shuffle."""
    clean = blocks.select("filename", "block", normalize(F.col("content")).alias("content"))
    # the expression is the generator's own input: as a column of its own, Catalyst would infer a filter on it and work it out twice
    return clean.select("filename", "block", F.inline(detect(F.col("content"), detectors, mode, lookaround)))


def flat(found: DataFrame) -> DataFrame:
    """Distinct (filename, datatype, key, value) over the blocks of a file."""
    return found.select(*FLAT).distinct()


def csv_rows(found: DataFrame) -> DataFrame:
    """(filename, datatype, value) with value as 'key: value'."""
    return found.select("filename", "datatype", F.concat_ws(": ", "key", "value").alias("value"))


def nested(found: DataFrame) -> DataFrame:
    """(filename, matches map<datatype, map<key, array<value>>>), values sorted; files without findings have no row."""
    keys = found.groupBy("filename", "datatype", "key").agg(F.sort_array(F.collect_set("value")).alias("values"))
    types = keys.groupBy("filename", "datatype").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "values")))).alias("keys"))
    pairs = F.collect_list(F.struct("datatype", "keys"))
    return types.groupBy("filename").agg(F.map_from_entries(F.array_sort(pairs, lambda a, b: F.when(a["datatype"] < b["datatype"], -1).when(a["datatype"] > b["datatype"], 1).otherwise(0))).alias("matches"))


def count_results(found: DataFrame) -> DataFrame:
    """(filename, results): the number of distinct values of each file."""
    return flat(found).groupBy("filename").agg(F.count("*").alias("results"))


def totals(files: DataFrame, scanned: DataFrame, found: DataFrame) -> DataFrame:
    """One row of counters: files (dir, length) that were found and scanned, and their results; one aggregate over their union."""
    rows = files.select(F.lit("found").alias("what"), "dir", "length").union(scanned.select(F.lit("scanned"), "dir", "length"))
    rows = rows.union(flat(found).select(F.lit("result"), F.lit(None).cast("string"), F.lit(0).cast("long")))
    of = lambda what: F.col("what") == what
    files_of = lambda what: (F.countDistinct(F.when(of(what), F.col("dir"))).alias(f"dirs_{what}"), F.count_if(of(what)).alias(f"files_{what}"), F.coalesce(F.sum(F.when(of(what), F.col("length"))), F.lit(0)).alias(f"bytes_{what}"))
    return rows.agg(*files_of("found"), *files_of("scanned"), F.count_if(of("result")).alias("total_results"))
