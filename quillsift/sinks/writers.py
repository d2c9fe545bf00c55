"""Results as CSV, JSON and YAML text. A writer takes findings (filename, datatype, key, value) and a path."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import results


def write_csv(found: DataFrame, path: str) -> None:
    """filename,datatype,value with a header, quoted where needed, CRLF line ends, UTF-8; by filename over the part files."""
    results.csv_rows(results.flat(found)).orderBy("filename", "datatype", "value").write.option("header", True).option("escape", '"').option("lineSep", "\r\n").option("encoding", "UTF-8").mode("overwrite").csv(path)


def write_json(found: DataFrame, path: str) -> None:
    """One JSON object a line and file: filename, matches by datatype and key; by filename over the part files."""
    results.nested(found).orderBy("filename").write.mode("overwrite").json(path)


def write_json_array(found: DataFrame, path: str) -> None:
    """One JSON array over the part files in their order: sorted by filename, an object a line, so that no task holds the whole."""
    rows = results.nested(found)
    ends = rows.agg(F.min("filename").alias("first"), F.max("filename").alias("last")).first()
    if ends["first"] is None:
        text = found.sparkSession.createDataFrame([("[]",)], "value string")
    else:
        opened = F.when(F.col("filename") == ends["first"], "[\n").otherwise("")
        closed = F.when(F.col("filename") == ends["last"], "\n]").otherwise(",")
        text = rows.orderBy("filename").select(F.concat(opened, F.to_json(F.struct("filename", "matches")), closed).alias("value"))
    text.write.mode("overwrite").text(path)


def _quoted(value: Column) -> Column:
    """A YAML string on one line: in single quotes, or in double ones with escapes where there is a line break or another control character."""
    escaped = F.regexp_replace(F.regexp_replace(F.to_json(F.array(value)), r"^\[|\]$", ""), r"[\x7f\u0085\u2028\u2029]", " ")
    plain = F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'"))
    return F.when(value.rlike(r"[\x00-\x1f\x7f\u0085\u2028\u2029]"), escaped).otherwise(plain)


def yaml_document(filename: Column, matches: Column) -> Column:
    """A file's results as a YAML document."""
    keys = lambda keyed: F.array_join(F.transform(F.map_entries(keyed), lambda e: F.concat(F.lit("\n        "), e["key"], F.lit(":"), F.array_join(F.transform(e["value"], lambda v: F.concat(F.lit("\n        - "), _quoted(v))), ""))), "")
    types = F.array_join(F.transform(F.map_entries(matches), lambda e: F.concat(F.lit("\n    "), e["key"], F.lit(":"), keys(e["value"]))), "")
    return F.concat(F.lit("---\nfilename: "), _quoted(filename), F.lit("\nmatches:"), types)


def write_text(found: DataFrame, path: str) -> None:
    """A YAML document a file, separated by ---, by filename over the part files."""
    results.nested(found).orderBy("filename").select(yaml_document(F.col("filename"), F.col("matches")).alias("value")).write.mode("overwrite").text(path)


WRITERS: dict[str, Callable[[DataFrame, str], None]] = {"csv": write_csv, "json": write_json, "json_array": write_json_array, "text": write_text}


def register(kind: str, writer: Callable[[DataFrame, str], None]) -> None:
    """Adds a writer for `results` of this kind, or replaces one."""
    WRITERS[kind] = writer


def unregister(kind: str) -> None:
    WRITERS.pop(kind, None)


def fan_out(found: DataFrame, targets: dict[str, str]) -> None:
    """Writes the findings to every target (kind, path); they are worked out once."""
    kept = results.flat(found).persist()
    try:
        for kind, path in targets.items():
            WRITERS[kind](kept, path)
    finally:
        kept.unpersist()
