"""The scan's own queries and the SQL they are held against.

A document is a file with one block, a page a file named by its url, a conversation a file with a block for each turn.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ScanConfig
from ..functions import email, pan
from ..functions.text import CHUNK_SIZE, make_chunks, normalize, sizeof_fmt, suffix
from ..operators import results, selection
from ..operators.limits import rows_within_limits
from ..sinks import writers
from ..sources import files
from . import scan


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("filename"), F.lit(0).alias("block"), F.col("text").alias("content"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select(F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("filename"), F.lit(0).alias("block"), F.col("html").alias("content"))


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block for each turn, signed with an address that every second turn repeats and a number that all turns do."""
    signed = F.concat(F.coalesce("text", F.lit("")), F.format_string(" from user%s@host%s.org 4700-1234-5678-901", F.col("conv_id").cast("string"), (F.col("turn") % 2).cast("string")), (F.col("conv_id") % 10).cast("string"))
    return _read(spark, sf_dir, "conversations").select(F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("filename"), F.col("turn").alias("block"), signed.alias("content"))


def _receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each order, with a number of every brand made of its keys; about one in ten has a right checksum."""
    digits = F.lpad((F.col("o_orderkey") * 7919 + F.col("o_custkey") * 104729).cast("string"), 15, "0")
    part = lambda start, n: F.substring(digits, start, n)
    gap = F.element_at(F.array(F.lit(""), F.lit(" "), F.lit("-")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    fours = lambda first: F.concat_ws("", F.lit(first), part(1, 4 - len(first)), gap, part(4, 4), gap, part(8, 4), gap, part(12, 4))
    said = F.concat_ws(
        "; ", F.concat(F.lit("visa "), fours("4")), F.concat(F.lit("mc "), fours("53")), F.concat(F.lit("discover "), fours("6011")), F.concat(F.lit("jcb 3528"), part(4, 12)),
        F.concat(F.lit("amex 37"), part(1, 2), gap, part(4, 6), gap, part(10, 5)),
    )
    return _read(spark, sf_dir, "orders").select(F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("filename"), F.lit(0).alias("block"), said.alias("content"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).union(_pages(spark, sf_dir))


def normalize_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = normalize(F.coalesce("text", F.lit("")))
    return _read(spark, sf_dir, "documents").select("doc_id", F.length(clean).alias("clean_chars"), F.md5(clean.cast("binary")).alias("clean_md5"))


def _spread(spark: SparkSession, sf_dir: str, values, name: str, files=_files, may_hold=None) -> DataFrame:
    """may_hold: what tells by the content that it has no values; such content isn't normalised."""
    content = F.coalesce("content", F.lit(""))
    clean = F.when(may_hold(content), normalize(content)).otherwise("") if may_hold else normalize(content)
    rows = files(spark, sf_dir).select("filename", clean.alias("clean"))
    return rows.select("filename", F.posexplode(values(F.col("clean"))).alias("pos", name))


def email_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(spark, sf_dir, email.candidates, "candidate")


def email_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return email_candidates(spark, sf_dir).select("filename", "pos", "candidate", email.is_valid(F.col("candidate")).alias("valid"))


def email_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return email_valid(spark, sf_dir).where("valid").select("filename", email.redact(F.col("candidate")).alias("value")).distinct()


def _pan_brand(brand: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = _spread(spark, sf_dir, lambda c: pan.candidates(c, brand), "candidate", lambda *of: _files(*of).union(_receipts(*of)), pan.may_hold)
        return found.select("filename", "pos", F.length("candidate").alias("n_chars"), pan.is_valid(F.col("candidate")).alias("valid"), pan.redact(F.col("candidate")).alias("value"))

    return query


def email_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses at numbers in brackets, made of customers' keys; they are candidates, but not valid ones. Of four numbers one may be out of range."""
    def written(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = F.col("c_custkey")
        text = F.format_string("to cust%s@[10.%s.%s.%s] and x@y.org", key.cast("string"), (key % 256).cast("string"), (key % 90).cast("string"), (key % 290).cast("string"))
        return _read(spark, sf_dir, "customer").select(F.concat(F.lit("cust-"), key.cast("string")).alias("filename"), text.alias("content"))

    found = _spread(spark, sf_dir, email.candidates, "candidate", written)
    return found.select("filename", "pos", "candidate", email.is_valid(F.col("candidate")).alias("valid"))


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text, content): documents as files of three encodings by their id."""
    text, kind = F.coalesce("text", F.lit("")), F.col("doc_id") % 3
    content = F.when(kind == 0, F.encode(text, "UTF-8")).when(kind == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE"))).otherwise(F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text, "UTF-8")))
    return _read(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("path"), text.alias("text"), content.alias("content"))


def decoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.decoded(_written(spark, sf_dir)).select("path", F.coalesce("encoding", F.lit("none")).alias("encoding"), F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_md5"))


def media_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of files that begin in seven ways by the document's id."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    starts = F.array(*map(F.lit, ("%PDF-1.4 ", "<?xml version='1.0'?>", " <!DOCTYPE html>", "<note>", "{\\rtf1 ", "", "")))
    kind = (F.col("doc_id") % 7).cast("int")
    content = F.when(kind == 6, F.encode(F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("text"))), "UTF-8")).otherwise(F.concat(F.encode(F.element_at(starts, kind + 1), "UTF-8"), text))
    rows = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), content.alias("content"))
    return files.typed(rows).select(F.col("path").cast("long").alias("doc_id"), F.coalesce("mime", F.lit("none")).alias("mime"))


def content_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read line by line into blocks of two chunks."""
    rows = files.packed(_written(spark, sf_dir), 2 * CHUNK_SIZE)
    return rows.select(F.col("path").alias("filename"), "block", F.length("content").alias("n_chars"), F.md5(F.encode("content", "UTF-8")).alias("block_md5"))


BUCKETS, LEFT_OUT = 16, 7


def _written_files(spark: SparkSession, sf_dir: str) -> ScanConfig:
    """Documents as lines of real files, a folder with one file for each remainder of their ids; one folder is excluded from the scan."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and spark.sparkContext.master.startswith("local"):
        shared = tempfile.mkdtemp(prefix="quillsift-")
    folder = f"{shared}/written-{uuid.uuid4().hex}"
    line = F.concat(F.lit("begin "), normalize(F.coalesce("text", F.lit(""))), F.lit(" end"))
    rows = _read(spark, sf_dir, "documents").select((F.col("doc_id") % BUCKETS).alias("bucket"), line.alias("value"))
    rows.repartition("bucket").write.partitionBy("bucket").option("compression", "none").text(folder)
    return ScanConfig(start_dirs=[folder], exclude_dirs=[re.sub("^file:(//)?(?=/)", "", f"{folder}/bucket={LEFT_OUT}/")[:-1]])


def written_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing, exclusion, media types, selection, reading and detection over real files."""
    found = results.flat(scan.findings(spark, _written_files(spark, sf_dir)))
    return found.select(F.regexp_extract("filename", "bucket=([0-9]+)", 1).cast("long").alias("bucket"), "datatype", "key", "value").distinct()


def written_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.totals(spark, _written_files(spark, sf_dir))


def yaml_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = results.nested(results.findings(_files(spark, sf_dir)))
    return found.select("filename", writers.yaml_document(F.col("filename"), F.col("matches")).alias("document"))


def pan_last_per_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.flat(results.findings(_documents(spark, sf_dir), ["pan"], mode="last_per_brand"))


def luhn(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _read(spark, sf_dir, "orders").select(F.col("o_orderkey"))
    return keys.select("o_orderkey", pan.is_valid(F.col("o_orderkey").cast("string")).alias("valid"))


def scan_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.flat(results.findings(_files(spark, sf_dir)))


def scan_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.csv_rows(scan_flat(spark, sf_dir))


def scan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.count_results(results.findings(_files(spark, sf_dir)))


def scan_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.nested(results.findings(_files(spark, sf_dir))).select("filename", F.to_json("matches").alias("matches"))


def scan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _read(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("dir"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("length"))
    return results.totals(files, files.where(selection.file_checks(F.col("length"))), results.findings(_documents(spark, sf_dir)))


def conversation_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.flat(results.findings(_conversations(spark, sf_dir)))


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths made of the page urls, with one of several extensions by id."""
    names = F.array(*map(F.lit, (".html", ".txt", ".TXT", ".docx", ".bin", "", ".xlsx", ".pdf", ".tar.json")))
    ext = F.element_at(names, (F.col("page_id") % 9 + 1).cast("int"))
    path = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", ""), ext)
    kinds = F.array(*map(F.lit, ("text/html", "application/pdf", "image/png")))
    mime = F.when(F.col("page_id") % 4 > 0, F.element_at(kinds, (F.col("page_id") % 4).cast("int")))
    return _read(spark, sf_dir, "pages").select("page_id", path.alias("path"), mime.alias("mime"), F.length(F.coalesce("html", F.lit(""))).cast("long").alias("length"))


def file_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("page_id", "path", suffix(F.col("path")).alias("ext"))


def handler_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _paths(spark, sf_dir).withColumn("ext", suffix(F.col("path")))
    return rows.select("page_id", "ext", F.coalesce("mime", F.lit("")).alias("mime"), F.coalesce(selection.handler(F.col("ext"), F.col("mime")), F.lit("none")).alias("handler"))


def file_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _paths(spark, sf_dir).withColumn("ext", suffix(F.col("path")))
    return rows.where(selection.file_checks(F.col("length"))).select("page_id", selection.file_matches(F.col("ext"), F.col("mime"), [".txt", ".docx"], ["application/pdf"]).alias("matched"))


def exclude_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    directory = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    return _paths(spark, sf_dir).select("page_id", directory.alias("dir")).where(~selection.excluded(F.col("dir"), ["/WWW.", "/blog.t", "/m.th*"]))


def size_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("n_chars") * F.col("n_chars") * 37
    return _read(spark, sf_dir, "documents").select("doc_id", sizeof_fmt(value).alias("size"))


def chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(make_chunks(F.coalesce("text", F.lit("")))).alias("pos", "chunk"))
    return rows.select("doc_id", "pos", F.length("chunk").alias("n_chars"), F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


def blank_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells made of line items: a sheet an order, a row a line, ten cells a row, blank by a rule."""
    sheet, row, quantity = F.col("l_orderkey"), F.col("l_linenumber").cast("long"), F.col("l_quantity").cast("int").cast("string")

    def cell(col: int) -> Column:
        value = F.when((sheet + row * 3 + col) % 4 < 2, quantity).otherwise("")
        return F.struct(F.lit(col).alias("col"), F.when((sheet + row) % 3 == 0, "").otherwise(value).alias("value"))

    rows = _read(spark, sf_dir, "lineitem").select(sheet.alias("sheet"), row.alias("row"), F.array(*map(cell, range(1, 11))).alias("cells"))
    return rows_within_limits(rows, blank_cells=2, blank_rows=1)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (normalize_content, email_candidates, email_valid, email_redacted, pan_last_per_brand, luhn, scan_flat, scan_csv_rows, scan_counts, scan_nested, scan_totals, conversation_union, file_projection, handler_resolve, file_matches, exclude_dirs, size_format, chunked, blank_limits, email_literals, decoded_texts, media_types, content_blocks, yaml_documents, written_findings, written_totals)
} | {f"pan_{brand}": _pan_brand(brand) for brand in pan.BRANDS}

_SPACE = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x0b]+"


def _clean(column: str) -> str:
    return f"trim(regexp_replace(coalesce({column}, ''), '{_SPACE}', ' ', 'g'))"


_ATOM = "[a-zA-Z0-9!#$%&''*+/=?^_`{|}~-]"
_LABEL = "[a-zA-Z0-9](?:[a-zA-Z0-9-]*[a-zA-Z0-9])?"
_EMAIL = rf"(?:{_ATOM}+(?:\.{_ATOM}+)*|\"(?:[\x01-\x08\x0b\x0c\x0e-\x1f\x21\x23-\x5b\x5d-\x7f]|\\[\x01-\x09\x0b\x0c\x0e-\x7f])*\")@(?:{_LABEL}\.)+{_LABEL}"
_BRAND = {k: r"(?:^|[^\p{Nd}.-])" + v + r"(?:$|[^\p{Nd}.-])" for k, v in pan.BRANDS.items()}
_STRIP = f"regexp_replace(unnest(found), '^{_SPACE}|{_SPACE}$', '', 'g')"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


_FILES_SQL = f"""files AS (
    SELECT 'doc-' || doc_id::VARCHAR AS filename, {_clean('text')} AS clean FROM documents
    UNION ALL SELECT 'page-' || page_id::VARCHAR, {_clean('html')} FROM pages)"""
_DOCS_SQL = f"files AS (SELECT 'doc-' || doc_id::VARCHAR AS filename, {_clean('text')} AS clean FROM documents)"
_MAIL_SQL = f"""raw AS (SELECT filename, regexp_extract_all(clean, '{_EMAIL}') AS found FROM files WHERE contains(clean, '@')),
mails AS (SELECT filename, unnest(range(len(found)))::INT AS pos, unnest(found) AS candidate FROM raw),
split AS (SELECT *, split_part(candidate, '@', 1) AS local, split_part(candidate, '@', 2) AS domain, len(string_split(candidate, '@')) = 2 AS one FROM mails),
checked AS (SELECT *, one AND length(local) BETWEEN 1 AND 64 AND length(domain) BETWEEN 1 AND 253 AND len(list_filter(string_split(domain, '.'), lambda x: length(x) > 63)) = 0
    AND regexp_matches(domain, '\\.[a-zA-Z]{{2,63}}$') AS valid FROM split),
mail_values AS (SELECT DISTINCT filename, CASE WHEN length(local) <= 1 THEN repeat('*', length(local)) WHEN length(local) <= 5 THEN local[1] || repeat('*', length(local) - 1)
    WHEN length(local) < 10 THEN local[1] || repeat('*', length(local) - 2) || local[-1] ELSE local[1:3] || repeat('*', length(local) - 4) || local[-1] END || '@' || domain AS value
    FROM checked WHERE valid)"""


_LITERAL = r"\[(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\]"
_DIGITS = "lpad((o_orderkey * 7919 + o_custkey * 104729)::VARCHAR, 15, '0')"
_FOURS = "'{0}' || d[1:{1}] || g || d[4:7] || g || d[8:11] || g || d[12:15]"
_RECEIPTS_SQL = f"""receipts AS (SELECT o_orderkey, {_DIGITS} AS d, (['', ' ', '-'])[o_orderkey % 3 + 1] AS g FROM orders)"""
_SAID = " || '; ' || ".join((
    "'visa ' || " + _FOURS.format("4", 3), "'mc ' || " + _FOURS.format("53", 2), "'discover ' || '6011' || g || d[4:7] || g || d[8:11] || g || d[12:15]",
    "'jcb 3528' || d[4:15]", "'amex 37' || d[1:2] || g || d[4:9] || g || d[10:14]",
))
_WITH_RECEIPTS_SQL = _FILES_SQL.replace(" FROM pages)", f" FROM pages\n    UNION ALL SELECT 'order-' || o_orderkey::VARCHAR, {_SAID} FROM receipts)")
_SIGNED = "coalesce(text, '') || ' from user' || conv_id::VARCHAR || '@host' || (turn % 2)::VARCHAR || '.org 4700-1234-5678-901' || (conv_id % 10)::VARCHAR"


def _pan_sql(brands: list[str]) -> str:
    each = "\nUNION ALL ".join(f"SELECT filename, '{b}' AS key, regexp_extract_all(clean, '{_BRAND[b]}') AS found FROM files" for b in brands)
    return f"""hits AS ({each}),
cards AS (SELECT filename, key, unnest(range(len(found)))::INT AS pos, {_STRIP} AS candidate FROM hits),
digits AS (SELECT *, regexp_replace(candidate, '[^0-9]', '', 'g') AS d FROM cards),
lit AS (SELECT *, list_sum(list_transform(range(length(d)), lambda k: CASE WHEN k % 2 = 0 THEN d[length(d) - k]::INT
    ELSE (d[length(d) - k]::INT * 2) // 10 + (d[length(d) - k]::INT * 2) % 10 END)) % 10 = 0 AS valid FROM digits),
told AS (SELECT *, list_aggregate(list_transform(range(1, length(candidate) + 1), lambda i: CASE WHEN regexp_matches(candidate[i], '[0-9]')
    AND length(regexp_replace(candidate[1:i], '[^0-9]', '', 'g')) > 6 AND length(regexp_replace(candidate[1:i], '[^0-9]', '', 'g')) <= length(d) - 4 THEN '*' ELSE candidate[i] END), 'string_agg', '') AS value FROM lit)"""


_ALL_SQL = _with(
    _FILES_SQL, _MAIL_SQL, _pan_sql(list(pan.BRANDS)),
    "flat AS (SELECT filename, 'Email Address' AS datatype, 'email' AS key, value FROM mail_values UNION SELECT filename, 'Primary Account Number', key, value FROM told WHERE valid)",
)

_PATHS_SQL = """paths AS (SELECT page_id, '/' || regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')
    || (['.html', '.txt', '.TXT', '.docx', '.bin', '', '.xlsx', '.pdf', '.tar.json'])[page_id % 9 + 1] AS path,
    CASE WHEN page_id % 4 > 0 THEN (['text/html', 'application/pdf', 'image/png'])[page_id % 4] END AS mime, length(coalesce(html, '')) AS length FROM pages),
suffixed AS (SELECT *, regexp_extract(regexp_extract(path, '([^/]*)/*$', 1), '^.+(\\.[^.]+)$', 1) AS ext FROM paths)"""


def _one_of(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_HANDLER_SQL = "CASE " + " ".join(f"WHEN ext IN {_one_of(h['ext'])} OR mime IN {_one_of(h['mime'])} THEN '{name}'" for name, h in selection.HANDLERS.items()) + " ELSE 'none' END"
_POWERS = [(u, k) for k, u in enumerate(("", "K", "M", "G", "T", "P", "E", "Z"))]

ORACLES: dict[str, str] = {
    "normalize_content": f"SELECT doc_id, length({_clean('text')})::INT AS clean_chars, md5({_clean('text')}) AS clean_md5 FROM documents",
    "email_candidates": _with(_FILES_SQL, _MAIL_SQL) + "SELECT filename, pos, candidate FROM mails",
    "email_valid": _with(_FILES_SQL, _MAIL_SQL) + "SELECT filename, pos, candidate, valid FROM checked",
    "email_redacted": _with(_FILES_SQL, _MAIL_SQL) + "SELECT filename, value FROM mail_values",
    "pan_last_per_brand": _with(_DOCS_SQL, _pan_sql(list(pan.BRANDS))) + """SELECT filename, 'Primary Account Number' AS datatype, key, arg_max(value, pos) AS value FROM told WHERE valid GROUP BY filename, key""",
    "luhn": """SELECT o_orderkey, list_sum(list_transform(range(length(d)), lambda k: CASE WHEN k % 2 = 0 THEN d[length(d) - k]::INT
        ELSE (d[length(d) - k]::INT * 2) // 10 + (d[length(d) - k]::INT * 2) % 10 END)) % 10 = 0 AS valid FROM (SELECT o_orderkey, o_orderkey::VARCHAR AS d FROM orders)""",
    "scan_flat": _ALL_SQL + "SELECT filename, datatype, key, value FROM flat",
    "scan_csv_rows": _ALL_SQL + "SELECT filename, datatype, key || ': ' || value AS value FROM flat",
    "scan_counts": _ALL_SQL + "SELECT filename, count(*) AS results FROM flat GROUP BY filename",
    "scan_nested": _ALL_SQL + r""", keys AS (SELECT filename, datatype, key, '["' || string_agg(replace(replace(value, '\', '\\'), '"', '\"'), '","' ORDER BY value) || '"]' AS listed FROM flat GROUP BY ALL),
types AS (SELECT filename, datatype, '{' || string_agg('"' || key || '":' || listed, ',' ORDER BY key) || '}' AS keys FROM keys GROUP BY ALL)
SELECT filename, '{' || string_agg('"' || datatype || '":' || keys, ',' ORDER BY datatype) || '}' AS matches FROM types GROUP BY filename""",
    "scan_totals": _with(_DOCS_SQL, _MAIL_SQL, _pan_sql(list(pan.BRANDS)), "flat AS (SELECT filename, 'e' AS t, 'email' AS key, value FROM mail_values UNION SELECT filename, 'p', key, value FROM told WHERE valid)") + """
SELECT count(DISTINCT coalesce(source, '')) AS dirs_found, count(*) AS files_found, sum(length(coalesce(text, '')))::BIGINT AS bytes_found,
    count(DISTINCT coalesce(source, '')) FILTER (length(coalesce(text, '')) > 0) AS dirs_scanned, count(*) FILTER (length(coalesce(text, '')) > 0) AS files_scanned,
    sum(length(coalesce(text, '')))::BIGINT AS bytes_scanned, (SELECT count(*) FROM flat) AS total_results FROM documents""",
    "conversation_union": _with(f"files AS (SELECT 'conv-' || conv_id::VARCHAR AS filename, {_clean(_SIGNED)} AS clean FROM conversations)", _MAIL_SQL, _pan_sql(list(pan.BRANDS))) + "SELECT filename, 'Email Address' AS datatype, 'email' AS key, value FROM mail_values UNION SELECT filename, 'Primary Account Number', key, value FROM told WHERE valid",
    "email_literals": _with(
        "files AS (SELECT 'cust-' || c_custkey::VARCHAR AS filename, 'to cust' || c_custkey::VARCHAR || '@[10.' || (c_custkey % 256)::VARCHAR || '.' || (c_custkey % 90)::VARCHAR || '.' || (c_custkey % 290)::VARCHAR || '] and x@y.org' AS clean FROM customer)",
        _MAIL_SQL.replace(_EMAIL, _EMAIL.replace(rf"@(?:{_LABEL}\.)+{_LABEL}", rf"@(?:(?:{_LABEL}\.)+{_LABEL}|{_LITERAL})")),
    ) + "SELECT filename, pos, candidate, valid FROM checked",
    "decoded_texts": r"""SELECT 'doc-' || doc_id::VARCHAR AS path, CASE WHEN doc_id % 3 = 1 THEN 'utf-16' WHEN doc_id % 3 = 2 THEN 'utf-8-sig' WHEN coalesce(text, '') = '' OR controls THEN 'none'
    WHEN regexp_matches(text, '[^\x00-\x7f]') THEN 'utf-8' ELSE 'ascii' END AS encoding, md5(CASE WHEN doc_id % 3 = 0 AND controls THEN '' ELSE coalesce(text, '') END) AS text_md5
FROM (SELECT *, regexp_matches(coalesce(text, ''), '[\x00-\x08\x0e-\x1a\x1c-\x1f]') AS controls FROM documents)""",
    "media_types": r"""SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'application/xml' WHEN 2 THEN 'text/html' WHEN 4 THEN 'text/rtf' WHEN 6 THEN 'application/json'
    WHEN 3 THEN CASE WHEN controls THEN 'none' ELSE 'application/xml' END ELSE CASE WHEN controls OR bare = '' THEN 'none' ELSE 'text/plain' END END AS mime
FROM (SELECT *, regexp_matches(coalesce(text, ''), '[\x00-\x08\x0e-\x1a\x1c-\x1f]') AS controls, trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(13)) AS bare FROM documents)""",
    "content_blocks": rf"""WITH RECURSIVE lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS k FROM documents),
cut AS (SELECT doc_id, k, list_filter(regexp_split_to_array(line, '{_SPACE}'), lambda w: w <> '') AS words FROM lines),
sized AS (SELECT doc_id, k, words, len(words) AS n, coalesce(list_sum(list_transform(words, lambda w: length(w) + 1)), 0)::BIGINT AS size FROM cut),
ended AS (SELECT doc_id, k, sum(size) OVER (PARTITION BY doc_id ORDER BY k)::BIGINT AS stop, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS turn FROM sized),
words AS (SELECT doc_id, k, unnest(words) AS word, unnest(range(n)) AS j FROM sized),
placed AS (SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY k, j) AS place, sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY k, j)::BIGINT AS upto FROM words),
steps AS (
    SELECT doc_id, 0::BIGINT AS turn, 0::BIGINT AS start, 0::BIGINT AS block FROM documents
    UNION ALL SELECT s.doc_id, e.turn, CASE WHEN e.stop - s.start >= 1300 THEN (SELECT min(p.upto) FROM placed p WHERE p.doc_id = s.doc_id AND p.upto >= s.start + 1300) ELSE s.start END,
        s.block + (e.stop - s.start >= 1300)::INT FROM steps s JOIN ended e ON e.doc_id = s.doc_id AND e.turn = s.turn + 1),
starts AS (SELECT doc_id, block, min(start) AS start FROM steps GROUP BY ALL),
spans AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY block), 1000000000000) AS stop FROM starts),
told AS (SELECT p.doc_id, block, string_agg(word, ' ' ORDER BY place) AS content FROM placed p JOIN spans s ON p.doc_id = s.doc_id AND p.upto > s.start AND p.upto <= s.stop GROUP BY ALL)
SELECT 'doc-' || doc_id::VARCHAR AS filename, block, length(content)::INT AS n_chars, md5(content) AS block_md5 FROM told""",
    "written_findings": _with(_DOCS_SQL.replace(" FROM documents)", f" FROM documents WHERE doc_id % {BUCKETS} <> {LEFT_OUT})"), _MAIL_SQL, _pan_sql(list(pan.BRANDS))) + f"""
SELECT DISTINCT substr(filename, 5)::BIGINT % {BUCKETS} AS bucket, datatype, key, value FROM (
    SELECT filename, 'Email Address' AS datatype, 'email' AS key, value FROM mail_values UNION SELECT filename, 'Primary Account Number', key, value FROM told WHERE valid)""",
    "written_totals": _with(_DOCS_SQL.replace(" FROM documents)", f" FROM documents WHERE doc_id % {BUCKETS} <> {LEFT_OUT})"), _MAIL_SQL, _pan_sql(list(pan.BRANDS))) + f""",
flat AS (SELECT DISTINCT substr(filename, 5)::BIGINT % {BUCKETS} AS bucket, key, value FROM (SELECT filename, 'email' AS key, value FROM mail_values UNION SELECT filename, key, value FROM told WHERE valid)),
sized AS (SELECT substr(filename, 5)::BIGINT % {BUCKETS} AS bucket, sum(strlen('begin ' || clean || ' end') + 1)::BIGINT AS n FROM files GROUP BY ALL)
SELECT count(*) AS dirs_found, count(*) AS files_found, sum(n)::BIGINT AS bytes_found, count(*) AS dirs_scanned, count(*) AS files_scanned, sum(n)::BIGINT AS bytes_scanned, (SELECT count(*) FROM flat) AS total_results FROM sized""",
    "yaml_documents": _ALL_SQL + r""", keys AS (SELECT filename, datatype, key, string_agg(chr(10) || '        - ' || chr(39) || replace(value, chr(39), chr(39) || chr(39)) || chr(39), '' ORDER BY value) AS listed FROM flat GROUP BY ALL),
types AS (SELECT filename, datatype, string_agg(chr(10) || '        ' || key || ':' || listed, '' ORDER BY key) AS keys FROM keys GROUP BY ALL)
SELECT filename, '---' || chr(10) || 'filename: ' || chr(39) || filename || chr(39) || chr(10) || 'matches:' || string_agg(chr(10) || '    ' || datatype || ':' || keys, '' ORDER BY datatype) AS document FROM types GROUP BY filename""",
    "file_projection": _with(_PATHS_SQL) + "SELECT page_id, path, ext FROM suffixed",
    "handler_resolve": _with(_PATHS_SQL) + f"SELECT page_id, ext, coalesce(mime, '') AS mime, {_HANDLER_SQL} AS handler FROM suffixed",
    "file_matches": _with(_PATHS_SQL) + "SELECT page_id, ext IN ('.txt', '.docx') OR coalesce(mime IN ('application/pdf'), false) AS matched FROM suffixed WHERE length > 0",
    "exclude_dirs": _with(_PATHS_SQL) + "SELECT page_id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM paths WHERE NOT (starts_with(lower(regexp_extract(path, '^(.*)/[^/]*$', 1)), '/www.') OR starts_with(lower(regexp_extract(path, '^(.*)/[^/]*$', 1)), '/blog.t') OR starts_with(lower(regexp_extract(path, '^(.*)/[^/]*$', 1)), '/m.th*'))",
    "size_format": "SELECT doc_id, CASE " + " ".join(f"WHEN v / {1024.0**k} < 1024 THEN printf('%.1f{u}B', v / {1024.0**k})" for u, k in _POWERS) + " END AS size FROM (SELECT doc_id, (n_chars * n_chars * 37)::DOUBLE AS v FROM documents)",
    "chunked": f"""WITH RECURSIVE cut AS (
    SELECT doc_id, -1 AS pos, '' AS chunk, {_clean('text')} AS rest FROM documents
    UNION ALL SELECT doc_id, pos + 1, substr(rest, 1, n), substr(rest, n + 2) FROM (
        SELECT doc_id, pos, rest, CASE WHEN strpos(substr(rest, 650), ' ') > 0 THEN 648 + strpos(substr(rest, 650), ' ') ELSE length(rest) END AS n FROM cut WHERE rest <> ''))
SELECT doc_id, pos::INT AS pos, length(chunk)::INT AS n_chars, md5(chunk) AS chunk_md5 FROM cut WHERE pos >= 0""",
    "blank_limits": """WITH cells AS (SELECT l_orderkey AS sheet, l_linenumber::BIGINT AS row, k::INT AS col,
    CASE WHEN (l_orderkey + l_linenumber) % 3 = 0 THEN '' WHEN (l_orderkey + l_linenumber * 3 + k) % 4 < 2 THEN l_quantity::INT::VARCHAR ELSE '' END AS value
    FROM lineitem, range(1, 11) t(k)),
seen AS (SELECT *, sum((value = '')::INT) OVER (PARTITION BY sheet, row ORDER BY col) AS blanks FROM cells),
rows AS (SELECT sheet, row, max((value <> '' AND blanks <= 2)::INT) AS data FROM seen GROUP BY ALL),
runs AS (SELECT *, sum(data) OVER (PARTITION BY sheet ORDER BY row) AS run FROM rows),
empties AS (SELECT *, sum(1 - data) OVER (PARTITION BY sheet, run ORDER BY row) AS empty FROM runs),
stops AS (SELECT sheet, min(row) AS stop FROM empties WHERE empty > 1 GROUP BY sheet)
SELECT s.sheet, s.row, s.col, s.value FROM seen s LEFT JOIN stops t ON s.sheet = t.sheet WHERE value <> '' AND blanks <= 2 AND (stop IS NULL OR s.row < stop)""",
} | {f"pan_{b}": _with(_RECEIPTS_SQL, _WITH_RECEIPTS_SQL, _pan_sql([b])) + "SELECT filename, pos, length(candidate)::INT AS n_chars, valid, value FROM told" for b in pan.BRANDS}
