"""Secret scans in DataFrame operations only: named patterns, and character Markov models.

Base kinds are found by patterns. The method adds kind `random`: tokens of 16 characters or more whose characters
are likelier under a first-order Markov model of random strings than under one of ordinary identifiers. Both are
counted from labelled samples; the log-ratio of the two is a table of |alphabet|^2 numbers.

One pass over the texts takes the hits and the gaps between them; offsets are running sums over a row's hits,
so a text with a great many hits costs a sort of its hits and no more.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle, sha256_hex, text_or_empty

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"
#: In the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "random")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Log-likelihood ratio a character pair over which a token counts as random.
THRESHOLD = 0.25

#: Words that ordinary identifiers are made of (the labelled samples' fixed part).
_WORDS = (
    "user name file path index count total value table column row page link image title content document text line word number date time start end "
    "first last next previous current default config setting option result error message status code type class method function variable parameter "
    "request response server client session request address account order item price customer supplier nation region part event stream window group "
    "sort filter join select insert update delete create drop view query schema database version build test data model train score label feature"
).split()
#: Words and endings of the languages at hand, for the samples of letters only.
_PROSE = (
    "the and that with have this from they which would there their what about when make like time just know people into year good some could them other than then look only come over "
    "think also back after work first well even want because these most national international misunderstanding responsibility characteristic through thought nothing wheel when where "
    "tion ment ness able ing ed er ion ly re or an un state part world house mother example known thread pool executor http timeout "
    "der die das und ist nicht ein eine mit sich auf dem den des von für auch wird werden haben durch schaft keit heit lich lichkeit ung isch chen ver ber be ge zu ach pfad pfau sch tz geschichte "
    "geschwindigkeit begrenzung kranken versicherung zwischen "
    "le la les des est que dans pour pas une sur avec plus sont elle ou ai eux aux tre oi ette ation ement ique anti constitution elle nous vous mais comme tout faire "
    "el los las una por con para como pero sus este entre cuando muy sin sobre ser tiene también hasta hay donde quien desde todo dad mente ado ando ciones res desafortunada"
).replace("ü", "ue").replace("é", "e").split()


def samples(spark: SparkSession, n: int = 4000, first: int = 0) -> DataFrame:
    """(text, label) built from rules, of the numbers from `first` on (other numbers give other samples, to test with): 1 random strings (hex, base64, letters only), 0 identifiers in snake case, camel case, with numbers and dates, words in small letters and capitals, ruled lines."""
    pick = lambda words, k: F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(words))) + 1).cast("int"))
    word = lambda k: pick(_WORDS, k)
    prose = lambda between: F.concat_ws(between, *(pick(_PROSE, k) for k in range(11, 16)))
    digest = F.sha2(F.col("id").cast("string"), 256)
    base64 = F.regexp_replace(F.base64(F.unhex(digest)), "=", "")
    rows = spark.range(first, first + n)
    letters = F.regexp_replace(base64, "[^A-Za-z]", "")
    random = (
        F.when(F.col("id") % 6 < 2, F.substring(digest, 1, 40)).when(F.col("id") % 6 < 4, F.substring(base64, 1, 32))
        .when(F.col("id") % 6 == 4, F.lower(letters)).otherwise(F.upper(letters))
    )
    number = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1000)).cast("string")
    dated = F.concat_ws("-", word(1), F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd"), word(2))
    ordinary = (
        F.when(F.col("id") % 16 < 3, F.concat_ws("_", word(1), word(2), word(3), number))
        .when(F.col("id") % 16 < 6, F.concat(word(1), F.initcap(word(2)), F.initcap(word(3)), number))
        .when(F.col("id") % 16 < 8, dated)
        .when(F.col("id") % 16 < 11, prose(""))
        .when(F.col("id") % 16 == 11, F.upper(prose("")))
        .when(F.col("id") % 16 == 12, F.upper(F.concat_ws("_", word(1), word(2), word(3))))
        .when(F.col("id") % 16 == 13, F.regexp_replace(F.initcap(prose(" ")), " ", pick(["", "-", "_", "/"], 16)))
        .when(F.col("id") % 16 == 14, F.repeat(pick(list("-_=+/"), 17), 24))
        .otherwise(F.concat_ws("/", word(1), word(2), F.concat(word(3), number)))
    )
    return rows.select(random.alias("text"), F.lit(1).alias("label")).union(rows.select(ordinary.alias("text"), F.lit(0).alias("label")))


def train(labelled: DataFrame) -> list[float]:
    """The log-ratio of the two Markov models from (text, label), as a flat table over pairs of ALPHABET; other characters are left out.

    Counts are made on the executors; at most 2 * |alphabet|^2 of them come back. Nulls and empty texts count nothing.
    """
    n = len(ALPHABET)
    chars = labelled.where("text IS NOT NULL AND length(text) > 1").select("label", "text", F.explode(F.sequence(F.lit(1), F.length("text") - 1)).alias("k"))
    pairs = chars.select("label", F.instr(F.lit(ALPHABET), F.expr("substring(text, k, 1)")).alias("a"), F.instr(F.lit(ALPHABET), F.expr("substring(text, k + 1, 1)")).alias("b"))
    counts = {(r["label"], r["a"], r["b"]): r["n"] for r in pairs.where("a > 0 AND b > 0").groupBy("label", "a", "b").agg(F.count("*").alias("n")).collect()}
    out = []
    for a in range(1, n + 1):
        rows = [[counts.get((label, a, b), 0) + 0.5 for b in range(1, n + 1)] for label in (1, 0)]
        sums = [sum(r) for r in rows]
        out += [math.log(x / sums[0]) - math.log(y / sums[1]) for x, y in zip(*rows)]
    return out


def ratio(token: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio of the token's character pairs."""
    n = len(ALPHABET)
    flat = F.from_json(F.lit(json.dumps([round(x, 6) for x in table])), "array<double>")
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    pairs = F.zip_with(F.slice(codes, 1, F.length(token) - 1), F.slice(codes, 2, F.length(token) - 1), lambda a, b: F.when((a > 0) & (b > 0), F.element_at(flat, (a - 1) * n + b)).otherwise(0.0))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.lit(1), F.length(token) - 1)


def _hits(text: Column, pattern: str, likely: Column) -> Column:
    return F.when(likely, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))


def find(docs: DataFrame, table: list[float], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(row, doc_id, spans): spans holds (start, kind, end), sorted as the contract lists them, in code points, end exclusive.

    One row for each row of `docs`. A null text counts as empty; empty tables give empty tables; repeated rows are scanned
    each on its own; other columns are ignored.
    """
    text = F.col("text")
    patterns = {"assign": (ASSIGN, text.contains("=") | text.contains(":")), "access": (ACCESS, text.contains("AKIA")), "hex": (HEX, F.lit(True)), "random": (TOKEN, F.lit(True))}
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    for kind, (pattern, likely) in patterns.items():
        own = own.withColumn(kind, _hits(text, pattern, likely))
    found = own.select(
        "row", "doc_id",
        *[F.when(F.size(k) > 0, F.arrays_zip(F.transform(F.split(text, patterns[k][0], -1), F.length).alias("gap"), F.col(k).alias("hit"))).alias(k) for k in KINDS],
    )
    found = settle(found)
    rows = None
    for place, kind in enumerate(KINDS):
        one = found.where(F.col(kind).isNotNull()).select("row", F.lit(place).alias("place"), F.posexplode(kind).alias("pos", "x")).select("row", "place", "pos", F.col("x.gap").alias("gap"), F.col("x.hit").alias("hit"))
        rows = one if rows is None else rows.union(one)
    rows = rows.where("hit IS NOT NULL")
    end = F.sum(F.col("gap") + F.length("hit")).over(Window.partitionBy("row", "place").orderBy("pos"))
    holds = (
        F.when(F.col("place") == 0, F.length(F.regexp_extract("hit", ASSIGN, 2)) >= 6)
        .when(F.col("place") == 3, ratio(F.col("hit"), table) > threshold)
        .otherwise(True)
    )
    placed = rows.withColumn("end", end).where(holds).select("row", F.struct((F.col("end") - F.length("hit")).alias("start"), "place", "end").alias("span"))
    spans = placed.groupBy("row").agg(F.sort_array(F.collect_list("span")).alias("spans"))
    none = F.array().cast("array<struct<start: bigint, place: int, end: bigint>>")
    return found.select("row", "doc_id").join(spans, "row", "left").withColumn("spans", F.coalesce("spans", none))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of find()."""
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["place"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["place"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["place"] < 3)
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), sha256_hex(told(base)).alias("base_sha256"), told(F.col("spans")).alias("spans"))
