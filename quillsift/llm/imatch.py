"""I-Match fingerprints in DataFrame operations only.

The lexicon holds the terms whose document frequency lies in a band, counted over all documents. GROUPS lexicons are drawn from it at
random: each term enters PICKS of them, by independent hashes, so they overlap. A text's fingerprint keeps its distinct terms of
the lexicon, sorts them, and hashes those in each drawn lexicon; two fingerprints are as alike as the share of
lexicons, of those that find a term in either text, in which their hashes agree.

Terms are named by their 64-bit hash. As each lexicon term is in at least `low` of all documents, the lexicon has at most
(mean distinct terms of a document) / low terms however large the corpus is; it passes through the driver and reaches the executors as a constant of the plan, a table
of short lists by hash, so that a term is looked up in constant time.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, sha256_hex, text_or_empty

LOW, HIGH, GROUPS, PICKS = 0.005, 0.1, 256, 2
BLOCK_ROWS, MOST_BLOCKS = 512, 1 << 16
#: Lists of the lexicon's table; a list is as long as its terms collide, for any size of the lexicon.
SLOTS = 1 << 14
_TERM_BITS = 52


def terms(text: Column) -> Column:
    """Hashes of the distinct lower-cased words of a text."""
    words = F.split(F.translate(F.lower(text), "\t\n\x0b\x0c\r", "     "), " ")
    return F.array_remove(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def _slot(term: Column) -> Column:
    return F.shiftrightunsigned(term, 40).bitwiseAND(SLOTS - 1).cast("int")


def lexicon(docs: DataFrame, text_col: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """One row: lexicon, an array of SLOTS arrays with the hashes of the terms whose share of the documents lies between `low` and `high`."""
    counts = docs.select(F.explode(terms(text_or_empty(text_col))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = docs.select(F.count("*").alias("n")).scalar()
    held = counts.where((F.col("df") >= low * n) & (F.col("df") <= high * n)).groupBy(_slot(F.col("term")).alias("slot")).agg(F.collect_list("term").alias("held"))
    none = F.array().cast("array<bigint>")
    every = docs.sparkSession.range(SLOTS).select(F.col("id").cast("int").alias("slot")).join(held, "slot", "left").select("slot", F.coalesce("held", none).alias("held"))
    listed = F.sort_array(F.collect_list(F.struct("slot", F.sort_array("held").alias("held"))))
    return settle(every.agg(F.transform(listed, lambda x: x["held"]).alias("lexicon")))


def _constant(held: DataFrame) -> Column:
    """The lexicon's table as a constant; its size has the bound that the module's text tells."""
    return F.from_json(F.lit(held.select(F.to_json("lexicon").alias("told")).first()["told"]), "array<array<bigint>>")


def _let(value: Column, body) -> Column:
    """`body` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def kept_terms(text: Column, lexicon: Column) -> Column:
    """The text's distinct terms of the lexicon."""
    return F.filter(terms(text), lambda t: F.array_contains(F.get(lexicon, _slot(t)), t))


def marks(kept: Column, groups: int = GROUPS, picks: int = PICKS) -> Column:
    """A fingerprint: array<bigint> by drawn lexicon, lexicon * 2^16 + a 16-bit hash of the sorted kept terms in it; lexicons without a term are left out."""
    place = lambda k: lambda t: F.pmod(F.xxhash64(t, F.lit(k)), F.lit(groups))
    entry = lambda k: lambda t: F.shiftleft(place(k)(t), _TERM_BITS) + F.shiftrightunsigned(t, 64 - _TERM_BITS)
    group = lambda e: F.shiftrightunsigned(e, _TERM_BITS)
    drawn = F.sort_array(F.concat(*[F.transform(kept, entry(k)) for k in range(picks)]))

    def hashed(all_: Column) -> Column:
        n = F.size(all_)
        starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (group(F.get(all_, i - 1)) != group(F.get(all_, i - 2))))
        one = lambda a, b: F.shiftleft(group(F.get(all_, a - 1)), 16) + F.xxhash64(F.slice(all_, a, F.coalesce(b, n + 1) - a)).bitwiseAND(0xFFFF)
        return _let(starts, lambda s: F.zip_with(s, F.slice(s, 2, F.size(s)), one))

    return F.when(F.size(kept) > 0, _let(drawn, hashed)).otherwise(F.array().cast("array<bigint>"))


def likeness(a: Column, b: Column, same: Column) -> Column:
    """Share of the lexicons with a term in either text in which both hashes agree; without any, 1 for the `same` text and 0 for others."""
    lexicons = lambda m: F.transform(m, lambda x: F.shiftrightunsigned(x, 16))
    either = F.size(F.array_union(lexicons(a), lexicons(b)))
    return F.when(either > 0, F.size(F.array_intersect(a, b)) / either).otherwise(F.when(same, 1.0).otherwise(0.0))


def told(marks: Column) -> Column:
    """A fingerprint as text: six hex digits a lexicon with terms."""
    return F.array_join(F.transform(marks, lambda m: F.lower(F.lpad(F.hex(m), 6, "0"))), "")


#: Comes before every text's hash.
_LEAST = -(1 << 63)


def _blocks(docs: DataFrame, key: Column, tie: Column) -> list[tuple[int, int]]:
    """The first (key, tie) of ranges of about BLOCK_ROWS rows, MOST_BLOCKS or so at most; they are in the table, so each range knows its first row. A tie of _LEAST stands for all rows of the key.

    An id that many rows share is many ranges, by the texts' hashes.
    """
    seen = docs.agg(F.count("*").alias("n"), F.min(key).alias("least")).first()
    if not seen["n"]:
        return [(0, _LEAST)]
    n = max(1, min(MOST_BLOCKS, seen["n"] // BLOCK_ROWS))
    cuts = docs.agg(F.percentile_approx(key, [k / n for k in range(1, n)] or [0.5], max(10000, 4 * n)).alias("cuts")).first()["cuts"] if n > 1 else []
    firsts = {(k, _LEAST) for k in {seen["least"], *cuts}}
    size = max(BLOCK_ROWS, seen["n"] // MOST_BLOCKS)
    hot = settle(docs.groupBy(key.alias("key")).agg(F.count("*").alias("n")).where(F.col("n") > 4 * size))
    if hot.head(1):
        rows = docs.select(key.alias("key"), tie.alias("tie")).join(hot, "key")
        part = F.floor((F.col("tie").cast("double") / 2.0**64 + 0.5) * F.ceil(F.col("n") / size))
        found = rows.groupBy("key", part.alias("part")).agg(F.min("tie").alias("tie")).collect()
        firsts = {f for f in firsts if f[0] not in {r["key"] for r in found}} | {(r["key"], r["tie"]) for r in found}
    return sorted(firsts)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """(doc_id, marks) for every row of `docs`; a null text counts as empty; equal texts have equal marks."""
    held = _constant(lexicon(docs, text_col, low, high))
    return docs.select(F.col(id_col).alias("doc_id"), kept_terms(text_or_empty(text_col), held).alias("kept")).select("doc_id", marks(F.col("kept")).alias("marks"))


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row of `docs`.

    The edited text's last half is the start of the next document's, by ascending id (null first; rows of one id by their text's
    hash), the first following the last. Texts move once: rows go to the range of their id, and each range's first row also
    goes to the range before. A null text counts as empty, other columns are ignored, an empty table gives an empty one.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST))
    text = text_or_empty(text_col)
    tie = F.xxhash64(text)
    firsts = _blocks(docs, key, tie)
    held = _constant(lexicon(docs, text_col, low, high))
    own = docs.select(key.alias("key"), tie.alias("tie"), F.col(id_col).alias("doc_id"), text.alias("text"), kept_terms(text, held).alias("kept"))
    own = own.select("key", "tie", "doc_id", "text", marks(F.col("kept")).alias("marks"))
    # a range is found in two steps, among every 64th first row and then among the 64 that follow
    listed = lambda pairs: F.from_json(F.lit(json.dumps([{"key": k, "tie": t} for k, t in pairs])), "array<struct<key: bigint, tie: bigint>>")
    cuts, coarse, here = listed(firsts), listed(firsts[::64]), F.struct("key", "tie")
    group = F.size(F.filter(coarse, lambda c: c <= here)) - 1
    block = _let(F.greatest(group, F.lit(0)), lambda g: g * 64 + F.size(F.filter(F.slice(cuts, g * 64 + 1, 64), lambda c: c <= here)) - 1)
    last = len(firsts) - 1
    first = F.element_at(cuts, F.col("block") + 1)
    is_first = (first["key"] == F.col("key")) & first["tie"].isin(F.lit(_LEAST), F.col("tie"))
    home = F.struct(F.col("block"), F.lit(False).alias("guest"))
    guest = F.struct(F.when(F.col("block") > 0, F.col("block") - 1).otherwise(last).alias("block"), F.lit(True).alias("guest"))
    dealt = own.withColumn("block", block).withColumn("at", F.explode(F.when(is_first, F.array(home, guest)).otherwise(F.array(home))))
    rows = dealt.select("key", "tie", "doc_id", "text", "marks", F.col("at.block").alias("block"), F.col("at.guest").alias("guest"))
    order = Window.partitionBy("block").orderBy("guest", "key", "tie")
    met = rows.select("*", F.lead("text").over(order).alias("next_text"), F.lead("marks").over(order).alias("next_marks")).where(~F.col("guest"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    made = met.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), "marks", "next_marks", edited.alias("edited"),
        (F.col("text") == F.col("next_text")).alias("same_next"), F.col("text").alias("text"),
    )
    marked = made.select("*", kept_terms(F.col("edited"), held).alias("kept")).select(
        "doc_id", "n_chars", "marks", "next_marks", "same_next", (F.col("text") == F.col("edited")).alias("same"), sha256_hex(F.col("edited")).alias("edited_sha256"), marks(F.col("kept")).alias("edited_marks")
    )
    return marked.select(
        "doc_id", "n_chars", "edited_sha256", told(F.col("marks")).alias("fingerprint"), told(F.col("edited_marks")).alias("edited_fingerprint"),
        likeness(F.col("marks"), F.col("edited_marks"), F.col("same")).alias("near_edited"), likeness(F.col("marks"), F.col("next_marks"), F.col("same_next")).alias("near_next"),
    )
