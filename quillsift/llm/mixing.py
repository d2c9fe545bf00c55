"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations only.

Targets: sources share all words by weight, none above `most` times its own size; the excess is reshared by weight. The
fixed point is min(most * size, level * weight) and the level is found in one sort of the sources by size / weight.

Order: inside a source, documents follow the MD5 of their ids. The running number of words is a
two-level sum (hash bins, then rows of a bin), so a source with most of the rows isn't one task's work.

Curriculum: source s is drawn at the rate target * (1 + slope * (2t - 1)) at time t in [0, 1]. Its integral
target * (t + slope * (t * t - t)) is inverted in closed form at each document's running number of words,
which gives the training position; the copies of a document are one pass of the source apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, settle, text_or_empty

#: Hex digits of the hash that make a bin: 4096 bins a source.
BIN_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size); weights repeat over the sources by code point, null last."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = sizes.select("source", "source_size", weight.cast("long").alias("weight"))
    by_room = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    left = lambda c, k: F.sum(c).over(everything) - k * F.coalesce(F.sum(c).over(before), F.lit(0))
    leveled = weighed.withColumn("level", left("source_size", most) / left("weight", 1)).withColumn("turn", F.row_number().over(by_room))
    fits = F.col("level") <= most * F.col("source_size") / F.col("weight")
    first = leveled.withColumn("level", F.min(F.when(fits, F.struct("turn", "level"))).over(everything)["level"])
    cap = (most * F.col("source_size")).cast("double")
    return first.select("source", "source_size", "weight", F.when(F.col("level").isNull(), cap).otherwise(F.least(cap, F.col("level") * F.col("weight"))).alias("target"))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, whole: bool = False) -> DataFrame:
    """One row for each row of `docs`: doc_id, mark (its text's hash), source, size, source_size, target, taken, start, passes.

    taken is the number of words the mix takes of the document, over all copies. Each source's taken words are its
    target's whole words: full passes over the source, then documents in hash order until the target, the last of
    them cut inside. whole: the last one is taken or left whole, whichever is nearer. start is the document's running number of
    words in its source; documents of one hash come by id, size and mark, so that only rows that are equal may change places. Nulls: a null text has size 0, a null source is a source of its own, a null id comes first.
    Repeated rows are planned each on its own. An empty table gives an empty table.
    """
    own = settle(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_or_empty(text_col)).alias("size"),
            F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("deal"), F.xxhash64(text_or_empty(text_col)).alias("mark"),
        ).withColumn("bin", F.substring("deal", 1, BIN_DIGITS))
    )
    bins = own.groupBy("source", "bin").agg(F.sum("size").alias("words"))
    targets = source_targets(bins.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    base = bins.select("source", "bin", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    known = settle(base.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select("b.source", "bin", "base", "source_size", "target"))
    inside = Window.partitionBy("source", "bin").orderBy("deal", "doc_id", "size", "mark").rowsBetween(Window.unboundedPreceding, -1)
    placed = own.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    met = placed.alias("p").join(known.alias("k"), F.col("p.source").eqNullSafe(F.col("k.source")) & (F.col("p.bin") == F.col("k.bin")))
    row = met.select("doc_id", "mark", "p.source", "size", "source_size", "target", (F.col("base") + F.col("inner")).alias("start"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.floor(F.col("target") - F.col("passes") * F.col("source_size")).cast("long")
    partly = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("start")))
    if whole:
        partly = F.when(2 * partly > F.col("size"), F.col("size")).otherwise(0)
    return row.withColumn("passes", passes).withColumn("taken", F.col("passes") * F.col("size") + partly).select(
        "doc_id", "mark", "source", "size", "source_size", "target", "taken", "start", "passes"
    )


def slope(source: Column) -> Column:
    """A source's slope in the curriculum, in [-1, 1] and fixed by its name: below 0 it is drawn early, above 0 late."""
    digits = F.substring(F.md5(F.coalesce(source, F.lit("")).cast("binary")), 1, 4)
    return (F.conv(digits, 16, 10).cast("long") % 2001 - 1000) / 1000.0


def position(done: Column, target: Column, tilt: Column) -> Column:
    """The time in [0, 1] at which the source has given `done` of its `target` words: the inverse of t + tilt * (t * t - t)."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), done / target))
    line = F.lit(1.0) - tilt
    # both roots of tilt * t^2 + (1 - tilt) * t - share = 0 are covered by the form that doesn't cancel
    root = F.sqrt(F.greatest(F.lit(0.0), line * line + 4 * tilt * share))
    return F.when(target > 0, F.when(share > 0, 2 * share / (line + root)).otherwise(0.0)).otherwise(0.0)


def _at(copy: Column, tilt: Column | None) -> tuple[Column, Column]:
    """The words of a document's copy and its training position."""
    words = F.least(F.col("size"), F.col("taken") - copy * F.col("size"))
    return words, position(copy * F.col("source_size") + F.col("start") + words / 2, F.col("target"), slope(F.col("source")) if tilt is None else tilt)


def copies(planned: DataFrame, tilt: Column | None = None) -> DataFrame:
    """One row for each copy that is taken, with copy, copy_words and position, in no order yet."""
    taken = planned.where("taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("taken") / F.col("size")).cast("long") - 1)))
    words, at = _at(F.col("copy"), tilt)
    return taken.withColumn("copy_words", words).withColumn("position", at)


def curriculum(planned: DataFrame, tilt: Column | None = None) -> DataFrame:
    """The training order: copies() range-sorted by position."""
    return copies(planned, tilt).repartitionByRange("position", "doc_id", "copy").sortWithinPartitions("position", "doc_id", "copy")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The curriculum told by document: one row for each row of `docs`, range-sorted by the position of its first copy (documents that aren't taken last).

    doc_id, size, source_size, target, taken (the words of all its copies in the training order), first_position (null if not taken; a document's first copy is its
    earliest, as positions grow with the words that are done). What plan() says of nulls, repeated rows and empty tables holds.
    """
    planned = plan(docs, id_col, text_col, source_col, weights, most)
    told = planned.select("doc_id", "size", "source_size", "target", "taken", F.when(F.col("taken") > 0, _at(F.lit(0).cast("long"), None)[1]).alias("first_position"))
    last = F.coalesce("first_position", F.lit(2.0))
    # the range bounds are sampled from what is sorted, so it is written first
    return settle(told).repartitionByRange(last, "doc_id").sortWithinPartitions(last, "doc_id")
