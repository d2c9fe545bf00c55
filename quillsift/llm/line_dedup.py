"""Substring dedup by hashing lines, paragraphs and the pieces of lines.

Each unit is normalised (lower case, runs of white space as one blank) and named by a 128-bit digest; digests are grouped
over all documents; the occurrence that comes first (by document, then offset) stays and the others are removed. Original
offsets are kept in code points.

Lines alone miss what is spliced into the middle of a line, so lines are cut further, at marks that depend on the
neighbouring words only: after . ! ? ; : and before a word in capitals or with a capital initial that follows a word without one. A
passage is cut in the same way wherever it stands. Lines go if they occur earlier; neighbouring pieces go if each occurs earlier
and together they have `run_words` words or more, across line breaks too.

A document is an id and a text: rows that repeat both are one document and share its fate. All keys are functions of a row's own
content, so a lost executor's part can be worked out again.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, ship, text_or_empty, tidy

MIN_WORDS = 1
#: Neighbouring pieces of so many words are a passage. A passage of 50 words is found though its first and last pieces run into other text.
RUN_WORDS = 20
_BREAKS = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n[ \t]*\n\s*")}


def _capitals() -> str:
    """The letters of category Lu as ranges of a pattern's class."""
    codes = [k for k in range(sys.maxunicode + 1) if unicodedata.category(chr(k)) == "Lu"]
    starts = [k for n, k in enumerate(codes) if not n or codes[n - 1] != k - 1]
    ends = [k for n, k in enumerate(codes) if n + 1 == len(codes) or codes[n + 1] != k + 1]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends))


_UPPER, _GAP = _capitals(), r"\x20\x09\x0b-\x0d"
#: What ends right before a piece begins.
_MARK = re.compile(rf"\n|[.!?;:…][{_GAP}]+|(?<![^{_GAP}\n])[^{_UPPER}{_GAP}\n][^{_GAP}\n]*[{_GAP}]+(?=[{_UPPER}])")


def pieces(text: str) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, normalised words) of the pieces that have a word; end is without the white space that follows."""
    at = 0
    for end in [*(m.end() for m in _MARK.finditer(text)), len(text)]:
        part = text[at:end]
        if words := part.lower().encode("utf-8", "surrogatepass").split():
            yield at, at + len(part.rstrip(" \t\n\v\f\r")), b" ".join(words)
        at = end


def split_units(text: str, unit: str = "line", min_words: int = MIN_WORDS, run_words: int = RUN_WORDS) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(start, end, words, place, digest): the lines or paragraphs of `min_words` words or more have place -1, the pieces their running number. No pieces if `run_words` is 0."""
    cut, n, known = list(pieces(text)), 0, {}
    if run_words:
        for place, (start, end, words) in enumerate(cut):
            known[place] = xxhash.xxh3_128_digest(words)
            yield start, end, words.count(b" ") + 1, place, known[place]
    at = 0
    for end, following in [*((m.start(), m.end()) for m in _BREAKS[unit].finditer(text)), (len(text), len(text))]:
        first = n
        while n < len(cut) and cut[n][1] <= end:
            n += 1
        words = b" ".join(c[2] for c in cut[first:n])
        if n > first and words.count(b" ") + 1 >= min_words:
            yield at, end, words.count(b" ") + 1, -1, known.get(first) if n == first + 1 and known else xxhash.xxh3_128_digest(words)
        at = following


def mark(text: Column) -> Column:
    """What tells the texts of one id apart."""
    return F.xxhash64(text)


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), mark(text).alias("mark"), text.alias("text"))


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", min_words: int = MIN_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """(doc_id, mark, start, end, words, place, high, low): every unit of every row of `docs`; a null text counts as empty."""
    names = ("doc_id", "mark", "start", "end", "words", "place", "high", "low")
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # so that the units of a batch stay small
                part = batch.slice(at, 256)
                found = [(k, u) for k, t in enumerate(part.column(2)) for u in split_units(t.as_py(), unit, min_words, run_words)]
                owner = pa.array(np.fromiter((k for k, _ in found), np.int64, len(found)))
                halves = np.frombuffer(b"".join(u[4] for _, u in found), ">i8").astype(np.int64).reshape(-1, 2)
                columns = [part.column(0).take(owner), part.column(1).take(owner)]
                columns += [pa.array(np.fromiter((u[c] for _, u in found), np.int32, len(found))) for c in range(4)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(halves[:, 0]), pa.array(halves[:, 1])], schema=pa.schema(list(zip(names, kinds))))

    ship(docs.sparkSession)
    return _own(docs, id_col, text_col).mapInArrow(tidy(run), "doc_id long, mark long, start int, end int, words int, place int, high long, low long")


def merged(found: list[tuple[int, int, int, int]], run_words: int) -> tuple[list[tuple[int, int]], int]:
    """The spans to remove, in order and apart, and the words of the passages among them, from the repeated units (start, end, words, place)."""
    spans, words, run = [], 0, []

    def close() -> None:
        nonlocal words
        if run_words and sum(u[2] for u in run) >= run_words:
            spans.append((run[0][0], run[-1][1]))
            words += sum(u[2] for u in run)
        run.clear()

    for u in sorted(set(found), key=lambda u: (u[3], u[0])):
        if u[3] < 0:
            spans.append((u[0], u[1]))
        else:
            if run and u[3] != run[-1][3] + 1:
                close()
            run.append(u)
    close()
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out, words


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", min_words: int = MIN_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """(doc_id, mark, passage_words, removed) of each document that loses something, once for each id and text.

    removed are the (start, end) of what occurs earlier, in order, in code points of the original text. Rank is by id (null
    first), mark, offset. Empty and null texts and empty tables have no units; other columns are ignored. Digests are counted before
    they move; a digest that is in a third of the rows is joined back as a table of its own, whose rows may be split between tasks.
    """
    flat = units(docs, id_col, text_col, unit, min_words, run_words).withColumn("line", F.col("place") < 0)
    first = flat.groupBy("high", "low", "line").agg(F.min(F.struct("doc_id", "mark", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
    is_first = F.struct("doc_id", "mark", "start").eqNullSafe(F.col("first"))
    later = flat.join(settle(first.drop("n")), ["high", "low", "line"]).where(~is_first)
    found = later.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "end", "words", "place")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            got = [merged([(u["start"], u["end"], u["words"], u["place"]) for u in f.as_py()], run_words) for f in batch.column(2)]
            spans = pa.array([[{"start": a, "end": b} for a, b in s] for s, _ in got], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([w for _, w in got], pa.int64()), spans], names=["doc_id", "mark", "passage_words", "removed"])

    return found.mapInArrow(tidy(run), "doc_id long, mark long, passage_words long, removed array<struct<start: int, end: int>>").where(F.size("removed") > 0)


def without(text: str, removed: list[tuple[int, int]]) -> str:
    """The text without the spans; with a whole line goes its break, and with a part of one the white space behind it if there is some before it."""
    out, at = [], 0
    for start, end in removed:
        out.append(text[at:start])
        before, after = text[start - 1 : start] or "\n", text[end : end + 1]
        gone = after != "" and (before == "\n" if after == "\n" else before in " \t\n\v\f\r" and after in " \t\v\f\r")
        at = end + gone
    return "".join([*out, text[at:]])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", min_words: int = MIN_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """(doc_id, text, passage_words, removed) for every row of `docs`: what is left of its text, and the spans of the original that went.

    passage_words counts the words that went as passages of several words rather than as lines only. What repeats() says of nulls, repeated rows and empty tables holds; a null
    text comes out empty; a row without removals has its text as it was. Texts are moved once, to meet their spans.
    """
    own, found = _own(docs, id_col, text_col), settle(repeats(docs, id_col, text_col, unit, min_words, run_words))
    met = own.join(found, own["doc_id"].eqNullSafe(found["doc_id"]) & (own["mark"] == found["mark"]), "left")
    none = F.array().cast("array<struct<start: int, end: int>>")
    told = met.select(own["doc_id"], "text", F.coalesce("passage_words", F.lit(0).cast("long")).alias("passage_words"), F.coalesce("removed", none).alias("removed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = [without(t.as_py(), [(x["start"], x["end"]) for x in s.as_py()]) if len(s) else t.as_py() for t, s in zip(batch.column(1), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(left, pa.string()), batch.column(2), batch.column(3)], names=batch.schema.names)

    return told.mapInArrow(tidy(run), "doc_id long, text string, passage_words long, removed array<struct<start: int, end: int>>")
