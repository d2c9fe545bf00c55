"""Files as DataFrames: listing, media types, selection, and extraction to blocks of text.

A listing carries no content. Executors look at the start of each file (of archives, at their directory) and open only what is selected. Plain text
is read in byte ranges that end at line feeds, so that one very large log is many tasks' work and no file has to fit in memory. Files on local or mounted disks are
opened by the workers; of any other store Spark itself reads the selected files whole.
"""

from __future__ import annotations

import contextlib
import io
import os
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ScanConfig
from ..functions.text import suffix
from ..operators import selection
from ..shipping import ship
from . import readers
from .encoding import decode, detect_encoding

#: Bytes of plain text that are a task's unit of work.
RANGE = 128 << 20
#: Characters of text in a batch of blocks.
BATCH_CHARS = 4 << 20
#: Spark reads whole files of other stores up to this size; larger ones are reported.
WHOLE = 1 << 30


def _source(spark: SparkSession):
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true")


def _there(spark: SparkSession, dirs: list[str]) -> list[str]:
    """The start directories that exist."""
    conf, path = spark.sparkContext._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    return [d for d in dirs if path(d).getFileSystem(conf).exists(path(d))]


def _load(spark: SparkSession, config: ScanConfig) -> DataFrame:
    dirs = _there(spark, config.start_dirs)
    return _source(spark).load(dirs) if dirs else spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")


def _plain(path: Column) -> Column:
    return F.regexp_replace(path, r"^file:(?://)?(?=/)", "")


def listed(found: DataFrame, config: ScanConfig) -> DataFrame:
    """(path, dir, ext, length, modified, content if there is one) of what a file source gives, outside of the excluded directories."""
    more = [c for c in ("content",) if c in found.columns]
    own = found.select("path", F.regexp_extract(_plain(F.col("path")), r"^(.*)/[^/]*$", 1).alias("dir"), suffix(F.col("path")).alias("ext"), "length", F.col("modificationTime").alias("modified"), *more)
    return own.where(~selection.excluded(F.col("dir"), config.exclude_dirs, config.start_dirs))


def list_files(spark: SparkSession, config: ScanConfig) -> DataFrame:
    """(path, dir, ext, length, modified) of the files under the start directories; content is not read.

    The listing is Spark's own and parallel, for any store it can read; empty files and names that begin with . or _ are left out of it
    unless `hidden` is set, which walks the directories on the driver and is meant for local disks.
    """
    if config.hidden:
        found = spark.createDataFrame(list(_walk(config)), "path string, length long, modified double").withColumn("modificationTime", F.timestamp_seconds("modified"))
    else:
        found = _load(spark, config).select("path", "length", "modificationTime").dropDuplicates(["path"])
    return listed(found, config)


def _walk(config: ScanConfig) -> Iterator[tuple[str, int, float]]:
    """Files below the start directories, excluded subtrees and linked directories not entered; an unreadable entry skips itself only."""
    todo, seen = list(config.start_dirs), set()
    patterns = [p.lower() for p in config.exclude_dirs]
    while todo:
        try:
            entries = list(os.scandir(todo.pop(0)))
        except OSError:
            continue
        for e in entries:
            try:
                if e.is_dir(follow_symlinks=False):
                    if not e.path.lower().startswith(tuple(patterns)):
                        todo.append(e.path)
                elif e.is_file() and e.path not in seen:
                    seen.add(e.path)
                    stat = e.stat()
                    yield e.path, stat.st_size, stat.st_mtime
            except OSError:
                continue


def opens(config: ScanConfig) -> bool:
    """True if the workers open the files themselves: paths without a scheme, or file:."""
    return all("://" not in d or d.startswith("file:") for d in config.start_dirs)


def _local(path: str) -> str:
    return path[5:] if path.startswith("file:/") and not path.startswith("file://") else path.removeprefix("file://")


@contextlib.contextmanager
def _opened(path: str, content: bytes | None) -> Iterator[BinaryIO]:
    if content is not None:
        yield io.BytesIO(content)
    else:
        with open(_local(path), "rb") as f:
            yield f


def typed(files: DataFrame) -> DataFrame:
    """`files` with mime, by what is in them (column content where there is one, else the workers open path); null if they can't be read or say nothing."""
    ship(files.sparkSession)
    names = files.columns
    has = "content" in names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731, B023
            mimes = []
            for k, path in enumerate(column("path")):
                mime = None
                with contextlib.suppress(OSError), _opened(path.as_py(), (column("content")[k].as_py() or b"") if has else None) as f:
                    mime = selection.media_type_of(f)
                mimes.append(mime)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mimes, pa.string())], names=[*names, "mime"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInArrow(run, f"{kinds}, mime string")


def select(files: DataFrame, config: ScanConfig) -> DataFrame:
    mime = F.col("mime") if "mime" in files.columns else F.lit(None).cast("string")
    return files.where(selection.file_checks(F.col("length"))).where(selection.file_matches(F.col("ext"), mime, config.extensions, config.mimes, config.ignore_case))


def chosen(files: DataFrame, config: ScanConfig) -> DataFrame:
    """Of (path, ext, length, ...), the files that are scanned, with mime and handler."""
    mime = F.col("mime")
    return select(typed(files.where(selection.file_checks(F.col("length")))), config).withColumn("handler", selection.handler(F.lower("ext") if config.ignore_case else F.col("ext"), mime)).where("handler IS NOT NULL")


def selected(spark: SparkSession, config: ScanConfig) -> DataFrame:
    """(path, dir, ext, length, mime, handler) of the files that the scan reads."""
    if opens(config):
        return chosen(list_files(spark, config), config)
    return chosen(listed(_load(spark, config).where(F.col("length") <= WHOLE), config), config).drop("content")


def read_blocks(spark: SparkSession, config: ScanConfig, pieces: bool = False) -> DataFrame:
    """(filename, block, content, error) of every selected file: a row for each block, or one with an error or no content at all. Blocks of a file are in order, not without gaps.

    pieces: plain text comes in small blocks, cut where no card number and no address can stand (readers.cut); a worker then holds some MB of a file.
    """
    if opens(config):
        found = chosen(list_files(spark, config), config)
        return extract(dealt(found, spark.sparkContext.defaultParallelism * 4), pieces)
    whole = listed(_load(spark, config).where(F.col("length") <= WHOLE), config)
    large = select(listed(_load(spark, config).where(F.col("length") > WHOLE).drop("content"), config), config)
    told = large.select(F.col("path").alias("filename"), F.lit(0).cast("long").alias("block"), F.lit(None).cast("string").alias("content"), F.lit("too large for its store").alias("error"))
    return extract(chosen(whole, config).select("path", "handler", "content"), pieces).union(told)


def dealt(files: DataFrame, parts: int) -> DataFrame:
    """(path, handler, start, stop): plain text in ranges of RANGE bytes, other files whole; dealt to tasks by hash, which only moves names."""
    starts = F.when(F.col("handler") == "plaintext", F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(RANGE).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    rows = files.select("path", "handler", "length", F.explode(starts).alias("start"))
    stop = F.when(F.col("handler") == "plaintext", F.least(F.col("length"), F.col("start") + RANGE)).otherwise(F.col("length"))
    return rows.select("path", "handler", "start", stop.alias("stop")).repartition(parts, "path", "start")


def extract(files: DataFrame, pieces: bool = False) -> DataFrame:
    """(filename, block, content, error) from (path, handler) and start, stop or content; a file that can't be read has an error and the scan goes on."""
    ship(files.sparkSession)
    spans = {"start", "stop"} <= set(files.columns)
    schema = pa.schema([("filename", pa.string()), ("block", pa.int64()), ("content", pa.string()), ("error", pa.string())])

    def texts(path: str, handler: str, start: int, stop: int | None, content: bytes | None) -> Iterator[tuple]:
        n = start // RANGE << 32
        try:
            with _opened(path, content) as f:
                for text in readers.read(handler, f, start, stop, pieces):
                    yield path, n, text, None
                    n += 1
                if n == 0:
                    yield path, 0, None, None
        except Exception as e:  # noqa: BLE001 - whatever a reader meets, the other files are read
            yield path, n, None, f"{type(e).__name__}: {e}"[:200]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for path, handler, third, fourth in zip(*(batch.column(k) for k in range(4))):
                where = (third.as_py(), fourth.as_py(), None) if spans else (0, None, third.as_py() or b"")
                for row in texts(path.as_py(), handler.as_py(), *where):
                    rows.append(row)
                    held += len(row[2] or "")
                    if held >= BATCH_CHARS or len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    columns = ("path", "handler", "start", "stop") if spans else ("path", "handler", "content", "handler")
    return files.where(F.col("handler").isNotNull()).select(*columns).mapInArrow(run, "filename string, block long, content string, error string")


def decoded(files: DataFrame) -> DataFrame:
    """(path, encoding, text) from (path, content); both are null where the bytes don't look like text, and a text is told by its first bytes."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = [raw.as_py() or b"" for raw in batch.column(1)]
            names = [detect_encoding(raw) for raw in raws]
            texts = [decode(raw, name) if name else None for raw, name in zip(raws, names)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(texts, pa.string())], names=["path", "encoding", "text"])

    return files.select("path", "content").mapInArrow(run, "path string, encoding string, text string")


def packed(files: DataFrame, size: int = readers.BLOCK) -> DataFrame:
    """(path, block, content) from (path, text): the words of each text in blocks, line by line, as the reader of plain text packs them; empty blocks are left out."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column(0), batch.column(1)):
                blocks = [b for b in readers.pack((text.as_py() or "").split("\n"), size) if b]
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * len(blocks), pa.string()), pa.array(range(len(blocks)), pa.int64()), pa.array(blocks, pa.string())], names=["path", "block", "content"])

    return files.select("path", "text").mapInArrow(run, "path string, block long, content string")
