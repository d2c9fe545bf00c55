"""What several operators share: shared-folder materialisation and null-safe text."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship  # noqa: F401 - the operators take it from here

#: A word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: what the session names in spark.checkpoint.dir. Where that is unset, a local session gets an own one, and a cluster an error."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quillsift-"))
    return context.getCheckpointDir()


#: For each stage under way, the tables that it has settled.
_UNDER_WAY: list[list[DataFrame]] = []


def settle(frame: DataFrame) -> DataFrame:
    """Write `frame` as Parquet to the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and gives the planner the true size,
    so that it broadcasts what is under spark.sql.autoBroadcastJoinThreshold and nothing else.
    """
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    out = spark.read.schema(frame.schema).parquet(path)
    out.settled_path = path
    for made in _UNDER_WAY:
        made.append(out)
    return out


def forget(*frames: DataFrame) -> None:
    """Deletes settled tables that nothing reads any more; other tables stay."""
    for frame in frames:
        if path := getattr(frame, "settled_path", None):
            spark = frame.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def settle_alone(make: Callable[[], DataFrame]) -> DataFrame:
    """What `make` returns, settled; all that it has settled on the way is deleted."""
    _UNDER_WAY.append([])
    try:
        return settle(make())
    finally:
        forget(*_UNDER_WAY.pop()[:-1])


def clear_settled(spark: SparkSession) -> int:
    """Deletes what settle() has written for this application; to be called when no result that reads it is needed any more. How many tables went."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath() for s in store.listStatus(folder) if s.getPath().getName().startswith("settled-")]
    return sum(bool(store.delete(path, True)) for path in found)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, after which the worker gives memory back to the system; workers are reused, and would keep a task's peak."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return wrapped


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def sha256_hex(value: Column) -> Column:
    return F.sha2(F.encode(value, "UTF-8"), 256)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
