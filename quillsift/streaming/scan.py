"""The scan as a stream: new files of the start directories, each final after one read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import ScanConfig
from ..functions import registry
from ..operators import results
from ..sinks.writers import WRITERS
from ..sources import files


def stream_findings(spark: SparkSession, config: ScanConfig) -> DataFrame:
    """Findings of files as they arrive below any start directory, excluded ones left out; the state is the list of files seen, kept by each directory's source."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    kept = ("path", "modificationTime", "length") if files.opens(config) else ("path", "modificationTime", "length", "content")
    streams = [spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(d).select(*kept) for d in config.start_dirs]
    listed = files.listed(reduce(DataFrame.union, streams), config)
    found = files.chosen(listed, config)
    blocks = files.extract(files.dealt(found, spark.sparkContext.defaultParallelism) if files.opens(config) else found.select("path", "handler", "content"), registry.takes_pieces(config.detectors, config.mode))
    return results.findings(blocks, config.detectors, config.mode, config.lookaround)


def run(spark: SparkSession, config: ScanConfig, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes each micro-batch to every configured sink, in a folder of its own by batch number, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        for kind, path in config.results.items():
            WRITERS[kind](kept, f"{path}/batch={number}")
        kept.unpersist()

    writer = stream_findings(spark, config).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
