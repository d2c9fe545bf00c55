"""A whole scan as one plan: files to blocks to findings to results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ScanConfig
from ..functions import registry
from ..operators import results
from ..sinks.writers import fan_out
from ..sources import files


def findings(spark: SparkSession, config: ScanConfig) -> DataFrame:
    """(filename, block, datatype, key, value) of the configured files."""
    return results.findings(files.read_blocks(spark, config, registry.takes_pieces(config.detectors, config.mode)), config.detectors, config.mode, config.lookaround)


def totals(spark: SparkSession, config: ScanConfig) -> DataFrame:
    """Counters of the files that are listed, of those that the scan reads, and of the findings."""
    return results.totals(files.list_files(spark, config), files.selected(spark, config), findings(spark, config))


def run(spark: SparkSession, config: ScanConfig) -> None:
    fan_out(findings(spark, config), config.results)


def errors(spark: SparkSession, config: ScanConfig) -> DataFrame:
    """(filename, error) of the files that couldn't be read."""
    return files.read_blocks(spark, config, pieces=True).where("error IS NOT NULL").select("filename", F.col("error"))
