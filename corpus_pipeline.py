"""A corpus pipeline: the training-data operators, one after the other, over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxlake.llm.pipeline import STAGES as _STAGES
from voxlake.llm.pipeline import run_stages

STAGES = _STAGES

# rolling hashes, components and tokenizers are beyond SQL; tests/llm has the brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir."""
    return run_stages(spark, sf_dir, STAGES)
