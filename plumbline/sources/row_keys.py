"""Row identity for tables without a key of their own."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.plans.checks import GENERATED_KEY
from plumbline.sources.storage import scratch_path


def with_row_key(df: DataFrame) -> DataFrame:
    """Adds (`row_file`, `row_index`): where each row is stored.

    A Parquet scan knows the place of every row. Other inputs are written to Parquet once, because a
    generated number would change whenever the plan is run again.
    """
    try:
        return df.select(
            "*", F.col("_metadata.file_path").alias(GENERATED_KEY[0]), F.col("_metadata.row_index").alias(GENERATED_KEY[1])
        )
    except AnalysisException:
        path = scratch_path(df.sparkSession, "rows")
        df.write.parquet(path)
        return with_row_key(df.sparkSession.read.parquet(path))
