"""Score arriving samples: the row-local stages on a stream of canonical rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from pyspark.sql import functions as F

from limnos.functions.cells import apply_cells
from limnos.operators.balance import reliability
from limnos.plans.analysis import AnalysisOptions, chemistry


def score(rows: DataFrame, options: AnalysisOptions | None = None) -> DataFrame:
    """Chemistry, facies, limits, indices and diagrams of each row.

    The coordinate system must be declared: guessing it needs the whole table.
    No state and no shuffle, so late or repeated rows need no watermark.
    """
    options = options or AnalysisOptions(crs="4326")
    if options.crs is None:
        raise ValueError("declare the coordinate system of a stream")
    rows = apply_cells(rows)
    return chemistry(rows.withColumn("reliable", reliability(rows)), options)


def score_folder(
    spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str,
    options: AnalysisOptions | None = None, files_per_trigger: int = 1000,
) -> StreamingQuery:
    """Parquet folder in, Parquet folder out; processes what is there and stops."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    scored = score(stream, options).withColumn("scored_at", F.current_timestamp())
    return (
        scored.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
