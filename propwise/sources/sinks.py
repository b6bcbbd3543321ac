"""Sinks.

All writes are one distributed write (no per-row inserts).  Paths are shared
storage; nothing is staged on a machine-local folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded_broadcast, materialize


def overwrite_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                    id_col: str | None = "id") -> None:
    """Truncate-and-reload; ids restart (dense, 1-based, no global sort)."""
    out = with_dense_id(df, id_col) if id_col and id_col not in df.columns else df
    w = out.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def with_dense_id(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Dense 1-based ids without funnelling rows through one task.

    The rows are written first; then a row's id is its place in its file plus the rows of the files
    before it.  Files do not change, so a lost executor gives the same ids again, and no frame is kept.
    """
    place = df.columns
    rows = materialize(df, "numbered").select(*place, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    counts = rows.groupBy("_file").agg((F.max("_row") + 1).alias("_n"))  # one row for each file
    before = F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))
    offsets = bounded_broadcast(counts.select("_file", F.coalesce(before, F.lit(0)).alias("_off")))
    return rows.join(offsets, "_file").withColumn(id_col, F.col("_off") + F.col("_row") + 1).drop("_file", "_row", "_off")


def append_rows(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Append validated corrections (or any ledger rows)."""
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_report_json(df: DataFrame, path: str) -> None:
    """Batch scoring result as JSON lines."""
    df.write.mode("overwrite").json(path)


def write_clustered_csv(df: DataFrame, path: str) -> None:
    """Cleaned rows + cluster id + label as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def event_payload(tool: Column | str, inputs: list[str], outputs: list[str]) -> Column:
    """{tool, input:{...}, output:{...}} as one JSON string per row."""
    t = F.lit(tool) if isinstance(tool, str) else tool
    return F.to_json(F.struct(t.alias("tool"),
                              F.struct(*[F.col(c) for c in inputs]).alias("input"),
                              F.struct(*[F.col(c) for c in outputs]).alias("output")))


def publish_events(df: DataFrame, topic: str, path: str | None = None,
                   kafka_servers: str | None = None) -> None:
    """Publish a ``value`` column to a topic: Kafka when a broker is given, else
    JSON files under ``path/topic=<topic>`` (the file-source twin used in tests)."""
    out = df.select(F.lit(topic).alias("topic"), F.col("value"))
    if kafka_servers:
        (out.write.format("kafka").option("kafka.bootstrap.servers", kafka_servers)
         .option("topic", topic).save())
    else:
        out.write.mode("append").partitionBy("topic").json(path)


def chunked_write(df: DataFrame, path: str, rows_per_file: int = 500, partitions: int | None = None) -> None:
    """Load documents in bounded files (``maxRecordsPerFile``) instead of driver batches."""
    out = df.repartition(partitions) if partitions else df
    out.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)
