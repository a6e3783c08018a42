"""CSV texts in, JSON results out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

POSITION = ["_file", "_block", "_row"]


def read_csv_texts(spark: SparkSession, path: str, column: str = "comentario", multi_line: bool = True) -> DataFrame:
    """(_file, _block, _row, comentario) of the named column; empty fields stay empty texts.

    The column is picked by its header, as a schema given by hand would bind by position. The first three
    columns are the place in the input and serve as the key of the row order. ``multi_line`` allows line
    breaks inside quotes but makes each file one task; large inputs should come as many files, or set it
    off where texts hold no line breaks.
    """
    raw = spark.read.options(header=True, multiLine=multi_line, quote='"', escape='"', inferSchema=False).csv(path)
    return raw.select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
        F.coalesce(F.col(f"`{column}`"), F.lit("")).alias("comentario"),
    )


def write_assignments(assigned: DataFrame, path: str) -> None:
    """One JSON object per line and text, written by all tasks."""
    assigned.select("id", "comentario", "cluster").write.mode("overwrite").json(path)


def write_aggregates(found: DataFrame, path: str) -> None:
    """One JSON object per line and cluster in cluster order; noise has no centroid field."""
    found.orderBy("cluster").write.mode("overwrite").json(path)


def assignment_lines(assigned: DataFrame) -> DataFrame:
    """(line_no, line) of one JSON array in id order."""
    row = F.to_json(F.struct("id", "comentario", "cluster"))
    return _enclosed(assigned.select(F.col("id").alias("key"), row.alias("line")), "[", "]")


def aggregate_lines(found: DataFrame) -> DataFrame:
    """(line_no, line) of one JSON object keyed by cluster, lowest first."""
    fields = [c for c in found.columns if c != "cluster"]
    row = F.concat(F.lit('"'), F.col("cluster").cast("string"), F.lit('":'), F.to_json(F.struct(*fields)))
    return _enclosed(found.select(F.col("cluster").cast("bigint").alias("key"), row.alias("line")), "{", "}")


def _enclosed(rows: DataFrame, opening: str, closing: str) -> DataFrame:
    spark = rows.sparkSession
    last = rows.agg(F.max("key").alias("last"))
    comma = rows.join(F.broadcast(last)).select(
        (F.col("key") + 2).alias("line_no"), F.concat("line", F.when(F.col("key") < F.col("last"), F.lit(",")).otherwise(F.lit(""))).alias("line")
    )
    ends = spark.createDataFrame([(-(1 << 62), opening), (1 << 62, closing)], "line_no bigint, line string")
    return comma.unionByName(ends)


def write_document(lines: DataFrame, path: str) -> None:
    """Write (line_no, line) in order; the part files in name order are one document."""
    lines.repartitionByRange("line_no").sortWithinPartitions("line_no").select("line").write.mode("overwrite").text(path)
