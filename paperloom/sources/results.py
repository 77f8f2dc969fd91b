"""Search results as JSON rows, one folder per task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

RESULT_SCHEMA = (
    "task_id string, query_id string, paperId string, retrieval_score double, rerank_score double, "
    "score double, user_score int, doi string"
)


def append_results(results: DataFrame, path: str) -> None:
    """Adds result rows. The commit protocol makes a batch visible as a whole."""
    results.write.partitionBy("task_id").mode("append").json(path)


def load_results(spark: SparkSession, path: str, schema: str = RESULT_SCHEMA) -> DataFrame:
    """Stored results; unreadable lines are left out and a missing folder is an empty table.

    Lines are parsed by ``from_json`` rather than by the JSON reader, which skips parsing
    (and so the corruption test) when a query needs no column.
    """
    from pyspark.errors import AnalysisException

    try:
        lines = spark.read.option("ignoreMissingFiles", True).text(path).where(F.trim("value") != "")
    except AnalysisException:
        return spark.createDataFrame([], schema)
    wanted = spark.createDataFrame([], schema).columns
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = lines.withColumn("r", F.from_json("value", schema + ", _corrupt string", options)).where("r._corrupt IS NULL")
    # The task id lives in the folder name, not in the line.
    return parsed.select(*[F.col("task_id").cast("string") if c == "task_id" and c in lines.columns else F.col(f"r.{c}") for c in wanted])
