"""JSON lines with a fixed schema; a line that does not fit fails the read instead of becoming nulls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

VERSION = "schema_version"


def read(spark: SparkSession, path: str, schema: StructType | str, versions: tuple[str, ...] = ("1",)) -> DataFrame:
    """Rows of the files in path; a row of another schema version fails the read."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if VERSION not in rows.columns:
        return rows
    known = F.col(VERSION).isin(*versions)
    return rows.withColumn(VERSION, F.when(known, F.col(VERSION)).otherwise(F.raise_error(F.concat(F.lit("unsupported schema version "), F.coalesce(VERSION, F.lit("null")))).cast("string")))


def write(rows: DataFrame, path: str) -> None:
    """New files in path; what is there stays."""
    rows.write.mode("append").option("ignoreNullFields", "false").json(path)
