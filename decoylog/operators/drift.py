"""What files hold besides the known fields, and known fields of another JSON type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decoylog.functions.rows import once
from decoylog.schema import INT_FIELDS, JSON_FIELDS

UNKNOWN_FIELD, CHANGED_TYPE = "unknown_field", "changed_type"


def _expected(field: str) -> list[str]:
    """JSON types a field may have; numbers and missing values are read as they should be."""
    if field == "timestamp":
        return ["STRING", "BIGINT", "VOID"]
    return ["BIGINT", "VOID"] if field in INT_FIELDS else ["STRING", "VOID"]


def field_types(lines: DataFrame) -> DataFrame:
    """file_name, log_date, field, json_type and the number of lines that have it so.

    Lines that are no JSON object are left out; of equal keys the last one counts.
    """
    # A key may come twice in a line; without this such a line would not be read.
    lines.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    parsed = once(lines.select("file_name", "log_date", "value"), F.struct(F.try_parse_json("value").alias("line")))
    kind = F.schema_of_variant("line").startswith("OBJECT")
    objects = parsed.select("file_name", "log_date", F.when(kind, F.col("line")).alias("line"))
    fields = objects.lateralJoin(
        objects.sparkSession.tvf.variant_explode(F.col("line").outer())
    )
    kind = F.schema_of_variant("value")
    short = F.when(kind.startswith("OBJECT"), "OBJECT").when(kind.startswith("ARRAY"), "ARRAY").when(
        kind.startswith("DECIMAL"), "DECIMAL"
    )
    typed = once(fields, F.struct(F.coalesce(short, kind).alias("json_type")))
    return typed.groupBy("file_name", "log_date", F.col("key").alias("field"), "json_type").agg(
        F.count(F.lit(1)).alias("lines")
    )


def schema_drift(lines: DataFrame) -> DataFrame:
    """Fields that are not known and types that are not expected, per file: ``problem``."""
    field, kind = F.col("field"), F.col("json_type")
    expected = [F.concat(F.lit(f"{name}:"), F.lit(t)) for name in JSON_FIELDS for t in _expected(name)]
    known = F.concat(field, F.lit(":"), kind).isin(*expected)
    problem = F.when(~field.isin(*JSON_FIELDS), UNKNOWN_FIELD).when(~known, CHANGED_TYPE)
    return field_types(lines).withColumn("problem", problem).where("problem IS NOT NULL")


def file_schemas(lines: DataFrame) -> DataFrame:
    """file_name and the one schema that all JSON lines of the file fit."""
    lines.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return lines.groupBy("file_name").agg(
        F.schema_of_variant_agg(F.try_parse_json("value")).alias("schema")
    )
