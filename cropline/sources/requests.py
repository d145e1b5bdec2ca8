"""Prediction requests and results as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Field: whether a field that is present but null is an error.
FIELDS = {
    "state": False, "district": False, "crop": False, "season": False, "area": True,
    "market": False, "commodity": False, "variety": False, "grade": False,
    "year": True, "month": True, "rainfall": True, "min_price": False, "max_price": False,
}

WHOLE = ("year", "month")


def parse_requests(lines: DataFrame, body: str = "value", req_id: Column | None = None) -> DataFrame:
    """Request columns of JSON objects, as text, with ``has_`` flags.

    A field that is absent takes its default, one that is null may be an error:
    the flags keep the two apart. The id is the field ``req_id`` unless given.
    """
    parsed = lines.withColumn("_fields", F.from_json(body, "map<string,string>"))
    fields, whole = F.col("_fields"), F.try_parse_json(body)

    def value(name: str) -> Column:
        if name not in WHOLE:
            return fields[name]
        # A JSON number is cut to its whole part; a text must be a whole number itself.
        kind = F.schema_of_variant(F.try_variant_get(whole, f"$.{name}", "variant"))
        cut = F.try_variant_get(whole, f"$.{name}", "double").cast("bigint").cast("string")
        return F.when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), cut).otherwise(fields[name])

    given = fields["req_id"].cast("bigint") if req_id is None else req_id
    flags = [F.map_contains_key(fields, F.lit(n)).alias(f"has_{n}") for n, strict in FIELDS.items() if strict]
    return parsed.select(given.alias("req_id"), *[value(n).alias(n) for n in FIELDS], *flags)


def read_requests(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Requests from files with one JSON object per line."""
    return parse_requests(spark.read.text(path))


def response_json(results: DataFrame) -> DataFrame:
    """Published results as ``req_id`` and one JSON text."""
    return results.select("req_id", F.to_json(F.struct(*[c for c in results.columns if c != "req_id"])).alias("response"))
