"""The two name functions, callable from SQL: built from expressions, so that the optimizer sees through them."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "fold_name": "lower(x)",
    "model_key": r"""CASE WHEN regexp_replace(regexp_replace(lower(x), r'[\s_-]+', '-'), r'^-+|-+$', '') LIKE 'claude-%'
      THEN replace(regexp_replace(regexp_replace(lower(x), r'[\s_-]+', '-'), r'^-+|-+$', ''), '.', '-')
      ELSE regexp_replace(regexp_replace(lower(x), r'[\s_-]+', '-'), r'^-+|-+$', '') END""",
}


def register(spark: SparkSession) -> None:
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS STRING RETURN {body}")
