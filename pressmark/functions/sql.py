"""The engine's expressions as temporary SQL functions, for those who write SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name(parameters) RETURNS type -> body; Spark inlines them, so they cost what the expression costs.
FUNCTIONS = {
    "text_tokens(t STRING) RETURNS ARRAY<STRING>": r"regexp_extract_all(lower(coalesce(t, '')), '[\\p{L}\\p{N}]+', 0)",
    "quality_bucket(q DOUBLE) RETURNS STRING": "CASE WHEN coalesce(q, 1.0D) >= 0.66D THEN 'high' WHEN coalesce(q, 1.0D) >= 0.33D THEN 'medium' ELSE 'low' END",
    "rrf(position DOUBLE) RETURNS DOUBLE": "1.0D / (60.0D + position)",
    "bm25(tf DOUBLE, dl DOUBLE, n DOUBLE, tokens DOUBLE, df DOUBLE) RETURNS DOUBLE": "ln(1.0D + (n - df + 0.5D) / (df + 0.5D)) * tf * 2.2D / (tf + 1.2D * (0.25D + 0.75D * dl / (tokens / n)))",
    "wilson_low(k DOUBLE, n DOUBLE) RETURNS DOUBLE": "CASE WHEN n > 0 THEN greatest(0.0D, (k / n + 1.9207294103470773D / n - 1.959963984540054D * sqrt(k / n * (1 - k / n) / n + 0.9603647051735387D / (n * n))) / (1 + 3.8414588206941545D / n)) END",
    "wilson_high(k DOUBLE, n DOUBLE) RETURNS DOUBLE": "CASE WHEN n > 0 THEN least(1.0D, (k / n + 1.9207294103470773D / n + 1.959963984540054D * sqrt(k / n * (1 - k / n) / n + 0.9603647051735387D / (n * n))) / (1 + 3.8414588206941545D / n)) END",
}


def register(spark: SparkSession) -> list[str]:
    """Creates the functions in the session; gives their names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.partition("(")[0] for head in FUNCTIONS]
