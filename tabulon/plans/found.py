"""The dealt problems' queries for the core operators: file tables in, TESTDATA's columns out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.operators.footer_profile import chunk_frequencies, column_quality, load_findings, table_chunks, table_quality, values_of
from tabulon.operators.impute import fill_missing
from tabulon.operators.nearby import containing_regions, draw_pivots, near_pairs, valid_points
from tabulon.operators.rejects import load_records, with_delimiter
from tabulon.functions.text import NULL_TOKENS, strip
from tabulon.runtime import table

RADIUS_M = 25.0


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, outline = table(spark, sf_dir, "spatial_analysis"), table(spark, sf_dir, "region_outline")
    place = ("point_id", "longitude", "latitude")
    pivots = draw_pivots(valid_points(points, *place), 3000)
    near = near_pairs(points, *place, RADIUS_M, pivots=pivots)
    inside = containing_regions(points, outline, *place, pivots=pivots)
    return near.select(F.lit("near").alias("kind"), "id_a", "id_b").unionAll(
        inside.select(F.lit("region").alias("kind"), F.col("region_id").alias("id_a"), F.col("id").alias("id_b"))
    )


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_delimiter(table(spark, sf_dir, "raw_rows"), table(spark, sf_dir, "raw_files").select("file_id", "delimiter"), "file_id", "delimiter")
    return load_records(rows, "raw_text", "delimiter", [("name", "string"), ("note", "string"), ("score", "double")], no_controls_in=["note"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).where("reason is not null").select("line_id", "reason")


def p2_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).where("reason is null").select("line_id", "file_id", "line_no", "name", "note", "score")


PROFILED = ("name", "age", "city", "score", "visited_on", "consent")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = values_of(chunk_frequencies(table(spark, sf_dir, "quality_loads"), "load_id", PROFILED))
    return load_findings(values, table(spark, sf_dir, "loads"), numeric=("age", "score"), categorical=("city", "consent"))


def p3_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column_quality(values_of(chunk_frequencies(table(spark, sf_dir, "quality_loads"), "load_id", PROFILED)))


def p3_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = table_quality(table_chunks(table(spark, sf_dir, "quality_loads"), PROFILED))
    return whole.select("column_name", "rows", "null_count", "min_text", "max_text", "distinct_count")


def p6_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    city = F.col("city")
    return fill_missing(
        table(spark, sf_dir, "people"),
        "person_id",
        numeric={"age": F.when(F.col("age").between(0, 120), F.col("age")), "score": F.when(F.col("score").between(0, 100), F.col("score"))},
        categorical={"city": F.when(~city.isin(*NULL_TOKENS) & (F.length(strip(city)) > 0), city)},
        groups=[("site", F.col("site_id")), ("day", F.col("recorded_on"))],
    ).withColumnRenamed("id", "person_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_filled(spark, sf_dir).select("person_id", "column_name", "filled_from")


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_rows": p2_rows,
    "p3_found": p3_found,
    "p3_profile": p3_profile,
    "p3_columns": p3_columns,
    "p6_found": p6_found,
    "p6_filled": p6_filled,
}
