"""Queries over the driver's tables for the operators of this subpackage, and their oracles in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.copies import collapse, surplus
from tabulon.llm.lookalikes import unusual_cells
from tabulon.llm.mojibake import Garble, fit, garbled_cells, restore_text
from tabulon.llm.mixing import mix
from tabulon.llm.packing import fill_containers
from tabulon.llm.subjects import fit_lexicon, subjects_of
from tabulon.llm.tokens import count_tokens
from tabulon.runtime import cut, table

_PEOPLE = {"name": "text", "city": "text", "age": "exact", "score": "exact", "recorded_on": "exact"}
_ISSUES = {"score": "exact", "received_on": "exact", "name": "text", "note": "text"}


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = surplus(table(spark, sf_dir, "people"), "person_id", _PEOPLE)
    issues = surplus(table(spark, sf_dir, "cleaning_issues"), "row_id", _ISSUES, [("name", "note")])
    return people.select(F.lit("people").alias("table_name"), "first_id", "copy_id").unionAll(
        issues.select(F.lit("cleaning_issues").alias("table_name"), "first_id", "copy_id")
    )


def p4_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = collapse(table(spark, sf_dir, "people"), "person_id", _PEOPLE)
    issues = collapse(table(spark, sf_dir, "cleaning_issues"), "row_id", _ISSUES, [("name", "note")])
    return people.select(F.lit("people").alias("table_name"), "first_id", "copies").unionAll(
        issues.select(F.lit("cleaning_issues").alias("table_name"), "first_id", "copies")
    )


def _garble(spark: SparkSession, sf_dir: str) -> Garble:
    return fit([(table(spark, sf_dir, "people"), ["name", "city"]), (table(spark, sf_dir, "cleaning_issues"), ["note"])])


def p5_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _garble(spark, sf_dir)
    people = garbled_cells(table(spark, sf_dir, "people"), "person_id", ["name", "city"], model)
    issues = garbled_cells(table(spark, sf_dir, "cleaning_issues"), "row_id", ["note"], model)
    return people.withColumn("table_name", F.lit("people")).unionAll(issues.withColumn("table_name", F.lit("cleaning_issues")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_restored(spark, sf_dir).select("table_name", "row_id", "column_name")


def p7_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = table(spark, sf_dir, "cleaning_issues").select("row_id", "name", "note")
    model = _garble(spark, sf_dir)
    cells = unusual_cells(issues, "row_id", ["name", "note"])
    notes = restore_text(cells, ["original"], model)
    return notes.where(~((F.col("column_name") == "note") & F.col("original_garbled"))).select("row_id", "column_name", "unified")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_unified(spark, sf_dir).select("row_id", "column_name")


def _token_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(count_tokens(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "text"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _token_sizes(spark, sf_dir)
    out = None
    for kind, capacity in sorted(map(tuple, table(spark, sf_dir, "containers").select("container_kind", "capacity_tokens").collect())):
        part = fill_containers(sizes, "doc_id", "tokens", capacity).withColumn("container_kind", F.lit(kind))
        out = part if out is None else out.unionAll(part)
    return out.select("container_kind", "container", "position", F.col("id").alias("doc_id"), "piece", "start", F.col("size").alias("tokens"), F.col("room").alias("room_left"))


def p9_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    used, _ = mix(_token_sizes(spark, sf_dir), "doc_id", "source", "tokens", table(spark, sf_dir, "mix_targets"))
    return used.withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_token_sizes(spark, sf_dir), "doc_id", "source", "tokens", table(spark, sf_dir, "mix_targets"))[1]


def p10_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    # The subjects are few and fixed; each is one row.
    names = [r["subject"] for r in table(spark, sf_dir, "subjects").select("subject").collect()]
    labels = table(spark, sf_dir, "subject_labels")
    lexicon = fit_lexicon(documents, "doc_id", "text", labels, names, parallel="tgt_text")
    return subjects_of(documents, "doc_id", "text", lexicon, address="bundle_id", source="source", labels=labels).withColumnRenamed("id", "doc_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_subjects(spark, sf_dir).select("doc_id", "subject")


QUERIES = {
    "p4_found": p4_found,
    "p4_copies": p4_copies,
    "p5_found": p5_found,
    "p5_restored": p5_restored,
    "p7_found": p7_found,
    "p7_unified": p7_unified,
    "p8_containers": p8_containers,
    "p9_uses": p9_uses,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_subjects": p10_subjects,
}


def _plain(c: str) -> str:
    kept = rf"regexp_replace(coalesce({c}, ''), '[^\p{{L}}\p{{N}}]+', '', 'g')"
    return f"replace(lower(replace(upper({kept}), 'ß', 'SS')), 'ς', 'σ')"


def _same(c: str) -> str:
    return f"coalesce({c}::VARCHAR, '~')"


def _groups(name: str, key: str, parts: list[str]) -> str:
    return f"SELECT '{name}' AS table_name, min({key}) OVER (PARTITION BY {', '.join(parts)}) AS first_id, {key} AS copy_id FROM {name}"


_A, _B = _plain("name"), _plain("note")
_COPIES = " UNION ALL ".join(
    (
        _groups("people", "person_id", [_plain("name"), _plain("city"), _same("age"), _same("score"), _same("recorded_on")]),
        _groups("cleaning_issues", "row_id", [_same("score"), _same("received_on"), f"least({_A}, {_B})", f"greatest({_A}, {_B})"]),
    )
)
ORACLES: dict[str, str] = {
    "p4_found": f"SELECT * FROM ({_COPIES}) WHERE first_id <> copy_id",
    "p4_copies": f"SELECT table_name, first_id, count(*) AS copies FROM ({_COPIES}) GROUP BY ALL",
}
