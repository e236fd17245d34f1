"""One query per operator over the driver's tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon import rules
from tabulon.functions.sphere import sphere_xyz
from tabulon.functions.text import DATES, NULL_TOKENS, NUMBER, WHITESPACE, value_type
from tabulon.operators import clean as C
from tabulon.operators import profile as P
from tabulon.operators.correlation import correlate
from tabulon.operators.design import design_diagnostics
from tabulon.operators.gwr import kernel_weights
from tabulon.operators.forest import fit_forest, tune_bandwidth, tune_parameters
from tabulon.operators.moran import moran_i, normal_moments, permuted, weight_sums
from tabulon.operators.near import NearGraph, suits, unit
from tabulon.operators.numeric import coercion_report, complete_cases, prepare
from tabulon.operators.regression import Design, analyze, regress
from tabulon.operators.rows import ROW, number_rows, preview
from tabulon.operators.spatial import PARTS, analyze_spatial
from tabulon.operators.weights import components, coordinates, duplicate_coordinates, knn_weights, lag, nearest, row_standardised
from tabulon.plans import found
from tabulon.runtime import cut, table
from tabulon.sinks.reports import analysis_sheets, spatial_report, summary_frame

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- pieces of SQL -----------------------------------------------------------------------------------

_WS = WHITESPACE.replace("'", "''")


def _strip(c: str) -> str:
    return f"trim({c}, '{_WS}')"


def _missing(c: str) -> str:
    return f"({c} IS NULL OR length({_strip(c)}) = 0)"


def _re(p: str) -> str:
    return p.replace(r"\d", r"\p{Nd}").replace("'", "''")


def _kind(c: str) -> str:
    s = _strip(c)
    dates = " OR ".join(f"regexp_full_match({s}, '{_re(d)}')" for d in DATES)
    return (
        f"CASE WHEN lower({s}) IN ('true', 'false') THEN 'boolean' WHEN regexp_full_match({s}, '{_re(NUMBER)}') THEN 'number' "
        f"WHEN {dates} THEN 'datetime' ELSE 'text' END"
    )


_TEXTS = ("name", "age", "city", "score", "visited_on", "consent")
_QUALITY_CELLS = " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS v FROM quality_loads" for c in _TEXTS)


def _quality(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "quality_loads").select(*_TEXTS)


def _issues(spark: SparkSession, d: str) -> DataFrame:
    t = number_rows(table(spark, d, "cleaning_issues").select("row_id", "name", "note"), "row_id")
    return t.select(ROW, "name", "note")


def _people(spark: SparkSession, d: str) -> DataFrame:
    t = number_rows(table(spark, d, "people").select("person_id", "name", "age", "city", "score"), "person_id")
    return t.select(ROW, "name", "age", "city", "score")


_NUMBERED_ISSUES = "(SELECT row_number() OVER (ORDER BY row_id) AS row_number, name, note FROM cleaning_issues)"
_NUMBERED_PEOPLE = "(SELECT row_number() OVER (ORDER BY person_id) AS row_number, name, age, city, score FROM people)"

# --- profile -----------------------------------------------------------------------------------------


@query(
    f"""WITH c AS ({_QUALITY_CELLS}), k AS (SELECT column_name, v, {_missing('v')} AS m, {_kind('v')} AS kind FROM c)
    SELECT column_name, count(*) AS rows, count(*) FILTER (WHERE m) AS missing_count,
      round_even(count(*) FILTER (WHERE m) / count(*)::DOUBLE, 4) AS missing_ratio,
      count(DISTINCT kind) FILTER (WHERE NOT m) > 1 AS mixed_types,
      count(*) FILTER (WHERE NOT m AND v <> {_strip('v')}) AS whitespace_count,
      count(*) FILTER (WHERE NOT m AND (contains(v, chr(10)) OR contains(v, chr(13)))) AS line_break_count
    FROM k GROUP BY column_name"""
)
def profile_columns(spark, d):
    return P.column_counts(_quality(spark, d)).drop("position", "data_type")


@query(
    f"""WITH c AS ({_QUALITY_CELLS}), k AS (SELECT column_name, {_kind('v')} AS kind FROM c WHERE NOT {_missing('v')}),
    n AS (SELECT column_name, kind, count(*) AS n FROM k GROUP BY ALL)
    SELECT column_name, kind, n, CAST(row_number() OVER (PARTITION BY column_name ORDER BY n DESC, kind) AS INTEGER) AS rank FROM n"""
)
def profile_types(spark, d):
    return P.type_histogram(_quality(spark, d))


@query(
    f"""WITH c AS (SELECT row_number, 'name' AS column_name, name AS v FROM {_NUMBERED_ISSUES} UNION ALL SELECT row_number, 'note', note FROM {_NUMBERED_ISSUES}),
    k AS (SELECT *, {_kind('v')} AS kind FROM c WHERE NOT {_missing('v')}),
    r AS (SELECT *, row_number() OVER (PARTITION BY column_name, kind ORDER BY row_number) AS n FROM k)
    SELECT column_name, kind, CAST(n AS INTEGER) AS example_no, v AS example FROM r WHERE n <= 3"""
)
def profile_examples(spark, d):
    return P.type_examples(_issues(spark, d))


@query(
    f"""WITH c AS (SELECT row_number, 'name' AS column_name, name AS v FROM {_NUMBERED_ISSUES} UNION ALL SELECT row_number, 'note', note FROM {_NUMBERED_ISSUES})
    SELECT column_name, 'whitespace' AS issue, row_number FROM c WHERE NOT {_missing('v')} AND v <> {_strip('v')}
    UNION ALL SELECT column_name, 'line_break', row_number FROM c WHERE NOT {_missing('v')} AND (contains(v, chr(10)) OR contains(v, chr(13)))"""
)
def profile_flagged_rows(spark, d):
    return P.flagged_rows(_issues(spark, d))


_DUP = "SELECT name, age, city, score, count(*) AS n, min(row_number) AS f FROM {t} GROUP BY name, age, city, score HAVING count(*) > 1"


@query(
    f"""WITH t AS {_NUMBERED_PEOPLE}, c AS (SELECT
      sum(CASE WHEN {_missing('name')} THEN 1 ELSE 0 END + CASE WHEN {_missing('city')} THEN 1 ELSE 0 END
        + CASE WHEN age IS NULL OR isnan(age) THEN 1 ELSE 0 END + CASE WHEN score IS NULL OR isnan(score) THEN 1 ELSE 0 END)::BIGINT AS missing_cell_count,
      sum(CASE WHEN NOT {_missing('name')} AND name <> {_strip('name')} THEN 1 ELSE 0 END + CASE WHEN NOT {_missing('city')} AND city <> {_strip('city')} THEN 1 ELSE 0 END)::BIGINT AS whitespace_cell_count,
      sum(CASE WHEN NOT {_missing('name')} AND (contains(name, chr(10)) OR contains(name, chr(13))) THEN 1 ELSE 0 END
        + CASE WHEN NOT {_missing('city')} AND (contains(city, chr(10)) OR contains(city, chr(13))) THEN 1 ELSE 0 END)::BIGINT AS line_break_cell_count FROM t)
    SELECT c.*, (SELECT coalesce(sum(n - 1), 0)::BIGINT FROM ({_DUP.format(t='t')})) AS duplicate_row_count FROM c"""
)
def profile_rollup(spark, d):
    return P.table_rollup(_people(spark, d))


@query(f"WITH t AS {_NUMBERED_PEOPLE} SELECT coalesce(sum(n - 1), 0)::BIGINT AS duplicate_row_count FROM ({_DUP.format(t='t')})")
def duplicates_count(spark, d):
    return P.duplicate_count(_people(spark, d))


@query(
    f"""WITH t AS {_NUMBERED_PEOPLE}, w AS (SELECT row_number, min(row_number) OVER p AS first_row, count(*) OVER p AS copies FROM t
      WINDOW p AS (PARTITION BY name, age, city, score)) SELECT * FROM w WHERE copies > 1"""
)
def duplicates_rows(spark, d):
    return P.duplicate_rows(_people(spark, d))


@query(
    f"""WITH c AS ({_QUALITY_CELLS}) SELECT column_name FROM c WHERE NOT {_missing('v')} GROUP BY column_name
    HAVING bool_and({_kind('v')} = 'number') UNION ALL SELECT 'row_no' UNION ALL SELECT 'load_id'"""
)
def eligible_numeric(spark, d):
    return P.eligible_numeric(table(spark, d, "quality_loads"))


@query(f"SELECT line_id, {_kind('raw_text')} AS kind FROM raw_rows")
def detect_type_values(spark, d):
    return table(spark, d, "raw_rows").select("line_id", value_type(F.col("raw_text"), "string").alias("kind"))


# --- cleaning ----------------------------------------------------------------------------------------


_PEOPLE_MISSING = f"({_missing('name')} OR {_missing('city')} OR age IS NULL OR isnan(age) OR score IS NULL OR isnan(score))"


@query(f"WITH t AS {_NUMBERED_PEOPLE} SELECT * RENAME (row_number AS __row_number__) FROM t WHERE NOT {_PEOPLE_MISSING}")
def clean_drop(spark, d):
    return C.clean(_people(spark, d), action="drop_rows")[0]


@query(f"WITH t AS {_NUMBERED_PEOPLE} SELECT row_number FROM t WHERE {_PEOPLE_MISSING}")
def clean_extract(spark, d):
    return C.clean(_people(spark, d), action="extract_rows")[1].select(F.col(ROW).alias("row_number"))


@query(
    f"""SELECT person_id, CASE WHEN {_missing('name')} THEN '0' ELSE name END AS name, CASE WHEN age IS NULL OR isnan(age) THEN 0.0 ELSE age END AS age,
    CASE WHEN {_missing('city')} THEN '0' ELSE city END AS city, CASE WHEN score IS NULL OR isnan(score) THEN 0.0 ELSE score END AS score FROM people"""
)
def clean_fill_zero(spark, d):
    return C.clean(table(spark, d, "people").select("person_id", "name", "age", "city", "score"), action="fill_zero")[0]


_CLEANED = "regexp_replace({s}, '[\\r\\n]+', ' ', 'g')"


@query(f"SELECT row_id, {_CLEANED.format(s=_strip('name'))} AS name, {_CLEANED.format(s=_strip('note'))} AS note FROM cleaning_issues")
def clean_texts(spark, d):
    return C.clean(table(spark, d, "cleaning_issues").select("row_id", "name", "note"), trim=True, breaks=True)[0]


@query(
    f"""SELECT (count(*) FILTER (WHERE {_CLEANED.format(s=_strip('name'))} <> name) + count(*) FILTER (WHERE {_CLEANED.format(s=_strip('note'))} <> note))::BIGINT
    AS changed_cell_count FROM cleaning_issues"""
)
def clean_changed_cells(spark, d):
    return C.changed_cells(table(spark, d, "cleaning_issues").select("row_id", "name", "note"))


_LINE = "l_orderkey, l_linenumber"


@query(
    f"""WITH s AS (SELECT min(l_quantity) a, max(l_quantity) b, min(l_extendedprice) c, max(l_extendedprice) d FROM lineitem)
    SELECT {_LINE}, round_even((l_quantity - a) / (b - a), 6) AS l_quantity, round_even((l_extendedprice - c) / (d - c), 6) AS l_extendedprice FROM lineitem, s"""
)
def scale_min_max(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return C.scale(t, ["l_quantity", "l_extendedprice"], "min_max")[0]


@query(
    f"""WITH s AS (SELECT avg(l_quantity) a, stddev_pop(l_quantity) b, avg(l_discount) c, stddev_pop(l_discount) d FROM lineitem)
    SELECT {_LINE}, round_even((l_quantity - a) / b, 6) AS l_quantity, round_even((l_discount - c) / d, 6) AS l_discount FROM lineitem, s"""
)
def scale_z_score(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return C.scale(t, ["l_quantity", "l_discount"], "z_score")[0]


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, min({c}) AS minimum, max({c}) AS maximum, round_even(avg({c}), 6) AS mean, round_even(stddev_pop({c}), 6) AS standard_deviation FROM spatial_analysis"
        for c in ("income", "outcome")
    )
)
def scale_statistics(spark, d):
    t = table(spark, d, "spatial_analysis").select("income", "outcome")
    return C.scaling_statistics(t, ["income", "outcome"]).select("column_name", "minimum", "maximum", "mean", "standard_deviation")


# --- numeric preparation, correlation, regression ----------------------------------------------------


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(*) AS cells, count(*) FILTER (WHERE {_missing(c)}) AS missing,
        count(*) FILTER (WHERE NOT {_missing(c)} AND {_kind(c)} = 'number') AS numeric,
        count(*) FILTER (WHERE NOT {_missing(c)} AND {_kind(c)} <> 'number') AS invalid FROM quality_loads"""
        for c in ("age", "score")
    )
)
def numeric_coercion(spark, d):
    return coercion_report(table(spark, d, "quality_loads").select("age", "score"), ["age", "score"])


@query(
    """SELECT row_number AS "__row_number__", row_number + 1 AS "__source_row__", income, density::DOUBLE AS density, outcome FROM
    (SELECT row_number() OVER (ORDER BY point_id) AS row_number, income, density, outcome FROM spatial_analysis)
    WHERE income IS NOT NULL AND density IS NOT NULL AND outcome IS NOT NULL AND NOT isnan(income) AND NOT isnan(outcome)"""
)
def numeric_complete_cases(spark, d):
    t = number_rows(table(spark, d, "spatial_analysis").select("point_id", "income", "density", "outcome"), "point_id")
    return complete_cases(t.select(ROW, "income", "density", "outcome"), ["income", "density", "outcome"])


def _correlation(r: dict, spark: SparkSession) -> DataFrame:
    c = r["correlation"]
    return spark.createDataFrame([(r["observations"], r["dropped_rows"], round(c["coefficient"], 9))], "observations long, dropped_rows long, coefficient double")


_COMPLETE = "income IS NOT NULL AND outcome IS NOT NULL AND NOT isnan(income) AND NOT isnan(outcome)"


@query(
    f"""SELECT count(*) FILTER (WHERE {_COMPLETE}) AS observations, count(*) FILTER (WHERE NOT ({_COMPLETE})) AS dropped_rows,
    round(corr(income, outcome) FILTER (WHERE {_COMPLETE}), 9) AS coefficient FROM spatial_analysis"""
)
def corr_pearson(spark, d):
    return _correlation(correlate(table(spark, d, "spatial_analysis"), "pearson", "outcome", ["income"]), spark)


@query(
    f"""WITH c AS (SELECT income, outcome FROM spatial_analysis WHERE {_COMPLETE}),
    r AS (SELECT rank() OVER (ORDER BY income) + (count(*) OVER (PARTITION BY income) - 1) / 2.0 AS a, rank() OVER (ORDER BY outcome) + (count(*) OVER (PARTITION BY outcome) - 1) / 2.0 AS b FROM c)
    SELECT count(*) AS observations, (SELECT count(*) FROM spatial_analysis) - count(*) AS dropped_rows, round(corr(a, b), 9) AS coefficient FROM r"""
)
def corr_spearman(spark, d):
    return _correlation(correlate(table(spark, d, "spatial_analysis"), "spearman", "outcome", ["income"]), spark)


@query("SELECT l_orderkey, l_linenumber, correlation_strength FROM (SELECT l_orderkey, l_linenumber, CASE WHEN abs(l_discount * 10) >= 0.7 THEN 'strong' WHEN abs(l_discount * 10) >= 0.4 THEN 'moderate' ELSE 'weak' END AS correlation_strength FROM lineitem)")
def rule_strength(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rules.correlation_strength(F.col("l_discount") * 10).alias("correlation_strength"))


def _coefficients(spark: SparkSession, rows: list[dict], digits: int | None = None) -> DataFrame:
    cut_ = lambda v: v if v is None or digits is None else round(v, digits)
    names = [c for c in rows[0] if c != "term"]
    return spark.createDataFrame([(r["term"], *(cut_(r[c]) for c in names)) for r in rows], "term string, " + ", ".join(f"{c} double" for c in names))


@query(
    """SELECT 'const' AS term, round(regr_intercept(l_extendedprice, l_quantity), 4) AS estimate FROM lineitem
    UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 4) FROM lineitem"""
)
def ols_simple(spark, d):
    r = regress(table(spark, d, "lineitem").select("l_quantity", "l_extendedprice"), "ols", "l_extendedprice", ["l_quantity"])
    return _coefficients(spark, [{"term": c["term"], "estimate": c["estimate"]} for c in r["regression"]["coefficients"]], 4)


_C3 = "income IS NOT NULL AND density IS NOT NULL AND outcome IS NOT NULL AND NOT isnan(income) AND NOT isnan(outcome)"
_MOMENTS = f"""SELECT count(*)::DOUBLE n, avg(income) mi, avg(density) md, avg(outcome) mo, var_pop(income) vi, var_pop(density::DOUBLE) vd, var_pop(outcome) vo,
    covar_pop(income, density) cid, covar_pop(income, outcome) cio, covar_pop(density, outcome) cdo FROM spatial_analysis WHERE {_C3}"""


@query(
    f"""WITH m AS ({_MOMENTS}), b AS (SELECT *, (vd * cio - cid * cdo) / (vi * vd - cid * cid) AS b1, (vi * cdo - cid * cio) / (vi * vd - cid * cid) AS b2 FROM m)
    SELECT 'const' AS term, round(mo - b1 * mi - b2 * md, 6) AS estimate FROM b UNION ALL SELECT 'income', round(b1, 6) FROM b UNION ALL SELECT 'density', round(b2, 6) FROM b"""
)
def ols_multi(spark, d):
    r = regress(table(spark, d, "spatial_analysis").select("income", "density", "outcome"), "ols", "outcome", ["income", "density"])
    return _coefficients(spark, [{"term": c["term"], "estimate": c["estimate"]} for c in r["regression"]["coefficients"]], 6)


@query(
    f"""WITH m AS ({_MOMENTS}), b AS (SELECT *, (vd * cio - cid * cdo) / (vi * vd - cid * cid) AS b1, (vi * cdo - cid * cio) / (vi * vd - cid * cid) AS b2 FROM m),
    s AS (SELECT *, n * (vo - b1 * cio - b2 * cdo) AS ssr FROM b)
    SELECT round(1 - ssr / (n * vo), 6) AS r_squared, round(1 - ssr / (n * vo) * (n - 1) / (n - 3), 6) AS adjusted_r_squared,
      round(-n / 2 * (ln(2 * pi()) + ln(ssr / n) + 1), 4) AS log_likelihood, round(n * (ln(2 * pi()) + ln(ssr / n) + 1) + 6, 4) AS aic FROM s"""
)
def ols_metrics(spark, d):
    m = regress(table(spark, d, "spatial_analysis").select("income", "density", "outcome"), "ols", "outcome", ["income", "density"])["regression"]["metrics"]
    row = (round(m["r_squared"], 6), round(m["adjusted_r_squared"], 6), round(m["log_likelihood"], 4), round(m["aic"], 4))
    return spark.createDataFrame([row], "r_squared double, adjusted_r_squared double, log_likelihood double, aic double")


@query(
    f"""WITH m AS ({_MOMENTS}) SELECT round(1 / (1 - cid * cid / (vi * vd)), 6) AS max_vif, round(sqrt(greatest(vi, vd) / least(vi, vd)), 6) AS scale_ratio,
    round(sqrt((1 + abs(cid / sqrt(vi * vd))) / (1 - abs(cid / sqrt(vi * vd)))), 6) AS condition_number,
      1 + (vi > 0)::INTEGER + (vi > 0 AND vd > 0 AND 1 - cid * cid / (vi * vd) > 1e-12)::INTEGER AS rank FROM m"""
)
def design_diagnosis(spark, d):
    p = prepare(table(spark, d, "spatial_analysis"), ["outcome", "income", "density"])
    x = Design(p, ["income", "density"], "outcome")
    r = design_diagnostics(x.gram()[1:3, 1:3] / x.n, x.means, x.scales, x.columns)
    row = (round(r["max_vif"], 6), round(r["scale_ratio"], 6), round(r["condition_number"], 6), r["rank"])
    return spark.createDataFrame([row], "max_vif double, scale_ratio double, condition_number double, rank int")


@query(
    f"""WITH m AS ({_MOMENTS}), b AS (SELECT *, (vd * cio - cid * cdo) / (vi * vd - cid * cid) AS b1, (vi * cdo - cid * cio) / (vi * vd - cid * cid) AS b2 FROM m),
    s AS (SELECT *, mo - b1 * mi - b2 * md AS b0, n * (vo - b1 * cio - b2 * cdo) / (n - 3) AS s2, n * (vi * vd - cid * cid) AS det FROM b),
    v AS (SELECT *, s2 * vd / det AS v1, s2 * vi / det AS v2, s2 / n + s2 * (mi * mi * vd + md * md * vi - 2 * mi * md * cid) / det AS v0 FROM s)
    SELECT 'const' AS term, round(sqrt(v0), 8) AS standard_error, round(b0 / sqrt(v0), 4) AS statistic FROM v
    UNION ALL SELECT 'income', round(sqrt(v1), 8), round(b1 / sqrt(v1), 4) FROM v UNION ALL SELECT 'density', round(sqrt(v2), 8), round(b2 / sqrt(v2), 4) FROM v"""
)
def ols_inference(spark, d):
    r = regress(table(spark, d, "spatial_analysis").select("income", "density", "outcome"), "ols", "outcome", ["income", "density"])
    rows = [(c["term"], round(c["standard_error"], 8), round(c["statistic"], 4)) for c in r["regression"]["coefficients"]]
    return spark.createDataFrame(rows, "term string, standard_error double, statistic double")


_RETURNED = "CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END"


@query(
    f"""SELECT 'const' AS term, round(sum({_RETURNED}), 2) AS total FROM lineitem UNION ALL SELECT 'l_quantity', round(sum(l_quantity * {_RETURNED}), 2) FROM lineitem
    UNION ALL SELECT 'l_discount', round(sum(l_discount * {_RETURNED}), 2) FROM lineitem"""
)
def logit_moments(spark, d):
    # At the maximum the fitted probabilities have the outcomes' totals, each term's with its column.
    t = table(spark, d, "lineitem").select(F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("returned"), "l_quantity", "l_discount")
    b = {c["term"]: c["estimate"] for c in analyze(t, "logistic", "returned", ["l_quantity", "l_discount"])["regression"]["coefficients"]}
    terms = {"const": F.lit(1.0), "l_quantity": F.col("l_quantity"), "l_discount": F.col("l_discount")}
    eta = sum(terms[c] * F.lit(v) for c, v in b.items())
    sums = t.agg(*[F.sum(x / (1 + F.exp(-eta))).alias(c) for c, x in terms.items()])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("term"), F.round(c, 2).alias("total")) for c in terms])).alias("r")).select("r.*")


@query(
    """WITH s AS (SELECT avg(income) AS m, stddev_pop(income) AS d FROM spatial_analysis WHERE NOT isnan(income))
    SELECT point_id, CASE WHEN NOT isnan(income) THEN round_even((income - m) / d, 6) END AS income FROM spatial_analysis, s"""
)
def scale_with_missing(spark, d):
    return C.scale(table(spark, d, "spatial_analysis").select("point_id", "income"), ["income"], "z_score")[0].select("point_id", F.when(~F.isnan("income"), F.col("income")).alias("income"))


@query()
def logit_fit(spark, d):
    t = table(spark, d, "lineitem").select(F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("returned"), "l_quantity", "l_discount")
    return _coefficients(spark, analyze(t, "logistic", "returned", ["l_quantity", "l_discount"])["regression"]["coefficients"])


@query()
def negbin_fit(spark, d):
    t = table(spark, d, "spatial_analysis").select("density", "income", "outcome")
    return _coefficients(spark, analyze(t, "negative_binomial", "density", ["income", "outcome"])["regression"]["coefficients"])


# --- spatial -----------------------------------------------------------------------------------------

_SUPPLIER = "(SELECT s_suppkey AS id, ((s_suppkey * 7919) % 10007)::DOUBLE AS x, ((s_suppkey * 104729) % 10009)::DOUBLE AS y, s_acctbal AS v FROM supplier)"
_EDGES = f"""WITH p AS {_SUPPLIER}, e AS (SELECT i, j, distance, rank FROM (SELECT a.id AS i, b.id AS j, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS distance,
    row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), b.id) AS rank FROM p a JOIN p b ON a.id <> b.id) WHERE rank <= 8)"""


def _supplier(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        k.alias("id"),
        ((k * 7919) % 10007).cast("double").alias("x"),
        ((k * 104729) % 10009).cast("double").alias("y"),
        F.col("s_acctbal").alias("v"),
        F.col("s_nationkey").cast("double").alias("n"),
        ((k * 31) % 97).cast("double").alias("u"),
    )


def _numbered_supplier(spark: SparkSession, d: str) -> DataFrame:
    t = _supplier(spark, d)
    value = F.sin(F.col("x") / 3000) * 20 + F.col("n") * 0.7 - F.col("u") * 0.1 + F.col("v") / 5000
    return number_rows(t.withColumn("t", value), "id").drop("id")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return knn_weights(coordinates(_supplier(spark, d), "id", "x", "y", "projected"), 8)


def _points(spark: SparkSession, d: str) -> DataFrame:
    """The usable rows of spatial_analysis: complete, with coordinates on the globe."""
    t = table(spark, d, "spatial_analysis").where("longitude BETWEEN -180 AND 180 AND latitude BETWEEN -90 AND 90")
    return t.select("point_id", "longitude", "latitude", "income", "density", "outcome").dropna()


def _numbered_points(spark: SparkSession, d: str) -> DataFrame:
    return number_rows(_points(spark, d), "point_id", compressed=True).drop("point_id")


def _point_weights(spark: SparkSession, d: str, k: int = 8) -> DataFrame:
    return knn_weights(coordinates(_points(spark, d), "point_id", "longitude", "latitude", "geographic"), k)


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    return _points(spark, d).select(F.col("point_id").alias("id"), F.col("outcome").alias("value"))


@query(f"{_EDGES} SELECT i, j, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM e")
def knn_edges(spark, d):
    e = nearest(coordinates(_supplier(spark, d), "id", "x", "y", "projected"), 8)
    return e.select("i", "j", F.round("distance", 6).alias("distance"), "rank")


@query(f"{_EDGES} SELECT i, j, 0.125::DOUBLE AS w FROM e")
def knn_row_standardised(spark, d):
    return row_standardised(_edges(spark, d))


@query(
    f"""{_EDGES}, m AS (SELECT i, max(distance) AS f FROM e GROUP BY i)
    SELECT e.i, e.j, round(CASE WHEN f <= 0 THEN 1.0 ELSE power(1 - power(distance / f, 2), 2) END, 9) AS w FROM e JOIN m ON e.i = m.i"""
)
def bisquare_weights(spark, d):
    e = nearest(coordinates(_supplier(spark, d), "id", "x", "y", "projected"), 8)
    return kernel_weights(e).withColumn("w", F.round("w", 9))


@query(f"{_EDGES} SELECT e.i AS id, round(avg(p.v), 6) AS lag_v FROM e JOIN p ON e.j = p.id GROUP BY e.i")
def spatial_lag(spark, d):
    return lag(_edges(spark, d), _supplier(spark, d).select("id", "v"), ["v"]).select("id", F.round("lag_v", 6).alias("lag_v"))


@query(
    f"""{_EDGES}, m AS (SELECT avg(v) AS mean, count(*)::DOUBLE AS n FROM p), z AS (SELECT id, v - mean AS z, n FROM p, m)
    SELECT round(max(a.n) / count(*) * 8 * sum(a.z * b.z / 8) / (SELECT sum(z * z) FROM z), 9) AS i,
      round(-1 / (max(a.n) - 1), 9) AS expected_i FROM e JOIN z a ON e.i = a.id JOIN z b ON e.j = b.id"""
)
def moran_statistic(spark, d):
    r = moran_i(cut(_edges(spark, d)), _supplier(spark, d).select("id", F.col("v").alias("value")))
    return r.select(F.round("i", 9).alias("i"), F.round(-1 / (F.col("n") - 1), 9).alias("expected_i"))


@query(
    f"""{_EDGES}, b AS (SELECT sum(CASE WHEN r.i IS NULL THEN 0 ELSE 1 END)::DOUBLE / 64 AS wv FROM e LEFT JOIN e r ON e.i = r.j AND e.j = r.i),
    k AS (SELECT id, (8 + coalesce(n, 0)) / 8.0 AS s FROM p LEFT JOIN (SELECT j, count(*) AS n FROM e GROUP BY j) c ON p.id = c.j),
    q AS (SELECT count(*)::DOUBLE AS n, sum(s * s) AS s2 FROM k)
    SELECT round(n / 8 + wv, 6) AS s1, round(s2, 6) AS s2,
      round((n * n * (n / 8 + wv) - n * s2 + 3 * n * n) / ((n * n - 1) * n * n) - 1 / ((n - 1) * (n - 1)), 12) AS variance FROM q, b"""
)
def moran_moments(spark, d):
    s = weight_sums(cut(_edges(spark, d)))
    n = _supplier(spark, d).count()
    return spark.createDataFrame([(round(s["s1"], 6), round(s["s2"], 6), round(normal_moments(n, s)[1], 12))], "s1 double, s2 double, variance double")


@query()
def moran_permutations(spark, d):
    points = _points(spark, d).withColumn("id", F.col("point_id"))
    if not suits(points.count(), 8):
        return permuted(cut(_point_weights(spark, d)), _outcomes(spark, d))
    graph = NearGraph(points, "longitude", "latitude", "geographic", 8, ["outcome"])
    try:
        return permuted(graph, unit(graph, "outcome"))
    finally:
        graph.drop()


@query()
def points_row_standardised(spark, d):
    return row_standardised(_point_weights(spark, d))


@query()
def points_bisquare(spark, d):
    return kernel_weights(nearest(coordinates(_points(spark, d), "point_id", "longitude", "latitude", "geographic"), 8))


@query()
def points_lag(spark, d):
    return lag(_point_weights(spark, d), _outcomes(spark, d), ["value"])


@query()
def points_moran(spark, d):
    return moran_i(cut(_point_weights(spark, d)), _outcomes(spark, d))


@query()
def points_moments(spark, d):
    s = weight_sums(cut(_point_weights(spark, d)))
    return spark.createDataFrame([(s["s1"], s["s2"], normal_moments(_points(spark, d).count(), s)[1])], "s1 double, s2 double, variance double")


@query()
def points_components(spark, d):
    ids = _points(spark, d).select(F.col("point_id").alias("id"))
    return components(_point_weights(spark, d, 2), ids)


@query(
    f"""WITH RECURSIVE p AS {_SUPPLIER}, e AS (SELECT i, j FROM (SELECT a.id AS i, b.id AS j,
      row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2, b.id) AS rank FROM p a JOIN p b ON a.id <> b.id) WHERE rank <= 2),
    u AS (SELECT i, j FROM e UNION SELECT j, i FROM e), r(id, component) AS (SELECT id, id FROM p UNION SELECT u.j, r.component FROM r JOIN u ON u.i = r.id)
    SELECT id, min(component) AS component FROM r GROUP BY id"""
)
def knn_components(spark, d):
    points = coordinates(_supplier(spark, d), "id", "x", "y", "projected")
    return components(knn_weights(points, 2), points)


@query(
    """WITH g AS (SELECT longitude, latitude, count(*) AS n FROM spatial_analysis WHERE longitude IS NOT NULL AND latitude IS NOT NULL
      AND NOT isnan(longitude) AND NOT isnan(latitude) GROUP BY ALL)
    SELECT count(*) AS distinct_positions, coalesce(sum(n) FILTER (WHERE n > 1), 0)::BIGINT AS rows_at_shared_positions FROM g"""
)
def duplicate_positions(spark, d):
    return duplicate_coordinates(table(spark, d, "spatial_analysis"), "longitude", "latitude")


@query(
    """SELECT point_id, round(cos(radians(latitude)) * cos(radians(longitude)), 9) AS x, round(cos(radians(latitude)) * sin(radians(longitude)), 9) AS y,
    round(sin(radians(latitude)), 9) AS z FROM spatial_analysis WHERE longitude BETWEEN -180 AND 180 AND latitude BETWEEN -90 AND 90"""
)
def sphere_coordinates(spark, d):
    t = table(spark, d, "spatial_analysis").where("longitude BETWEEN -180 AND 180 AND latitude BETWEEN -90 AND 90")
    return t.select("point_id", *[F.round(e, 9).alias(n) for e, n in zip(sphere_xyz(F.col("longitude"), F.col("latitude")), "xyz")])


@query()
def knn_points(spark, d):
    t = table(spark, d, "spatial_analysis").where("longitude BETWEEN -180 AND 180 AND latitude BETWEEN -90 AND 90")
    return nearest(coordinates(t, "point_id", "longitude", "latitude", "geographic"), 8)


@query(
    """WITH p AS (SELECT point_id AS id, cos(radians(latitude)) * cos(radians(longitude)) AS x, cos(radians(latitude)) * sin(radians(longitude)) AS y, sin(radians(latitude)) AS z
      FROM spatial_analysis WHERE longitude BETWEEN -180 AND 180 AND latitude BETWEEN -90 AND 90),
    n AS (SELECT a.id AS i, min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z), 8) AS d FROM p a JOIN p b ON a.id <> b.id GROUP BY a.id)
    SELECT i, unnest(range(1, 9))::INTEGER AS rank, round(sqrt(unnest(d)), 9) AS distance FROM n"""
)
def knn_distances(spark, d):
    return knn_points(spark, d).select("i", "rank", F.round("distance", 9).alias("distance"))


def _spatial(spark: SparkSession, d: str, method: str, *parts: str) -> dict:
    return analyze_spatial(_numbered_points(spark, d), method, "longitude", "latitude", "outcome", ["income", "density"], wanted=parts or PARTS)


@query()
def slm_fit(spark, d):
    return _coefficients(spark, _spatial(spark, d, "slm")["regression"]["coefficients"])


@query()
def sem_fit(spark, d):
    return _coefficients(spark, _spatial(spark, d, "sem", "regression")["regression"]["coefficients"])


@query()
def sdm_impacts(spark, d):
    return _coefficients(spark, _spatial(spark, d, "sdm", "regression")["regression"]["spatial_impacts"])


@query()
def lm_tests(spark, d):
    s = _spatial(spark, d, "slm", "model_selection")["model_selection"]
    rows = [(t["name"], t["statistic"], t["p_value"], s["model"]) for t in s["tests"]]
    return spark.createDataFrame(rows, "name string, statistic double, p_value double, model string")


@query()
def gwr_local(spark, d):
    # spatial_analysis has more rows than the reference admits to GWR.
    return analyze_spatial(_numbered_supplier(spark, d), "gwr", "x", "y", "t", ["n", "u"], kind="projected", neighbors=8)["gwr"]["local"]


_NUMBERED_SUPPLIER = """(SELECT row_number() OVER (ORDER BY s_suppkey) AS id, ((s_suppkey * 7919) % 10007)::DOUBLE AS x, ((s_suppkey * 104729) % 10009)::DOUBLE AS y, s_nationkey::DOUBLE AS n,
    sin(((s_suppkey * 7919) % 10007) / 3000.0) * 20 + s_nationkey * 0.7 - ((s_suppkey * 31) % 97) * 0.1 + s_acctbal / 5000 AS t FROM supplier)"""


@query(
    f"""WITH p AS {_NUMBERED_SUPPLIER}, e AS (SELECT a.id AS i, b.n, b.t, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d,
      row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS rank FROM p a, p b),
    f AS (SELECT i, max(d) * 1.0000001 AS reach FROM e WHERE rank <= 40 GROUP BY i),
    w AS (SELECT i, n, t, CASE WHEN d < reach THEN power(1 - (d / reach) ** 2, 2) ELSE 0 END AS w FROM e JOIN f USING (i)),
    s AS (SELECT i, sum(w) AS s, sum(w * n) AS sn, sum(w * t) AS st, sum(w * n * n) AS snn, sum(w * n * t) AS snt FROM w GROUP BY i)
    SELECT i + 1 AS source_row, round((snt - sn * st / s) / (snn - sn * sn / s), 6) AS slope, round((st - (snt - sn * st / s) / (snn - sn * sn / s) * sn) / s, 6) AS intercept FROM s"""
)
def gwr_fixed(spark, d):
    local = analyze_spatial(_numbered_supplier(spark, d), "gwr", "x", "y", "t", ["n"], kind="projected", neighbors=8, bandwidth=40)["gwr"]["local"]
    return local.select("source_row", F.round("coefficient_n", 6).alias("slope"), F.round("coefficient_CONSTANT", 6).alias("intercept"))


@query(
    f"""WITH p AS {_NUMBERED_SUPPLIER}, c AS (SELECT count(*)::DOUBLE AS m, avg(n) AS mn, avg(t) AS mt, regr_slope(t, n) AS b, regr_intercept(t, n) AS a, sum((n - (SELECT avg(n) FROM p)) ** 2) AS sxx FROM p),
    e AS (SELECT i, j FROM (SELECT a.id AS i, b.id AS j, row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), b.id) AS rank FROM p a JOIN p b ON a.id <> b.id) WHERE rank <= 8),
    r AS (SELECT id, n, t, t - a - b * n AS res, a + b * n AS fit FROM p, c),
    l AS (SELECT e.i AS id, sum(q.res) / 8 AS we, sum(q.t) / 8 AS wy, sum(q.fit) / 8 AS wf FROM e JOIN r q ON q.id = e.j GROUP BY e.i),
    z AS (SELECT sum(res * res) AS ee, sum(res * we) AS ewe, sum(res * wy) AS ewy, var_pop(wf) * count(*) - (covar_pop(wf, n) * count(*)) ** 2 / max(sxx) AS g FROM r JOIN l USING (id), c),
    k AS (SELECT count(*) / 64.0 + (SELECT count(*) FROM e a JOIN e b ON a.i = b.j AND a.j = b.i) / 64.0 AS tr FROM e),
    d AS (SELECT ewe / (ee / m) AS de, ewy / (ee / m) AS dl, g / (ee / m) + tr AS j, tr FROM z, k, c)
    SELECT 'LM-Error' AS name, round(de * de / tr, 6) AS statistic FROM d UNION ALL SELECT 'LM-Lag', round(dl * dl / j, 6) FROM d
    UNION ALL SELECT 'Robust LM-Error', round((de - tr / j * dl) ** 2 / (tr * (1 - tr / j)), 6) FROM d UNION ALL SELECT 'Robust LM-Lag', round((dl - de) ** 2 / (j - tr), 6) FROM d
    UNION ALL SELECT 'LM-SARMA', round(de * de / tr + (dl - de) ** 2 / (j - tr), 6) FROM d"""
)
def lm_statistics(spark, d):
    r = analyze_spatial(_numbered_supplier(spark, d), "slm", "x", "y", "t", ["n"], kind="projected", neighbors=8, permutations=19)
    return spark.createDataFrame([(t["name"], round(t["statistic"], 6)) for t in r["model_selection"]["tests"]], "name string, statistic double")


@query()
def report_spatial(spark, d):
    head, rows = spatial_report(_spatial(spark, d, "sem"))
    return spark.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in rows], ", ".join(f"`{c}` string" for c in head))


@query()
def report_summary(spark, d):
    r = analyze(table(spark, d, "spatial_analysis").select("income", "density", "outcome"), "ols", "outcome", ["income", "density"])
    return summary_frame(spark, analysis_sheets(r)["summary"])


def _forest(spark: SparkSession, d: str, **options) -> dict:
    return fit_forest(_numbered_points(spark, d), "longitude", "latitude", "outcome", ["income", "density"], 30, **options)


@query()
def forest_local(spark, d):
    return _forest(spark, d, shap=True, interactions=True, interaction_columns=["income", "density"], wanted=("local",))["local"]


@query()
def forest_importance(spark, d):
    rows = [tuple(r.values()) for r in _forest(spark, d, fit_method="loocv", wanted=())["importance_summary"]]
    return spark.createDataFrame(rows, "variable string, mean_permutation_importance double, relative_importance double")


@query()
def forest_bandwidth(spark, d):
    r = tune_bandwidth(_numbered_points(spark, d), "longitude", "latitude", "outcome", ["income", "density"], [20, 40])
    return spark.createDataFrame([(x["bandwidth"], x["loocv_rmse"], x["bandwidth"] == r["best_bandwidth"]) for x in r["search_results"]], "bandwidth int, loocv_rmse double, best boolean")


@query()
def forest_grid(spark, d):
    r = tune_parameters(_numbered_points(spark, d), "outcome", ["income", "density"])
    return spark.createDataFrame([tuple(x.values()) for x in r["search_results"]], "n_estimators int, max_depth int, min_samples_split int, cv_rmse double, rank int")


@query("SELECT 'geographic' AS kind, 'longitude' AS x_column, 'latitude' AS y_column")
def rule_coordinates(spark, d):
    return spark.createDataFrame([rules.detect_coordinates(table(spark, d, "spatial_analysis").columns)], "kind string, x_column string, y_column string")


@query(
    """SELECT row_number, c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM
    (SELECT *, row_number() OVER (ORDER BY c_custkey) AS row_number FROM customer) WHERE row_number <= 100"""
)
def preview_rows(spark, d):
    shown = preview(number_rows(table(spark, d, "customer"), "c_custkey"))
    fields = F.from_json("record", "c_custkey long, c_name string, c_nationkey long, c_acctbal double, c_mktsegment string")
    return shown.select("row_number", fields.alias("r")).select("row_number", "r.*")


# --- the dealt problems of the core ------------------------------------------------------------------

_UNIT = "cos(radians(latitude)) * cos(radians(longitude)) AS x, cos(radians(latitude)) * sin(radians(longitude)) AS y, sin(radians(latitude)) AS z"
ORACLES["p1_found"] = f"""WITH p AS (SELECT point_id AS id, longitude AS lon, latitude AS lat, {_UNIT} FROM spatial_analysis
      WHERE longitude BETWEEN -180 AND 180 AND latitude BETWEEN -90 AND 90),
    g AS (SELECT *, floor(x / 1e-5)::BIGINT AS a, floor(y / 1e-5)::BIGINT AS b, floor(z / 1e-5)::BIGINT AS c FROM p),
    o AS (SELECT u.v AS da, w.v AS db, t.v AS dc FROM (VALUES (-1), (0), (1)) u(v), (VALUES (-1), (0), (1)) w(v), (VALUES (-1), (0), (1)) t(v)),
    n AS (SELECT id, lon, lat, a + da AS a, b + db AS b, c + dc AS c FROM g, o),
    near AS (SELECT g.id AS id_a, n.id AS id_b FROM g JOIN n ON g.a = n.a AND g.b = n.b AND g.c = n.c AND g.id < n.id
      WHERE 2 * 6371008.8 * asin(sqrt(least(1.0, power(sin(radians(n.lat - g.lat) / 2), 2) + cos(radians(g.lat)) * cos(radians(n.lat)) * power(sin(radians(n.lon - g.lon) / 2), 2)))) <= 25),
    v AS (SELECT region_id, ring_no, longitude AS ax, latitude AS ay, coalesce(lead(longitude) OVER r, first_value(longitude) OVER r) AS bx, coalesce(lead(latitude) OVER r, first_value(latitude) OVER r) AS cy FROM region_outline
      WINDOW r AS (PARTITION BY region_id, ring_no ORDER BY vertex_no)),
    turned AS (SELECT id, lon + 360 * k.v AS lon, lat FROM p, (VALUES (-1), (0), (1)) k(v)),
    box AS (SELECT region_id, min(ax) x0, max(ax) x1, min(ay) y0, max(ay) y1 FROM v GROUP BY region_id),
    cand AS (SELECT region_id, id, lon, lat FROM turned JOIN box ON lon BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1),
    hit AS (SELECT cand.region_id, id, lon FROM cand JOIN v ON v.region_id = cand.region_id AND (ay > lat) <> (cy > lat)
      AND lon < (bx - ax) * (lat - ay) / (cy - ay) + ax GROUP BY ALL HAVING count(*) % 2 = 1)
    SELECT 'near' AS kind, id_a, id_b FROM near UNION ALL SELECT DISTINCT 'region', region_id, id FROM hit"""

_CELL = r'(?:"(?:[^"]|"")*"|[^"{d}]*)'


def _record(d: str) -> str:
    c = _CELL.format(d=d)
    three = r"\A" + d.join([rf'({c})'] * 3) + r"\z"
    text = lambda k: f"regexp_extract(raw_text, '{three}', {k}, 's')"
    whole = lambda k: f"CASE WHEN starts_with({text(k)}, '\"') THEN replace(substr({text(k)}, 2, length({text(k)}) - 2), '\"\"', '\"') ELSE {text(k)} END"
    return f"""SELECT line_id, regexp_full_match(raw_text, '{c}(?:{d}{c})*', 's') AS ok, len(regexp_replace(raw_text, '"(?:[^"]|"")*"', '', 'gs')) -
      len(replace(regexp_replace(raw_text, '"(?:[^"]|"")*"', '', 'gs'), '{d}', '')) AS n, {whole(2)} AS note, {_strip(whole(3))} AS score FROM r WHERE delimiter = '{d}'"""


_TOKENS = ", ".join("'" + t.replace("'", "''") + "'" for t in NULL_TOKENS)
ORACLES["p2_found"] = f"""WITH r AS (SELECT line_id, raw_text, delimiter FROM raw_rows JOIN raw_files USING (file_id)),
    c AS ({" UNION ALL ".join(_record(d) for d in (",", ";", chr(9)))})
    SELECT line_id, CASE WHEN NOT ok THEN 'quoting' WHEN n <> 2 THEN 'column_count' ELSE 'value' END AS reason FROM c
    WHERE NOT ok OR n <> 2 OR NOT (score IN ({_TOKENS}) OR regexp_full_match(score, '{_re(NUMBER)}')) OR regexp_matches(note, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]')"""

ORACLES["p3_found"] = f"""WITH cells AS ({" UNION ALL ".join(f"SELECT load_id, '{c}' AS column_name, {c} AS v FROM quality_loads" for c in _TEXTS)}),
    k AS (SELECT load_id, column_name, v, CASE WHEN NOT {_missing('v')} THEN {_strip('v')} END AS s FROM cells),
    t AS (SELECT *, CASE WHEN s IS NOT NULL THEN {_kind('s')} END AS kind FROM k),
    u AS (SELECT *, CASE WHEN kind = 'number' THEN try_cast(s AS DOUBLE) END AS num FROM t),
    st AS (SELECT load_id, column_name, count(*)::DOUBLE AS n, count(*) FILTER (WHERE s IS NULL)::DOUBLE AS m, count(DISTINCT kind) AS kinds,
      count(*) FILTER (WHERE s <> v) AS padded, count(DISTINCT s) AS d, min(num) AS lo, max(num) AS hi,
      quantile_cont(num, 0.25) AS q1, quantile_cont(num, 0.5) AS q2, quantile_cont(num, 0.75) AS q3 FROM u GROUP BY ALL),
    o AS (SELECT load_id, lag(load_id) OVER (PARTITION BY feed_id ORDER BY load_no) AS before FROM loads),
    j AS (SELECT a.*, b.n AS pn, b.m AS pm, b.d AS pd, b.q2 AS pq2, b.q3 - b.q1 AS iqr, o.before FROM st a LEFT JOIN o USING (load_id) LEFT JOIN st b ON b.load_id = o.before AND b.column_name = a.column_name),
    f AS (SELECT load_id, column_name, s, count(*)::DOUBLE AS c FROM u WHERE s IS NOT NULL AND column_name IN ('city', 'consent') GROUP BY ALL),
    w AS (SELECT f.load_id, f.column_name, s, c / (n - m) AS share FROM f JOIN st USING (load_id, column_name)),
    p AS (SELECT o.load_id, w.column_name, s, share FROM w JOIN o ON o.before = w.load_id),
    x AS (SELECT coalesce(w.load_id, p.load_id) AS load_id, coalesce(w.column_name, p.column_name) AS column_name, sum(abs(coalesce(w.share, 0) - coalesce(p.share, 0))) / 2 AS shift,
      count(w.s) AS cw, count(p.s) AS cp FROM w FULL JOIN p ON w.load_id = p.load_id AND w.column_name = p.column_name AND w.s = p.s GROUP BY ALL)
    SELECT load_id, column_name, 'mixed_types' AS finding FROM st WHERE kinds > 1
    UNION ALL SELECT load_id, column_name, 'whitespace' FROM st WHERE padded > 0
    UNION ALL SELECT load_id, column_name, 'missing_change' FROM j WHERE abs(m / n - pm / pn) > 0.13
    UNION ALL SELECT load_id, column_name, 'constant' FROM j WHERE d = 1 AND pd >= 2
    UNION ALL SELECT load_id, column_name, 'drift' FROM j WHERE column_name IN ('age', 'score') AND abs(q2 - pq2) > 0.55 * iqr
    UNION ALL SELECT load_id, column_name, 'range' FROM j WHERE column_name IN ('age', 'score') AND greatest(hi - pq2, pq2 - lo) > 10 * iqr
    UNION ALL SELECT load_id, column_name, 'drift' FROM x WHERE cw > 0 AND cp > 0 AND shift > 0.35"""

ORACLES["p3_columns"] = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS rows, count(*) - count({c}) AS null_count, min({c}) AS min_text, max({c}) AS max_text, count(DISTINCT {c}) AS distinct_count FROM quality_loads"
    for c in _TEXTS
)

_CITY = f"CASE WHEN city NOT IN ({_TOKENS}) AND length({_strip('city')}) > 0 THEN city END"
ORACLES["p6_found"] = f"""WITH v AS (SELECT person_id, site_id, recorded_on, (age BETWEEN 0 AND 120) IS TRUE AS age, (score BETWEEN 0 AND 100) IS TRUE AS score, ({_CITY}) IS NOT NULL AS city FROM people),
    c AS ({" UNION ALL ".join(f"SELECT person_id, site_id, recorded_on, '{c}' AS column_name, {c} AS has FROM v" for c in ("age", "score", "city"))}),
    s AS (SELECT DISTINCT site_id, column_name FROM c WHERE has AND site_id IS NOT NULL), d AS (SELECT DISTINCT recorded_on, column_name FROM c WHERE has AND recorded_on IS NOT NULL)
    SELECT person_id, c.column_name, CASE WHEN s.site_id IS NOT NULL THEN 'site' ELSE 'day' END AS filled_from FROM c
    LEFT JOIN s ON c.site_id = s.site_id AND c.column_name = s.column_name LEFT JOIN d ON c.recorded_on = d.recorded_on AND c.column_name = d.column_name
    WHERE NOT has AND (s.site_id IS NOT NULL OR d.recorded_on IS NOT NULL)"""

assert set(ORACLES) - set(QUERIES) <= set(found.QUERIES)
