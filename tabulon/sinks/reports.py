"""Result documents as tables, CSV and XLSX."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession

from tabulon.sinks.files import csv_bytes
from tabulon.sources.xlsx import write_xlsx

# The order of the diagnostics in a report.
DIAGNOSTICS = ("converged", "valid_inference", "rank", "parameter_count", "condition_number", "raw_condition_number", "scale_ratio", "max_vif")

Sheet = tuple[list[str], list[Sequence]]


def _items(pairs: Iterable[tuple[str, object]]) -> Sheet:
    return ["item", "value"], [list(p) for p in pairs]


def _records(rows: Sequence[dict]) -> Sheet:
    head = list(rows[0]) if rows else []
    return head, [[r[c] for c in head] for r in rows]


def _frame(df: DataFrame) -> Sheet:
    order = df.orderBy("source_row") if "source_row" in df.columns else df
    return df.columns, [list(r) for r in order.collect()]


def _diagnostics(d: dict) -> list[tuple[str, object]]:
    return [(k, d[k]) for k in DIAGNOSTICS] + [(f"warning_{i}", m) for i, m in enumerate(d["warnings"], 1)]


def analysis_sheets(result: dict) -> dict[str, Sheet]:
    """``summary``, ``coefficients`` (or the correlation) and, if any, ``vif``."""
    pairs: list[tuple[str, object]] = [
        ("method", result["method"]),
        ("observations", result["observations"]),
        ("dropped_rows", result["dropped_rows"]),
        ("dependent_column", result["dependent_column"]),
        ("independent_columns", ", ".join(result["independent_columns"])),
    ]
    if result["correlation"]:
        pairs += result["correlation"].items()
        detail = _records([result["correlation"]])
    else:
        pairs += result["regression"]["metrics"].items()
        detail = _records(result["regression"]["coefficients"])
    out = {}
    if result["diagnostics"]:
        pairs += _diagnostics(result["diagnostics"])
        if result["diagnostics"]["vif"]:
            out["vif"] = _records(result["diagnostics"]["vif"])
    return {"summary": _items(pairs), "coefficients": detail, **out}


def spatial_sheets(result: dict, full: bool = True) -> dict[str, Sheet]:
    """The tables of a spatial result in their order; ``full`` takes every local row."""
    w = result["weights"]
    pairs: list[tuple[str, object]] = [(k, result[k]) for k in ("method", "observations", "dropped_rows", "coordinate_type", "x_column", "y_column", "dependent_column")]
    pairs += [
        ("independent_columns", ", ".join(result["independent_columns"])),
        ("weights_type", w["type"]),
        ("neighbors", w["neighbors"]),
        ("weights_transformation", w["transformation"]),
        ("connected_components", w["components"]),
    ]
    out: dict[str, Sheet] = {}
    if result["moran"]:
        pairs += result["moran"].items()
        out["moran"] = _items(result["moran"].items())
    elif result["regression"]:
        r = result["regression"]
        pairs += r["metrics"].items()
        out["coefficients"] = _records(r["coefficients"])
        if r["spatial_impacts"]:
            out["spatial_impacts"] = _records(r["spatial_impacts"])
    else:
        g = result["gwr"]
        pairs += [("bandwidth", g["bandwidth"]), *g["metrics"].items()]
        out["coefficient_summary"] = _records(g["coefficient_summaries"])
        out["local_results"] = _frame(g["local"] if full else g["local_preview"])
    if result["residual_moran"]:
        pairs += [(f"residual_moran_{k}", v) for k, v in result["residual_moran"].items()]
        out["residual_moran"] = _items(result["residual_moran"].items())
    s = result["model_selection"]
    if s:
        pairs.append(("model_selection_recommendation", s["recommendation"]))
        if s["baseline_residual_moran"]:
            pairs += [(f"baseline_residual_moran_{k}", v) for k, v in s["baseline_residual_moran"].items()]
        if s["tests"]:
            out["model_selection"] = _records([t | {"recommendation": s["recommendation"]} for t in s["tests"]])
    out["summary"] = _items(pairs)
    out["diagnostics"] = _items(_diagnostics(result["diagnostics"]))
    if result["diagnostics"]["vif"]:
        out["vif"] = _records(result["diagnostics"]["vif"])
    return out


def forest_sheets(result: dict, full: bool = True) -> dict[str, Sheet]:
    keys = ("method", "fit_method", "observations", "dropped_rows", "coordinate_type", "x_column", "y_column", "dependent_column")
    pairs: list[tuple[str, object]] = [(k, result[k]) for k in keys]
    pairs += [
        ("independent_columns", ", ".join(result["independent_columns"])),
        *((k, result[k]) for k in ("bandwidth", "bandwidth_optimized", "shap_calculated", "shap_interactions_calculated")),
        ("shap_interaction_columns", ", ".join(result["shap_interaction_columns"])),
        ("parameters_optimized", result["parameters_optimized"]),
        *result["rf_parameters"].items(),
        *result["metrics"].items(),
    ]
    moran = result["residual_moran"] or {}
    pairs += [(f"residual_moran_{k}", v) for k, v in moran.items()]
    out = {
        "summary": _items(pairs),
        "relative_importance": _records(result["importance_summary"]),
        "local_results": _frame(result["local"] if full else result["local_preview"]),
        "residual_moran": _items(moran.items()),
    }
    if result["bandwidth_search"]:
        out["bandwidth_search"] = _records(result["bandwidth_search"])
    return out


def analysis_csv(result: dict) -> bytes:
    return csv_bytes(*analysis_sheets(result)["coefficients"])


def spatial_report(result: dict, full: bool = True) -> Sheet:
    """The main table of a spatial result with constant ``report_*`` columns in front."""
    sheets = spatial_sheets(result, full)
    head, rows = next(sheets[k] for k in ("local_results", "coefficients", "moran", "summary") if k in sheets)
    d = result["diagnostics"]
    meta = {
        "report_method": result["method"],
        "report_observations": result["observations"],
        "report_dropped_rows": result["dropped_rows"],
        "report_coordinate_type": result["coordinate_type"],
        "report_neighbors": result["weights"]["neighbors"],
        "report_converged": d["converged"],
        "report_valid_inference": d["valid_inference"],
        "report_condition_number": d["condition_number"],
        "report_raw_condition_number": d["raw_condition_number"],
        "report_max_vif": d["max_vif"],
        "report_warnings": " | ".join(d["warnings"]),
    }
    if result["residual_moran"]:
        meta |= {"report_residual_moran_i": result["residual_moran"]["i"], "report_residual_moran_p_permutation": result["residual_moran"]["p_permutation"]}
    if result["model_selection"]:
        meta["report_model_recommendation"] = result["model_selection"]["recommendation"]
    return [*meta, *head], [[*meta.values(), *r] for r in rows]


def spatial_csv(result: dict) -> bytes:
    return csv_bytes(*spatial_report(result))


def forest_csv(result: dict) -> bytes:
    return csv_bytes(*forest_sheets(result)["local_results"])


def workbook(sheets: dict[str, Sheet]) -> bytes:
    return write_xlsx(sheets)


def summary_frame(spark: SparkSession, sheet: Sheet) -> DataFrame:
    """A (item, value) sheet as a table of texts."""
    return spark.createDataFrame([(str(a), None if b is None else str(b)) for a, b in sheet[1]], "item string, value string")


class LatestResult:
    """Keeps the latest result under a handle, so that an export needs no second fit; older handles are errors."""

    def __init__(self):
        self._handle, self._result = None, None

    def put(self, result: dict) -> str:
        import uuid

        self._handle, self._result = uuid.uuid4().hex, result
        return self._handle

    def get(self, handle: str) -> dict:
        from tabulon.errors import EngineError

        if handle != self._handle or self._result is None:
            raise EngineError("The result is no longer available; run the analysis again.")
        return self._result
