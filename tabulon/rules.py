"""Small rules of presentation: labels, formats, parsing and defaults."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.errors import EngineError

# Names by which coordinate columns are known, compared without case and padding.
LONGITUDE = ("longitude", "lon", "lng", "经度")
LATITUDE = ("latitude", "lat", "纬度")
X = ("x", "x_coord", "x_coordinate", "投影x", "横坐标")
Y = ("y", "y_coord", "y_coordinate", "投影y", "纵坐标")


def detect_coordinates(columns: Sequence[str]) -> tuple[str, str, str] | None:
    """(type, x column, y column): geographic names first, then projected; the first match in column order."""
    plain = [(c, c.strip().lower()) for c in columns]
    for kind, xs, ys in (("geographic", LONGITUDE, LATITUDE), ("projected", X, Y)):
        a = next((c for c, n in plain if n in xs), None)
        b = next((c for c, n in plain if n in ys), None)
        if a is not None and b is not None:
            return kind, a, b
    return None


def correlation_strength(r: Column) -> Column:
    a = F.abs(r)
    return F.when(r.isNull() | F.isnan(r), "undetermined").when(a >= 0.7, "strong").when(a >= 0.4, "moderate").otherwise("weak")


def significant(p: Column, level: float = 0.05) -> Column:
    return F.coalesce(p, F.lit(1.0)) < level


def moran_direction(i: Column, p: Column) -> Column:
    """Clustered, dispersed or random, by the sign of I where it is significant."""
    return F.when(~significant(p), "random").when(i > 0, "clustered").when(i < 0, "dispersed").otherwise("random")


def format_number(v: float | None) -> str:
    """A dash for null; three-digit exponentials below one ten-thousandth; else six decimals."""
    if v is None or v != v:
        return "-"
    return f"{v:.3e}" if v != 0 and abs(v) < 1e-4 else f"{v:.6f}"


def format_ratio(v: float) -> str:
    return f"{v * 100:.2f}%"


def format_size(n: int) -> str:
    for unit, size in (("MB", 1 << 20), ("KB", 1 << 10)):
        if n >= size:
            return f"{n / size:.1f} {unit}"
    return f"{n} B"


def default_neighbors(rows: int) -> int:
    return min(8, max(1, rows - 1))


def parse_candidates(text: str) -> list[int]:
    """Whole numbers separated by commas or white space, each once; empty if any part is not one."""
    parts = [p for p in re.split(r"[,，\s]+", text.strip()) if p]
    return list(dict.fromkeys(map(int, parts))) if all(re.fullmatch(r"[0-9]+", p) for p in parts) else []


def bandwidth_bound(rows: int, fit_method: str) -> int:
    return rows - 1 if fit_method == "loocv" else rows


def importance_width(importance: Sequence[float]) -> list[float]:
    """Widths of bars in per cent of the largest."""
    most = max(importance, default=0.0)
    return [v / most * 100 if most > 0 else 0.0 for v in importance]


def parse_names(text: str) -> list[str]:
    """A JSON array of texts."""
    try:
        v = json.loads(text)
    except json.JSONDecodeError as exc:
        raise EngineError("Not a JSON array.") from exc
    if not isinstance(v, list) or not all(isinstance(x, str) for x in v):
        raise EngineError("Not a JSON array of texts.")
    return v


def parse_integers(text: str) -> list[int]:
    """A JSON array of whole numbers; booleans are none."""
    try:
        v = json.loads(text)
    except json.JSONDecodeError as exc:
        raise EngineError("Not a JSON array.") from exc
    if not isinstance(v, list) or not all(isinstance(x, int) and not isinstance(x, bool) for x in v):
        raise EngineError("Not a JSON array of whole numbers.")
    return v


class ForestWorkflow:
    """Order of steps: parameters, then bandwidth, then the fit; changes undo what depended on them."""

    def __init__(self):
        self.parameters_tuned = self.bandwidth_tuned = False

    def tuned_parameters(self) -> None:
        self.parameters_tuned, self.bandwidth_tuned = True, False

    def tuned_bandwidth(self) -> None:
        if not self.parameters_tuned:
            raise EngineError("Tune the parameters first.")
        self.bandwidth_tuned = True

    def changed_columns(self) -> None:
        self.parameters_tuned = self.bandwidth_tuned = False

    def changed_coordinates_or_parameters(self) -> None:
        self.bandwidth_tuned = False

    def ready(self, automatic: bool) -> bool:
        return not automatic or (self.parameters_tuned and self.bandwidth_tuned)
