"""Filling missing cells from similar records of the same group, marking what was filled and how.

K-prototypes clustering on the observed numeric and categorical features of all rows: a prototype has
a mean per numeric and a mode per categorical feature; a row's distance to it is the sum of squared
differences in standard deviations plus ``gamma`` per differing category, over the features that the
row has. A cell is filled with the median or mode of its group's rows in its own cluster, else of its
whole group (the parent), else likewise of the next group.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.errors import EngineError
from tabulon.runtime import attach, cut, quantiles, quoted, range_cuts


#: Lloyd rounds after which fitting ends with a warning if prototypes still move.
ROUNDS = 2_000


class Prototypes:
    """Fitted prototypes: one dictionary of feature values per cluster, and the numeric scales."""

    converged = False

    def __init__(self, rows: list[dict], scales: dict[str, float], categorical: Sequence[str], gamma: float):
        self.rows, self.scales, self.categorical, self.gamma = rows, scales, categorical, gamma

    def cluster(self) -> Column:
        """The nearest prototype of a row, the lower number at equal distance; 0 if nothing is observed."""
        best = None
        for k, p in enumerate(self.rows):
            parts = [F.lit(0.0)]
            for c, scale in self.scales.items():
                if p[c] is not None:
                    parts.append(F.coalesce(F.pow((F.col(c) - F.lit(p[c])) / F.lit(scale), 2.0), F.lit(0.0)))
            for c in self.categorical:
                if p[c] is not None:
                    parts.append(F.when(F.col(c) != F.lit(p[c]), F.lit(self.gamma)).otherwise(F.lit(0.0)))
            s = F.struct(reduce(lambda a, b: a + b, parts).alias("d"), F.lit(k).alias("k"))
            best = [s] if best is None else [*best, s]
        return (F.least(*best) if len(best) > 1 else best[0])["k"]


#: Most cells of the summary that comes to the driver, and the categories per feature told apart in it.
CELLS, CATEGORIES = 500_000, 64


class _Summary:
    """All rows as cells: equal bins of each numeric feature, the frequent categories, and what is missing.

    A cell keeps its number of rows and their exact sums, so that prototypes are means over all rows; only the choice
    between prototypes is made per cell. Cells are at most ``CELLS``, whatever the number of rows.
    """

    def __init__(self, df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]):
        of = [f(c).alias(f"{n}{i}") for i, c in enumerate(numeric) for n, f in (("m", F.mean), ("s", F.stddev_pop), ("lo", F.min), ("hi", F.max))]
        r = df.agg(F.count(F.lit(1)).alias("rows"), *of).first()
        self.scale = np.array([r[f"s{i}"] or 1.0 for i in range(len(numeric))])
        self.mean = np.array([np.nan if r[f"m{i}"] is None else r[f"m{i}"] for i in range(len(numeric))])
        self.names = []
        for c in categorical:
            top = df.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(CATEGORIES).collect()
            self.names.append([t[c] for t in top])
        room = CELLS / math.prod(len(n) + 2 for n in self.names)
        bins = max(1, int(room ** (1 / max(1, len(numeric)))) - 1)
        keys, sums = [], []
        for i, c in enumerate(numeric):
            lo, width = r[f"lo{i}"] or 0.0, ((r[f"hi{i}"] or 0.0) - (r[f"lo{i}"] or 0.0)) / bins or 1.0
            keys.append(F.when(F.col(c).isNotNull(), F.least(F.floor((F.col(c) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")).alias(f"b{i}"))
            sums.append(F.sum(c).alias(f"x{i}"))
        for i, (c, names) in enumerate(zip(categorical, self.names)):
            # 0 stands for every category that is not told apart; it equals no prototype's.
            at = F.array_position(F.array(*map(F.lit, names)), F.col(c)) if names else F.lit(0)
            keys.append(F.when(F.col(c).isNotNull(), at.cast("int")).alias(f"k{i}"))
        by = [f"b{i}" for i in range(len(numeric))] + [f"k{i}" for i in range(len(categorical))]
        cells = df.select(*keys, *numeric).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *sums).orderBy(*by).toPandas()
        self.n = cells["n"].to_numpy(float)
        self.x = np.array([cells[f"x{i}"].to_numpy(float) / self.n for i in range(len(numeric))]).reshape(len(numeric), len(cells))
        self.k = np.array([cells[f"k{i}"].fillna(-1).to_numpy(int) for i in range(len(categorical))]).reshape(len(categorical), len(cells))

    def move(self, centre: np.ndarray, mode: np.ndarray, gamma: float) -> tuple[np.ndarray, np.ndarray]:
        """Means (clusters x numeric) and modes (clusters x categorical, numbers from 1) of the cells nearest to each prototype."""
        away = np.zeros((len(centre), len(self.n)))
        for j in range(len(centre)):
            for i, x in enumerate(self.x):
                away[j] += np.nan_to_num(((x - centre[j, i]) / self.scale[i]) ** 2)
            for i, k in enumerate(self.k):
                if mode[j, i] > 0:
                    away[j] += gamma * ((k >= 0) & (k != mode[j, i]))
        own = away.argmin(axis=0)
        centre, mode = centre.copy(), mode.copy()
        for i, x in enumerate(self.x):
            known = ~np.isnan(x)
            n = np.bincount(own[known], self.n[known], len(centre))
            total = np.bincount(own[known], self.n[known] * x[known], len(centre))
            centre[n > 0, i] = total[n > 0] / n[n > 0]
        for i, k in enumerate(self.k):
            known = k > 0
            n = np.bincount(own[known] * (CATEGORIES + 1) + k[known], self.n[known], len(centre) * (CATEGORIES + 1)).reshape(len(centre), -1)
            some = n.max(axis=1) > 0
            mode[some, i] = n[some].argmax(axis=1)
        return centre, mode


def fit_prototypes(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], *, clusters: int = 8, rounds: int = ROUNDS, gamma: float = 1.0
) -> Prototypes:
    """Lloyd rounds over a summary of all rows (``_Summary``), made in one pass.

    Starts from prototypes spread along the first numeric feature's range and the most frequent
    categories, and ends when no prototype moves, or with a warning after ``rounds``. An empty cluster
    keeps its prototype. Without rows there is one prototype of nulls.
    """
    if clusters < 1 or rounds < 0:
        raise EngineError("At least one cluster and no negative number of rounds.")
    cells = _Summary(df, numeric, categorical)
    spread = lambda k: 0.0 if clusters == 1 else 3.0 * k / (clusters - 1) - 1.5
    steps = np.array([[spread((k * (i + 1)) % clusters) for i in range(len(numeric))] for k in range(clusters)]).reshape(clusters, len(numeric))
    centre = cells.mean + steps * cells.scale
    mode = np.array([[1 + k % len(n) if n else 0 for n in cells.names] for k in range(clusters)], int).reshape(clusters, len(categorical))
    still = False
    for _ in range(rounds):
        new, modes = cells.move(centre, mode, gamma)
        still = bool((modes == mode).all() and np.nan_to_num(np.abs(new - centre) / cells.scale).max(initial=0.0) <= 1e-9)
        centre, mode = new, modes
        if still:
            break
    rows = [
        {c: None if np.isnan(centre[k, i]) else float(centre[k, i]) for i, c in enumerate(numeric)}
        | {c: n[mode[k, i] - 1] if mode[k, i] else None for i, (c, n) in enumerate(zip(categorical, cells.names))}
        for k in range(clusters)
    ]
    model = Prototypes(rows, dict(zip(numeric, map(float, cells.scale))), categorical, gamma)
    model.converged = still
    if not still:
        warnings.warn(f"The prototypes still moved after {rounds} rounds.", stacklevel=2)
    return model


def _centres(counted: DataFrame, keys: list[str], cuts: Sequence[float]) -> DataFrame:
    """(keys, num, cat): the median of the numbers, the most frequent category (the first in order at ties) of value frequencies."""
    numbers = counted.where(F.col("num").isNotNull())
    medians = quantiles(numbers, keys, "num", "n", {"median": 0.5}, cuts)
    modes = counted.where(F.col("cat").isNotNull()).groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), "cat")).alias("m"))
    return medians.select(*keys, F.col("median").alias("num"), F.lit(None).cast("string").alias("cat")).unionByName(
        modes.select(*keys, F.lit(None).cast("double").alias("num"), F.col("m.cat").alias("cat"))
    )


#: Most centres that are broadcast.
FEW_CENTRES = 200_000


def _look_up(wanted: DataFrame, centres: DataFrame, on: list[str], name: str) -> DataFrame:
    """``wanted`` with the centre of its keys, if there is one. Hot keys are spread."""
    table = centres.select(*on, F.struct("num", "cat").alias(name))
    if table.count() <= FEW_CENTRES:
        return wanted.join(F.broadcast(table), on, "left")
    asked = wanted.groupBy(*on).agg(F.count("*").alias("_asked"))
    return attach(wanted, table.join(asked, on), on, "_asked", wanted.count())


def fill_missing(
    df: DataFrame,
    id_column: str,
    *,
    numeric: dict[str, Column],
    categorical: dict[str, Column],
    groups: Sequence[tuple[str, Column]],
    clusters: int = 8,
    rounds: int = ROUNDS,
    gamma: float = 1.0,
) -> DataFrame:
    """(id, column_name, filled_from, method, number_value, text_value): one row per missing cell that can be filled.

    ``numeric`` and ``categorical`` give each feature's value as an expression that is null where the
    cell counts as missing; ``groups`` are tried in order. ``method`` is ``cluster`` where the group
    has rows of the same cluster with a value, else ``group``. Rows whose group key is null take no
    part in that group; cells that no group can fill are left out; an empty table gives no rows.
    Ids need not be unique: each row's cells come out. Columns other than those used are not read.
    """
    # Columns of its own, so that a feature may have any name.
    inner = {c: f"_v{i}" for i, c in enumerate([*numeric, *categorical])}
    keys = [f"_g{i}" for i in range(len(groups))]
    clean = df.select(
        quoted(id_column).alias("id"),
        *[e.cast("double").alias(inner[c]) for c, e in numeric.items()],
        *[e.cast("string").alias(inner[c]) for c, e in categorical.items()],
        *[e.alias(k) for k, (_, e) in zip(keys, groups)],
    )
    clean = cut(clean)
    model = fit_prototypes(clean, [inner[c] for c in numeric], [inner[c] for c in categorical], clusters=clusters, rounds=rounds, gamma=gamma)
    clean = clean.withColumn("_k", model.cluster())
    null_num, null_cat = F.lit(None).cast("double"), F.lit(None).cast("string")
    cells = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(inner[c]).alias("num"), null_cat.alias("cat")) for c in numeric],
        *[F.struct(F.lit(c).alias("feature"), null_num.alias("num"), F.col(inner[c]).alias("cat")) for c in categorical],
    )
    gaps = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in inner.values()])
    long = clean.select("id", "_k", *keys, F.explode(cells).alias("c")).select("id", "_k", *keys, "c.*")
    held = long.where(F.col("num").isNotNull() | F.col("cat").isNotNull())
    wanted = clean.where(gaps).select("id", "_k", *keys, F.explode(cells).alias("c")).select("id", "_k", *keys, "c.*")
    wanted = wanted.where(F.col("num").isNull() & F.col("cat").isNull()).drop("num", "cat")
    wanted = cut(wanted)
    cuts = range_cuts(held, "num")
    found = None
    for i, (name, _) in enumerate(groups):
        key = keys[i]
        known = held.where(F.col(key).isNotNull())
        if i:
            # Later groups only serve what earlier ones left; their centres are made for those keys alone.
            known = known.join(wanted.select(key, "feature").distinct().hint("shuffle_hash"), [key, "feature"], "left_semi")
        # One count of values serves both levels; the sum of a group's clusters is the group.
        counted = cut(known.groupBy(key, "feature", "_k", "num", "cat").agg(F.count("*").alias("n")))
        whole = counted.groupBy(key, "feature", "num", "cat").agg(F.sum("n").alias("n"))
        tried, choices = wanted, []
        for level, on, d in (("cluster", [key, "feature", "_k"], counted), ("group", [key, "feature"], whole)):
            at = f"_c_{level}"
            tried = _look_up(tried, cut(_centres(d, on, cuts)), on, at)
            choices.append(
                F.when(F.col(at).isNotNull(), F.struct(F.lit(name).alias("filled_from"), F.lit(level).alias("method"), F.col(f"{at}.num"), F.col(f"{at}.cat")))
            )
        tried = cut(tried.select("id", "_k", *keys, "feature", F.coalesce(*choices).alias("f")))
        filled = tried.where("f is not null").select("id", "feature", "f")
        found = filled if found is None else found.unionAll(filled)
        wanted = tried.where("f is null").drop("f")
    if found is None:
        raise EngineError("At least one group is required.")
    out = found.select("id", F.col("feature").alias("column_name"), "f")
    return out.select("id", "column_name", "f.filled_from", "f.method", F.col("f.num").alias("number_value"), F.col("f.cat").alias("text_value"))
