"""Records that are copies of each other but for white space, case, punctuation or field order.

Every (field name, normalised value) pair of a record is hashed, and the hashes are combined by
commutative multiset hashing: four sums of 32-bit halves, so that the order of fields does not matter
and equal pairs do not cancel. Records are grouped by the fingerprint in one hash aggregation whose
keys hold the normalised fields too: equal fingerprints of different records therefore stay apart,
nothing is sorted, and a record with a billion copies shrinks to one row per task before the shuffle.
Where every row is wanted back, the rows of such a record are looked up in several parts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.errors import EngineError
from tabulon.runtime import attach, cut, quoted

_LOW = 0xFFFFFFFF


def letters_and_digits(c: Column) -> Column:
    """A text's letters and digits without case; null is the empty text.

    Upper-casing first joins what full case folding joins (sharp s and ss, the two small sigmas).
    """
    kept = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}]+", "")
    # What stands between the two also keeps the optimiser from dropping the inner one.
    return F.translate(F.lower(F.replace(F.upper(kept), F.lit("ẞ"), F.lit("SS"))), "ς", "σ")


def exact_value(c: Column, dtype: str) -> Column:
    """A number, date or other value as a text that is equal where the values are; null and NaN equal themselves only."""
    if dtype in ("float", "double"):
        d = c.cast("double")
        return F.when(d.isNull(), "~").when(F.isnan(d), "NaN").when(d == 0, "0.0").otherwise(d.cast("string"))
    return F.coalesce(c.cast("string"), F.lit("~"))


def fingerprint(pairs: Sequence[tuple[str, Column]]) -> list[Column]:
    """Multiset hash of (field name, value) pairs: four sums that no order of the pairs changes."""
    lanes = []
    for seed in ("a", "b"):
        hashes = [F.xxhash64(F.lit(seed), F.lit(name), value) for name, value in pairs]
        for half in (lambda h: h.bitwiseAND(_LOW), lambda h: F.shiftrightunsigned(h, 32)):
            lanes.append(sum((half(h) for h in hashes[1:]), half(hashes[0])))
    return lanes


def normalised(df: DataFrame, id_column: str, fields: Mapping[str, str], swappable: Sequence[Sequence[str]] = ()) -> DataFrame:
    """(id, f0..f3, c0..): the fingerprint and the normalised fields, those of a swappable set in a fixed order.

    ``fields`` maps columns to ``text`` or ``exact``; columns of one swappable set share a field name.
    """
    if not fields:
        raise EngineError("Compare at least one field.")
    types = dict(df.dtypes)
    shared = {c: "/".join(group) for group in swappable for c in group}
    value = {c: letters_and_digits(quoted(c)) if kind == "text" else exact_value(quoted(c), types[c]) for c, kind in fields.items()}
    d = df.select(quoted(id_column).alias("id"), *[value[c].alias(f"v{i}") for i, c in enumerate(fields)])
    at = {c: F.col(f"v{i}") for i, c in enumerate(fields)}
    lanes = fingerprint([(shared.get(c, c), at[c]) for c in fields])
    canon = [at[c] for c in fields if c not in shared]
    for group in swappable:
        if len(group) == 2:
            canon += [F.least(*[at[c] for c in group]), F.greatest(*[at[c] for c in group])]
        else:
            canon.append(F.array_sort(F.array(*[at[c] for c in group])))
    return d.select("id", *[x.alias(f"f{i}") for i, x in enumerate(lanes)], *[x.alias(f"c{i}") for i, x in enumerate(canon)])


def collapse(df: DataFrame, id_column: str, fields: Mapping[str, str], swappable: Sequence[Sequence[str]] = ()) -> DataFrame:
    """(first_id, copies): one row per distinct record, its smallest id and how many rows it has.

    Text fields are compared by letters and digits without case (a null text equals an empty one, and
    one of punctuation only); exact ones by value, null equal to null and NaN to NaN. An empty table
    gives no rows. Ids that occur twice count as two rows. Other columns are not read.
    """
    d = normalised(df, id_column, fields, swappable)
    return d.groupBy(*[c for c in d.columns if c != "id"]).agg(F.min("id").alias("first_id"), F.count("*").alias("copies")).select("first_id", "copies")


def surplus(df: DataFrame, id_column: str, fields: Mapping[str, str], swappable: Sequence[Sequence[str]] = ()) -> DataFrame:
    """(first_id, copy_id): one row per row that repeats the record of the smaller ``first_id``; see ``collapse``."""
    d = normalised(df, id_column, fields, swappable)
    lanes, keys = [f"f{i}" for i in range(4)], [c for c in d.columns if c != "id"]
    records = d.groupBy(*keys).agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))
    # Texts are shuffled once, for the verification. A fingerprint of one record only, which is all of
    # them but for collisions, then stands for it when the rows are looked up. Fingerprints of one row
    # need no look, and those of very many are spread over several tasks.
    prints = records.groupBy(*lanes).agg(F.count("*").alias("records"), F.min("first_id").alias("first_id"), F.sum("copies").alias("copies"))
    prints = cut(prints)
    total = prints.agg(F.sum("copies")).first()[0] or 0
    again = prints.where("copies > 1")
    hit = attach(d.select("id", *lanes), again.where("records = 1").select(*lanes, "first_id", "copies"), lanes, "copies", total, "inner")
    collided = again.where("records > 1").select(*lanes)
    if not collided.isEmpty():
        same = records.where("copies > 1").join(F.broadcast(collided) if collided.count() <= 10_000 else collided.hint("shuffle_hash"), lanes, "left_semi")
        hit = hit.select("id", "first_id").unionAll(attach(d, same, keys, "copies", total, "inner").select("id", "first_id"))
    return hit.where(F.col("id") != F.col("first_id")).select("first_id", F.col("id").alias("copy_id"))
