"""Referential integrity: references that lead nowhere, to deleted records, or to records that came later."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCHES = ("simple", "full", "partial")


def below_root(path: Column) -> Column:
    """The place below the data root that a path leads to: both separators, empty and ``.`` parts dropped, ``..`` resolved. Case stays.

    Null and paths that name no place (empty, only dots) are null; ``..`` above the root stays at the root.
    """
    parts = F.split(path, r"[/\\]+")
    step = lambda done, part: (
        F.when(part.isin("", "."), done).when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))
    )
    place = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(place != "", place)


def stem(name: Column) -> Column:
    """A name up to its first dot."""
    return F.substring_index(name, ".", 1)


def target_states(targets: DataFrame, keys: list[str], arrived: str, deleted: str | None) -> DataFrame:
    """One row a key: ``alive`` rows and the earliest arrival of those."""
    gone = F.col(deleted).isNotNull() if deleted else F.lit(False)
    alive = F.when(~gone, F.col(arrived))
    return targets.groupBy(*keys).agg(F.count(F.when(~gone, 1)).alias("alive"), F.min(alive).alias("earliest"))


def reference_states(
    refs: DataFrame, ref_id: str, ref_keys: list[str], created: str, targets: DataFrame, target_keys: list[str], arrived: str,
    deleted: str | None = None, match: str = "simple",
) -> DataFrame:
    """``ref_id``, ``state``, ``period``: every reference whose state isn't sound, with the month of ``created`` as YYYY-MM.

    States: 'missing' (no target row), 'deleted' (all target rows have ``deleted``), 'late' (the earliest arrival of the others is after
    ``created``). Keys may be composite and partly null: references are taken by their null mask. 'simple': any null is no reference;
    'full': a mask with some but not all nulls is 'missing'; 'partial': a mask is matched on its non-null columns. A reference with only
    nulls is never one. A null ``created`` has a null period and is never late. Rows repeated under one id, key and time count once.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    names = [f"_k{i}" for i in range(len(ref_keys))]
    left = refs.select(F.col(ref_id).alias("ref_id"), F.col(created).alias("_created"), *(F.col(c).alias(n) for c, n in zip(ref_keys, names))).distinct()
    columns = [*(F.col(c).alias(n) for c, n in zip(target_keys, names)), F.col(arrived).alias("_arrived")]
    right = targets.select(*columns, (F.col(deleted) if deleted else F.lit(None).cast("timestamp")).alias("_deleted"))
    parts = []
    for mask in product((True, False), repeat=len(names)):
        known = [n for n, here in zip(names, mask) if here]
        if not known or len(known) < len(names) and match == "simple":
            continue
        chosen = left
        for n, here in zip(names, mask):
            chosen = chosen.filter(F.col(n).isNotNull() if here else F.col(n).isNull())
        if len(known) < len(names) and match == "full":
            parts.append(chosen.select("ref_id", F.lit("missing").alias("state"), "_created"))
            continue
        there = right
        for n in known:
            there = there.filter(F.col(n).isNotNull())
        states = target_states(there, known, "_arrived", "_deleted")
        state = (
            F.when(F.col("alive").isNull(), "missing").when(F.col("alive") == 0, "deleted").when(F.col("earliest") > F.col("_created"), "late")
        )
        parts.append(chosen.join(states, known, "left").select("ref_id", state.alias("state"), "_created").filter("state is not null"))
    if not parts:
        return left.filter(F.lit(False)).select("ref_id", F.lit("").alias("state"), F.lit("").alias("period"))
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    return found.select("ref_id", "state", F.date_format("_created", "yyyy-MM").alias("period")).distinct()


def orphan_report(states: DataFrame) -> DataFrame:
    """Number of unsound references per table, field, state and period."""
    return states.groupBy("ref_table", "ref_field", "state", "period").agg(F.count("*").alias("refs"))
