"""Labels of points: renumbering, offsets, set algebra, fingerprints."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmill.operators.ranks import numbered
from fieldmill.session import cut, partitions


def dense_labels(df: DataFrame, label: str, out: str = "dense", keep_negative: bool = True) -> DataFrame:
    """``out``: labels renumbered 0.. in their order; negative labels become -1 (or, without ``keep_negative``, count as labels).

    The ranks are made on the distinct labels and joined back, so no task sorts the table.
    """
    known = df.select(label).filter(F.col(label).isNotNull()).distinct()
    known = known.filter(F.col(label) >= 0) if keep_negative else known
    ranks = numbered(known, [], [label], "_rank").withColumn("_rank", F.col("_rank") - 1)
    found = F.when(F.col(label).isNotNull(), F.coalesce("_rank", F.lit(-1)))
    return df.join(ranks, label, "left").withColumn(out, found).drop("_rank")


def offset_labels(df: DataFrame, label: str, start: Column, out: str = "moved") -> DataFrame:
    """Labels renumbered from ``start`` on (negative ones too), as when a second table is appended."""
    return dense_labels(df, label, "_dense", keep_negative=False).withColumn(out, start + F.col("_dense")).drop("_dense")


def append_labelled(base: DataFrame, added: DataFrame, label: str) -> DataFrame:
    """Union of both; the labels of ``added`` follow the greatest of ``base``."""
    top = base.agg(F.coalesce(F.max(label), F.lit(-1)).alias("_top"))  # one row
    moved = offset_labels(added, label, F.lit(0), "_moved").join(F.broadcast(top)).withColumn(label, F.col("_top") + 1 + F.col("_moved"))
    return base.unionByName(moved.select(*base.columns))


def copy_selection(df: DataFrame, chosen: Column, label: str) -> DataFrame:
    """Appends the chosen rows again under the label after the greatest."""
    top = df.agg(F.coalesce(F.max(label), F.lit(-1)).alias("_top"))  # one row
    copies = df.filter(chosen).join(F.broadcast(top)).withColumn(label, F.col("_top") + 1)
    return df.unionByName(copies.select(*df.columns))


def toggle(current: DataFrame, picked: DataFrame) -> DataFrame:
    """Symmetric difference of two sets of rows: picked ones enter, or leave if they are in. Rows repeated in a set count once."""
    both = current.distinct().unionByName(picked.distinct())
    return both.groupBy(*both.columns).agg(F.count("*").alias("_n")).filter("_n = 1").drop("_n")


def first_occurrence(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the order; partial aggregates, so no key is hot."""
    others = [c for c in df.columns if c not in key]
    first = F.min(F.struct(*order, *(c for c in others if c not in order))).alias("_first")
    return df.groupBy(*key).agg(first).select(*(F.col(c) if c in key else F.col(f"_first.{c}").alias(c) for c in df.columns))


def fingerprints(df: DataFrame, part: list[str], member: str) -> DataFrame:
    """``fingerprint`` of each part: its size and a digest of its distinct members in order.

    A part is one value in the result, so it must fit a row, as in the interactive selections it stands for.
    """
    members = F.array_sort(F.collect_set(member))
    return df.groupBy(*part).agg(members.alias("_m")).select(
        *part, F.size("_m").cast("bigint").alias("members"), F.concat(F.size("_m").cast("string"), F.lit(":"), F.sha2(F.array_join("_m", ","), 256)).alias("fingerprint")
    )


def grid_cell(df: DataFrame, axes: list[str], stride: float) -> DataFrame:
    """``cell``: consecutive numbers of the occupied cells of a grid with this stride, in the order of their coordinates."""
    low = df.agg(*(F.min(a).alias(f"_low_{a}") for a in axes))  # one row
    placed = df.join(F.broadcast(low))
    cells = [f"_c_{a}" for a in axes]
    placed = placed.withColumns({c: F.ceil((F.col(a) - F.col(f"_low_{a}")) / stride) for c, a in zip(cells, axes)})
    ranks = numbered(placed.select(*cells).distinct(), [], cells, "cell").withColumn("cell", F.col("cell") - 1)
    return placed.join(ranks, cells).select(*df.columns, "cell")


def histogram(df: DataFrame, label: str) -> DataFrame:
    """Rows of each label from 0 to the greatest, empty ones with 0; negative and null labels don't count."""
    counts = df.filter(F.col(label) >= 0).groupBy(label).agg(F.count("*").alias("n"))
    top = counts.agg(F.max(label).alias("top")).filter("top is not null")
    every = top.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("top").cast("bigint"))).alias(label))
    return every.join(counts, label, "left").select(label, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def take_snapshot(df: DataFrame, key: str, columns: list[str], chosen: Column | None = None) -> DataFrame:
    """A version of the ``columns`` of the chosen rows (all, if none are named), written so that later edits don't reach it."""
    kept = df.filter(chosen) if chosen is not None else df
    return cut(kept.select(key, *columns), "snapshot")


def restore_snapshot(df: DataFrame, snapshot: DataFrame, key: str) -> DataFrame:
    """``df`` with the snapshot's columns as they were, nulls included, for the keys that it holds; other rows and columns stay."""
    columns = [c for c in snapshot.columns if c != key]
    old = snapshot.select(key, F.struct(*columns).alias("_old"))
    joined = df.join(old, key, "left")
    return joined.select(*(F.when(F.col("_old").isNotNull(), F.col(f"_old.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns))


def restore_rows(df: DataFrame, snapshot: DataFrame, key: str) -> DataFrame:
    """The whole structure of a snapshot of all columns: rows deleted since come back, rows added since go."""
    return snapshot.select(*df.columns)


def replay_history(events: DataFrame, session: str, order: list[str], kind: str, action: str, keep: int = 20) -> DataFrame:
    """``session``, ``undo``, ``redo``: the stacks after all events of a session, in ``order``. 'push' puts ``action`` on the undo stack, which
    holds the last ``keep``, and clears the redo stack; 'undo' and 'redo' move the top entry to the other stack, if there is one.

    Each step needs the one before, so a session is followed by one task; its events stream through in order, only the stacks are held.
    """
    plain = events.select(F.col(session).alias("s"), F.col(kind).alias("k"), F.col(action).alias("a"), *(F.col(o).alias(f"o{i}") for i, o in enumerate(order)))
    types = {f.name: f.dataType.simpleString() for f in plain.schema.fields}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], key_type), pa.array([undo], pa.list_(action_type)), pa.array([redo], pa.list_(action_type))], ["session", "undo", "redo"])

        begun, now, undo, redo = False, None, [], []
        for batch in batches:
            key_type, action_type = batch.schema.field(0).type, batch.schema.field(2).type
            for s, k, a in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if not begun or s != now:
                    if begun:
                        yield done()
                    begun, now, undo, redo = True, s, [], []
                if k == "push":
                    undo, redo = [*undo, a][-keep:], []
                elif k in ("undo", "redo"):
                    source, target = (undo, redo) if k == "undo" else (redo, undo)
                    if source:
                        target.append(source.pop())
                        undo = undo[-keep:]
        if begun:
            yield done()

    sorted_events = plain.repartition(partitions(events.sparkSession), "s").sortWithinPartitions("s", *(f"o{i}" for i in range(len(order))))
    return sorted_events.mapInArrow(run, f"session {types['s']}, undo array<{types['a']}>, redo array<{types['a']}>")


def push_history(entries: DataFrame, keep: int = 20) -> DataFrame:
    """The last ``keep`` entries of an undo history (seq, action)."""
    return entries.orderBy(F.desc("seq")).limit(keep)
