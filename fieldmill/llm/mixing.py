"""Mixing sources to target weights in tokens.

The records of a source, in a pseudorandom order, are laid end to end and cut into blocks of exactly ``block_tokens`` tokens (only a
source's last block is shorter); a record on a border is cut there, its pieces named by their token ranges. A mix is a sequence of slots
in shards. Each shard draws its number of slots a source from the multinomial distribution given the mix's exact totals: the shards are
halved again and again, and each half takes its hypergeometric share, so any task can work out its own shards alone and the totals, which
hold the caps, come out exactly. A source's slots are mapped to its blocks by a pseudorandom permutation a round, so a block recurs only
after all were used; the last slot of a source is cut to the tokens that are still due. Slots and blocks are joined by index.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldmill.llm.tokenizer import VOCABULARY, count_tokens
from fieldmill.session import cut

#: Records of a source that are numbered together; a source has as many parts as it takes, whatever its size.
SLICE_RECORDS = 100_000
#: Slots that one task deals.
TASK_SLOTS = 50_000


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1, value by value: a four-round Feistel network on the next power of four, walked until it
    falls inside."""
    out = index.astype(np.uint64)
    size = size.astype(np.uint64)
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size.astype(np.float64), 2))) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    key = key.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for r in range(4):
            f = (right + np.uint64(r + 1)) * np.uint64(0x9E3779B97F4A7C15) ^ k
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & m)
        out[todo] = left << h | right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


def clean_source(source: Column) -> Column:
    """One spelling of a source name: trimmed, lower case, runs of blanks and hyphens as one underscore; empty is null."""
    name = F.regexp_replace(F.lower(F.trim(source)), r"[\s\-_]+", "_")
    return F.when(name != "", name)


def source_totals(sized: DataFrame) -> dict[str, tuple[int, int]]:
    """Tokens and records of each source (of those with targets, so a few)."""
    rows = sized.filter("source is not null and n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()
    return {r["source"]: (r["t"], r["n"]) for r in rows}


def pack_blocks(sized: DataFrame, id_col: str, block_tokens: int, seed: int, totals: dict[str, tuple[int, int]], slice_records: int = SLICE_RECORDS) -> DataFrame:
    """``source``, ``block``, the id, ``first_token``, ``n_tokens``, ``at``: the pieces of each block (numbered 0.. in its source), which
    tokens of the record they are, and where in the block they begin. ``sized``: id, source, n_tokens; records without tokens are in none.

    A source is numbered in slices of about ``slice_records`` records (ranges of the hash that orders them), whose totals are added up."""
    spread = sized.filter("source is not null and n_tokens > 0").withColumn("order", F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(seed)), 1))
    parts = [x for s, (_, n) in sorted(totals.items()) for x in (F.lit(s), F.lit(-(-n // slice_records)))]
    slices = F.create_map(*parts)[F.col("source")] if parts else F.lit(1)
    spread = spread.withColumn("slice", F.shiftright(F.shiftright("order", 39) * slices, 24).cast("int"))
    inside = Window.partitionBy("source", "slice").orderBy("order", id_col).rowsBetween(Window.unboundedPreceding, -1)
    local = spread.withColumn("local", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # over slices only
    sums = spread.groupBy("source", "slice").agg(F.sum("n_tokens").alias("tokens")).withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    placed = local.join(sums.drop("tokens"), ["source", "slice"]).withColumn("start", F.col("before") + F.col("local"))
    first, last = (F.expr(f"(start + {x}) div {block_tokens}") for x in ("0", "n_tokens - 1"))
    cutting = placed.select(id_col, "source", "n_tokens", "start", F.explode(F.sequence(first, last)).alias("block"))
    low = F.greatest(F.col("start"), F.col("block") * block_tokens)
    high = F.least(F.col("start") + F.col("n_tokens"), (F.col("block") + 1) * block_tokens)
    return cutting.select("source", "block", id_col, (low - F.col("start")).alias("first_token"), (high - low).alias("n_tokens"), (low - F.col("block") * block_tokens).alias("at"))


PLAN = "mix_id bigint, source string, target double, max_repeats int, tokens bigint, records bigint, blocks bigint, wanted bigint, slots bigint"


def plan_mix(totals: dict[str, tuple[int, int]], targets: list, block_tokens: int) -> list[dict]:
    """One entry a mix and source with a target: its share, totals, the tokens wanted of it in the largest feasible mix, and their slots.

    ``targets``: rows of mix_id, source (clean), weight, max_repeats. The size of a mix is the largest at which no source with tokens
    exceeds ``max_repeats`` rounds (null: 1). A null or non-positive weight is no target; a source without tokens can't be mixed.
    """
    weights: dict[tuple[int, str], list] = {}
    for mix, source, weight, most in targets:
        if mix is not None and source is not None and weight is not None and 0 < weight < float("inf"):
            known = weights.setdefault((mix, source), [0.0, 0])
            known[0] += weight
            known[1] = max(known[1], 1 if most is None else most)
    plan = []
    for mix in sorted({m for m, _ in weights}):
        mine = {s: w for (m, s), w in sorted(weights.items()) if m == mix}
        there = {s: w for s, w in mine.items() if s in totals and w[1] > 0}
        total = sum(w for w, _ in there.values())
        size = min((most * totals[s][0] * total / w for s, (w, most) in there.items()), default=0)
        for source, (weight, most) in mine.items():
            tokens, records = totals.get(source, (0, 0))
            wanted = min(most * tokens, round(size * weight / total)) if source in there else 0
            blocks = -(-tokens // block_tokens)
            slots = wanted // tokens * blocks + -(-(wanted % tokens) // block_tokens) if tokens else 0
            plan.append({"mix_id": mix, "source": source, "target": weight / sum(w for w, _ in mine.values()), "max_repeats": most, "tokens": tokens, "records": records, "blocks": blocks, "wanted": wanted, "slots": slots})
    return plan


def _draw(rng: np.random.Generator, counts: list[int], take: int) -> list[int]:
    """How many of ``take`` slots, drawn from ``counts`` without replacement, each source has: a multinomial draw given the totals."""
    out, total = [], sum(counts)
    for n in counts:
        rest = total - n
        if rest < 10**9 and n < 10**9 and total < 10**9:
            x = int(rng.hypergeometric(n, rest, take)) if n and take else 0
        else:  # beyond the generator's range: the normal limit, within what is possible
            mean = take * (n / total) if total else 0.0
            sd = (mean * (1 - n / total) * max(total - take, 0) / max(total - 1, 1)) ** 0.5 if total else 0.0
            x = round(rng.normal(mean, sd))
        x = min(max(x, take - rest, 0), n, take)
        out.append(x)
        take, total = take - x, rest
    return out


def shard_counts(counts: list[int], shard_slots: int, first: int, last: int, seed: tuple[int, ...]) -> Iterator[tuple[int, list[int], list[int]]]:
    """(shard, slots of each source in it, slots of each source before it) of the shards ``first`` to ``last`` (exclusive) of a mix."""
    everything = sum(counts)
    stack = [(0, -(-everything // shard_slots), counts, [0] * len(counts))]
    while stack:
        low, high, mine, before = stack.pop()
        if high <= first or low >= last or low >= high:
            continue
        if high - low == 1:
            yield low, mine, before
            continue
        middle = (low + high) // 2
        left = _draw(np.random.default_rng([*seed, low, high]), mine, (middle - low) * shard_slots)
        stack.append((middle, high, [a - b for a, b in zip(mine, left)], [a + b for a, b in zip(before, left)]))
        stack.append((low, middle, left, before))


def deal_slots(plan: list[dict], spark: SparkSession, shard_slots: int, block_tokens: int, seed: int) -> DataFrame:
    """The slots of all mixes: mix_id, shard, slot, source, block, round (how often the block was used before), take (tokens of the block
    that are used). ``plan``: a few rows."""
    mixes = []
    for mix in sorted({r["mix_id"] for r in plan}):
        lines = [r for r in plan if r["mix_id"] == mix and r["slots"] > 0]
        if lines:
            mixes.append((mix, lines, -(-sum(r["slots"] for r in lines) // shard_slots)))
    shards = np.cumsum([0, *(n for _, _, n in mixes)])
    each = max(1, TASK_SLOTS // shard_slots)
    tasks = -(-int(shards[-1]) // each)

    def blocks_of(line: dict, key: int, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Block, round and tokens taken of slots of one source."""
        blocks, full = line["blocks"], line["tokens"] // block_tokens
        turns, due = divmod(line["wanted"], line["tokens"])
        turn, place = np.divmod(slot, blocks)
        last = turn >= turns
        size = np.where(last, np.maximum(full, 1), blocks)
        inner = ~last | (place < full)
        block = np.where(inner, permute(np.minimum(place, size - 1), size, key + 7919 * turn), full)
        take = np.where(last & (place == due // block_tokens), due % block_tokens, block_tokens)
        return block, turn, take

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.column(0).to_pylist():
                for m, (mix, lines, _) in enumerate(mixes):
                    low, high = max(task * each, int(shards[m])) - int(shards[m]), min((task + 1) * each, int(shards[m + 1])) - int(shards[m])
                    if low >= high:
                        continue
                    for shard, counts, before in shard_counts([r["slots"] for r in lines], shard_slots, low, high, (seed, mix)):
                        which = np.repeat(np.arange(len(lines)), counts)
                        slot = np.concatenate([b + np.arange(c) for b, c in zip(before, counts)]).astype(np.int64)
                        found = [blocks_of(r, seed + 31 * mix + 1009 * i, slot[which == i]) for i, r in enumerate(lines)]
                        block, turn, take = (np.concatenate(x).astype(np.int64) for x in zip(*found))
                        order = np.random.default_rng([seed, mix, shard, 1]).permutation(len(slot))  # places within the shard
                        names = pa.array([r["source"] for r in lines], pa.string()).take(pa.array(which))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(slot), mix)), pa.array(np.full(len(slot), shard)), pa.array(shard * shard_slots + order), names, pa.array(block), pa.array(turn), pa.array(take)],
                            ["mix_id", "shard", "slot", "source", "block", "round", "take"],
                        )

    schema = "mix_id bigint, shard bigint, slot bigint, source string, block bigint, round bigint, take bigint"
    return spark.range(0, tasks, 1, max(1, min(tasks, 20_000))).mapInArrow(run, schema)


def mix_sources(
    docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    block_tokens: int = 256, shard_slots: int = 1024, seed: int = 20, vocabulary: str = VOCABULARY,
) -> tuple[DataFrame, DataFrame]:
    """The pieces of records in each mix, and the mixes' plan.

    Pieces: mix_id, shard, slot, source, the id, first_token, n_tokens, round. Each token of a record is used at most ``max_repeats``
    times in a mix (once a round), and the tokens of a source are its share of the mix to the token. Null, empty and unknown sources and
    records without tokens are in no mix; rows repeated under an id count once (the longest); an empty table gives no rows. ``targets`` is
    a configuration of a few rows a mix and goes through the driver, as do the totals of its sources and the plan.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(id_col), clean_source(F.col(source_col)).alias("source"), F.col(text_col)).filter(F.col(id_col).isNotNull())
    wanted = targets.select(clean_source(F.col("source")).alias("source")).distinct()
    sized = count_tokens(named.join(wanted, "source", "left_semi").select(id_col, "source", text_col), text_col, vocabulary)
    sized = cut(sized.groupBy(id_col).agg(F.max_by("source", "n_tokens").alias("source"), F.max("n_tokens").alias("n_tokens")), "sized")
    totals = source_totals(sized)
    rows = targets.select(F.col("mix_id").cast("bigint"), clean_source(F.col("source")), F.col("weight").cast("double"), F.col("max_repeats").cast("int")).collect()
    plan = plan_mix(totals, [tuple(r) for r in rows], block_tokens)
    pieces = pack_blocks(sized, id_col, block_tokens, seed, totals)
    slots = deal_slots(plan, spark, shard_slots, block_tokens, seed)
    used = F.least(F.col("n_tokens"), F.col("take") - F.col("at"))
    records = slots.join(pieces.hint("merge"), ["source", "block"]).withColumn("n_tokens", used).filter("n_tokens > 0")
    names = [f.split()[0] for f in PLAN.split(", ")]
    return records.select("mix_id", "shard", "slot", "source", id_col, "first_token", "n_tokens", "round"), spark.createDataFrame([tuple(r[c] for c in names) for r in plan], PLAN)


def mix_shares(records: DataFrame, plan: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """For each mix and source: target and actual share of the tokens, tokens, records, and the most times a record is used."""
    used = records.groupBy("mix_id", "source", id_col, "round").agg(F.sum("n_tokens").alias("t"))
    used = used.groupBy("mix_id", "source", id_col).agg(F.sum("t").alias("t"), F.count("*").alias("n"))
    actual = used.groupBy("mix_id", "source").agg(F.sum("t").alias("t"), F.count("*").alias("n"), F.max("n").alias("most"))
    joined = plan.select("mix_id", "source", "target", "max_repeats").join(actual, ["mix_id", "source"], "left")
    tokens = F.coalesce("t", F.lit(0))
    share = F.try_divide(tokens, F.sum(tokens).over(Window.partitionBy("mix_id")))
    return joined.select(
        "mix_id", "source", F.round("target", 6).alias("target_share"), F.round(F.coalesce(share, F.lit(0.0)), 6).alias("actual_share"),
        tokens.alias("tokens"), F.coalesce("n", F.lit(0)).alias("records"), F.coalesce("most", F.lit(0)).alias("most_repeats"), "max_repeats",
    )


def mix_shards(records: DataFrame) -> DataFrame:
    """How many slots, records and tokens of each source a shard holds."""
    return records.groupBy("mix_id", "shard", "source").agg(
        F.count_distinct("slot").alias("slots"), F.count_distinct("doc_id").alias("records"), F.sum("n_tokens").alias("tokens")
    )
