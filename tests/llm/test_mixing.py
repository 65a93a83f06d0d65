"""Permutations, packing, shares and caps of mixes."""

from collections import Counter

import numpy as np
import pytest

from fieldmill.llm import mixing
from fieldmill.llm.tokenizer import VOCABULARY

try:
    open(VOCABULARY).close()
except OSError:
    pytest.skip("no vocabulary here", allow_module_level=True)


@pytest.mark.parametrize("size", [1, 2, 3, 10, 255, 256, 257, 5000])
def test_permutation_hits_each_number_once(size):
    got = mixing.permute(np.arange(size), np.full(size, size), np.full(size, 12345))
    assert sorted(got.tolist()) == list(range(size))
    assert size < 10 or got.tolist() != list(range(size))


def tables(spark):
    rows = [(i, "alpha beta gamma " * (1 + i % 9), ("Big", "big ", "BIG")[i % 3], 1) for i in range(900)]
    rows += [(10_000 + i, "one two three four " * 3, "small-one", 1) for i in range(40)]
    rows += [(20_000, None, "big", 1), (20_001, "", "big", 1), (20_002, "x", None, 1), (20_003, "x", "other", 1), (0, rows[0][1], "Big", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, block int").repartition(3)
    targets = spark.createDataFrame([(1, "big", 3.0, 1), (1, "small_one", 1.0, 4), (2, "big", 1.0, 2), (2, "gone", 1.0, 5), (3, "small one", 1.0, None), (3, "big", None, 2)], "mix_id int, source string, weight double, max_repeats int")
    return docs, targets


def test_shares_and_caps(spark):
    docs, targets = tables(spark)
    records, plan = mixing.mix_sources(docs, targets, block_tokens=64)
    rows = records.collect()
    used = Counter((r["mix_id"], r["doc_id"], t) for r in rows for t in range(r["first_token"], r["first_token"] + r["n_tokens"]))
    caps = {(1, "big"): 1, (1, "small_one"): 4, (2, "big"): 2, (3, "small_one"): 1}
    for (mix, doc, _), n in used.items():
        assert n <= caps[(mix, "small_one" if doc >= 10_000 else "big")] and doc < 20_000
    got = {(r["mix_id"], r["source"]): r for r in mixing.mix_shares(records, plan).collect()}
    assert abs(got[(1, "big")]["actual_share"] - 0.75) < 0.001 and abs(got[(1, "small_one")]["target_share"] - 0.25) < 1e-6
    assert got[(2, "gone")]["actual_share"] == 0 and got[(2, "big")]["actual_share"] == 1
    assert got[(3, "small_one")]["records"] == 40 and (3, "big") not in got
    # One source of each mix is used up to its cap, to the token.
    whole = {r["doc_id"]: 0 for r in rows if r["mix_id"] == 2}
    for (mix, doc, _), n in used.items():
        whole[doc] = whole.get(doc, 0) + (mix == 2) * n
    tokens = {r["source"]: r["tokens"] for r in plan.filter("mix_id = 2").collect()}
    assert sum(v for d, v in whole.items() if d < 10_000) == 2 * tokens["big"]
    again = mixing.mix_sources(docs.repartition(5), targets, block_tokens=64)[0].collect()
    assert sorted(again) == sorted(rows)


def test_blocks_are_of_fixed_length(spark):
    docs, targets = tables(spark)
    rows = mixing.mix_sources(docs, targets.filter("mix_id = 1"), block_tokens=50)[0].collect()
    sizes = Counter()
    for r in rows:
        sizes[r["slot"], r["source"]] += r["n_tokens"]
    assert len({s for s, _ in sizes}) == len(sizes)  # one source a slot
    for source in ("big", "small_one"):
        odd = [n for (_, s), n in sizes.items() if s == source and n != 50]
        assert len(odd) <= 5 and all(n < 50 for n in odd)  # the source's short last block, once a round, and the cut one


def test_blocks_do_not_depend_on_slices(spark):
    sized = spark.createDataFrame([(i, "a", 1 + i % 7) for i in range(500)], "doc_id bigint, source string, n_tokens bigint")
    totals = mixing.source_totals(sized)
    one, many = (sorted(mixing.pack_blocks(sized, "doc_id", 16, 3, totals, n).collect()) for n in (10_000, 20))
    assert one == many and sum(r["n_tokens"] for r in one) == totals["a"][0]


def test_shards_follow_the_targets(spark):
    docs, targets = tables(spark)
    records, _ = mixing.mix_sources(docs, targets.filter("mix_id = 2"), block_tokens=16, shard_slots=32)
    slots = {(r["shard"], r["source"]): r["slots"] for r in mixing.mix_shards(records).collect()}
    assert len(slots) > 2 and max(slots.values()) <= 32


def test_shard_counts_are_multinomial_given_the_totals():
    counts = [7000, 2500, 501]
    found = list(mixing.shard_counts(counts, 100, 0, 101, (1, 2)))
    assert sorted(s for s, _, _ in found) == list(range(101))
    assert [sum(c[i] for _, c, _ in found) for i in range(3)] == counts
    assert all(sum(c) == 100 for s, c, _ in found if s < 100) and sum(found[-1][1]) == 1
    for a, b in zip(found, found[1:]):
        assert b[2] == [x + y for x, y in zip(a[1], a[2])]
    spread = np.std([c[0] for s, c, _ in found if s < 100])
    assert 3.5 < spread < 6  # sqrt(100 * 0.7 * 0.3) = 4.6
    assert list(mixing.shard_counts(counts, 100, 40, 43, (1, 2))) == found[40:43]  # any task finds the same
    huge = list(mixing.shard_counts([6 * 10**12, 10**12 + 5], 10**11, 0, 80, (1, 2)))
    assert [sum(c[i] for _, c, _ in huge) for i in range(2)] == [6 * 10**12, 10**12 + 5]


def test_empty_tables(spark):
    docs, targets = tables(spark)
    records, plan = mixing.mix_sources(docs.limit(0), targets)
    assert records.count() == 0 and all(r["actual_share"] == 0 for r in mixing.mix_shares(records, plan).collect())
    assert mixing.mix_sources(docs, targets.limit(0))[0].count() == 0
