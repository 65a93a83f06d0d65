"""Shared spans against brute force over every window."""

import random

import pytest

from fieldmill.llm import spans


def brute(docs, n):
    owners = {}
    for doc, text in docs:
        for i in range(len(text or "") - n + 1):
            owners.setdefault(text[i : i + n], set()).add(doc)
    out = set()
    for doc, text in docs:
        runs = []
        for i in range(len(text or "") - n + 1):
            if len(owners[text[i : i + n]]) > 1:
                if runs and runs[-1][1] >= i:
                    runs[-1][1] = i + n
                else:
                    runs.append([i, i + n])
        out |= {(doc, a, b) for a, b in runs}
    return out


def test_deep_nodes_equal_brute_force():
    r = random.Random(5)
    for _ in range(60):
        suffixes = sorted("".join(r.choice("ab") for _ in range(r.randint(4, 12))) for _ in range(r.randint(1, 14)))
        want = set()
        for i in range(len(suffixes)):
            for j in range(i + 1, len(suffixes)):
                depth = min(spans.common_prefix(suffixes[k - 1], suffixes[k]) for k in range(i + 1, j + 1))
                left = i == 0 or spans.common_prefix(suffixes[i - 1], suffixes[i]) < depth
                right = j == len(suffixes) - 1 or spans.common_prefix(suffixes[j], suffixes[j + 1]) < depth
                if depth >= 4 and left and right:
                    want.add((depth, i, j))
        got = list(spans.deep_nodes(suffixes, 4))
        assert set(got) == want and len(got) == len(want)
        place = {x: k for k, x in enumerate(got)}
        assert all(place[a] < place[b] for a in got for b in got if a != b and b[1] <= a[1] and a[2] <= b[2])


def found(spark, docs, **options):
    df = spark.createDataFrame([(d, t, "z") for d, t in docs], "doc_id bigint, text string, h string").repartition(3)
    return {tuple(r) for r in spans.shared_intervals(df, "doc_id", "text", **options).collect()}


@pytest.mark.parametrize("split", [4096, 3])
def test_equals_brute_force(spark, split):
    r = random.Random(split)
    word = lambda k: "".join(r.choice("abcdefgh 한é🤖") for _ in range(k))
    shared = [word(r.randint(15, 90)) for _ in range(6)]
    docs = [(i, word(r.randint(0, 40)) + r.choice(shared)[: r.randint(10, 90)] + word(r.randint(0, 30)) + r.choice(shared)) for i in range(40)]
    docs += [(100, None), (101, ""), (102, "ab"), (103, shared[0]), (104, shared[0]), (104, shared[0]), (105, "x" * 300), (106, "x" * 250 + "y"), (107, "q" * 90)]
    assert found(spark, docs, min_len=20, gram=8, split_above=split) == brute(docs, 20)


def test_a_text_repeated_under_one_id_is_one_record(spark):
    assert found(spark, [(1, "a b c d e f g" * 5), (1, "a b c d e f g" * 5)], min_len=20, gram=8) == set()


def test_long_texts_are_cut_and_joined(spark, monkeypatch):
    r = random.Random(9)
    body = "".join(r.choice("abcdefghij") for _ in range(3000))
    monkeypatch.setattr(spans, "_PIECE", 500)
    whole = spans._runs([body], 50, 16)
    parts = [spans._runs([p[2]], 50, 16) for batch in spans._pieces([1], [body], 50) for p in batch]
    assert sum(x[3].sum() for x in parts) == whole[3].sum() == len(body) - 49
    assert {h for x in parts for h in x[1].tolist()} == set(whole[1].tolist())


def test_share_and_passages(spark):
    text = "".join(chr(97 + i * 7 % 26) for i in range(60))
    df = spark.createDataFrame([(1, text + "!!"), (2, "??" + text), (3, "short"), (4, None)], "doc_id bigint, text string")
    share = {r["doc_id"]: (r["n_chars"], r["shared_chars"]) for r in spans.shared_share(df, "doc_id", "text", min_len=30, gram=10).collect()}
    assert share == {1: (62, 60), 2: (62, 60), 3: (5, 0), 4: (0, 0)}
    row = spans.shared_passages(df, "doc_id", "text", min_len=30, gram=10).collect()
    assert [(r["n_chars"], r["records"], r["first_record"]) for r in row] == [(60, 2, 1)]
    with pytest.raises(ValueError):
        spans.shared_intervals(df, "doc_id", "text", min_len=10, gram=11)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert spans.shared_intervals(df, "doc_id", "text").count() == 0


def test_a_key_that_very_many_contexts_share(spark):
    from pyspark.sql import functions as F

    r = random.Random(3)
    noise = lambda k: "".join(r.choices("abcdefghijklmnop", k=k))
    core = noise(24)
    docs = [(i, noise(30) + core + noise(30)) for i in range(6000)]
    docs += [(10_000 + i, docs[i][1][5:70]) for i in range(0, 600, 3)]  # 65 characters, all shared with one other record
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    got = {tuple(x) for x in spans.shared_intervals(df, "doc_id", "text", min_len=60, gram=16, split_above=64).collect()}
    assert got == {(i, 5, 70) for i in range(0, 600, 3)} | {(10_000 + i, 0, 65) for i in range(0, 600, 3)}
    rows = spans._contexts(spans.suffix_runs(df, "doc_id", "text", 60, 16), df, "doc_id", "text", 60)
    rows = rows.withColumns({"lo": F.lit(0), "hi": F.lit(45), "digest": F.unhex(F.md5("context"))}).select("doc", "start", "h", "anchor", "context", "lo", "hi", "digest")
    most = lambda x: x.groupBy("h").agg(F.count_distinct("digest").alias("n")).agg(F.max("n")).first()[0]
    assert most(rows) > 500 and most(spans._light(rows, 60, 64)) <= 64
