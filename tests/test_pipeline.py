"""Small files, drifting schemas, orphan references: odd inputs and brute force."""

from datetime import datetime as T

import pytest
from pyspark.sql import functions as F

from fieldmill.operators import drift, references, smallfiles

A, B, C, D = T(2025, 1, 5), T(2025, 2, 5), T(2025, 3, 5), T(2025, 4, 5)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


FILES = "file_id bigint, kind string, body string, arrived_at timestamp, uid string"


def files(spark, bodies):
    # ``uid`` clashes with a key that stands inside the records.
    return spark.createDataFrame([(i, "masks", b, A if i % 2 else B, "x") for i, b in enumerate(bodies)], FILES)


def test_records_of_every_shape(spark):
    bodies = ['{"uid":1,"idx":0}\n{"uid":1,"idx":1,"s":"a}b{"}', '[{"uid": 2, "idx": 0},\n {"uid": 2, "idx": 1}]', '﻿{"idx":0,"uid":3}', '{"uid":4,"idx":0}\n{"uid":4,"id', None, "", " \n", "[]", '{"uid":null,"idx":1}', '{"idx":7}']
    found = smallfiles.extract_records(files(spark, bodies), "body", {"uid": "bigint", "idx": "int"}, ("kind",))
    assert rows(found.select("kind", "uid", "idx")) == [("masks", u, i) for u, i in ((1, 0), (1, 1), (2, 0), (2, 1), (3, 0), (4, 0))]


def test_records_with_inner_objects(spark):
    bodies = ['{"uid":1,"idx":0,"box":{"x":1,"at":{"y":2}}}\n{"uid":1,"idx":1}', '[{"meta":{"a":[{}]},"uid":2,"idx":0}]', '{"rows":[{"uid":3,"idx":0}]}', '{"uid":4,"idx":0,"box":{"x":1}\n{"uid":5,"idx":0}']
    found = smallfiles.extract_records(files(spark, bodies), "body", {"uid": "bigint", "idx": "int"}, ("kind",))
    assert rows(found.select("kind", "uid", "idx")) == [("masks", u, i) for u, i in ((1, 0), (1, 1), (2, 0), (3, 0), (5, 0))]


@pytest.mark.parametrize("inner", ["[" + "1," * 500_000 + "1]", '"' + "x{" * 500_000 + '"', '{"a":{"b":[' + ",".join('{"c":1}' for _ in range(100_000)) + "]}}"])
def test_records_of_a_megabyte(spark, inner):
    bodies = ['{"uid":1,"idx":0,"f":%s}\n{"uid":1,"idx":1}' % inner]
    found = smallfiles.extract_records(files(spark, bodies), "body", {"uid": "bigint", "idx": "int"}, ("kind",))
    assert rows(found.select("kind", "uid", "idx", F.length("record"))) == [("masks", 1, 0, len(bodies[0]) - 18), ("masks", 1, 1, 17)]


def test_records_deeper_than_the_decoder(spark):
    deep = '{"uid":1,"idx":0,"d":%s,"e":2}' % ("[" * 200_000 + "]" * 200_000)
    assert [v["idx"] for v, _ in smallfiles.objects_in(deep + '{"uid":1,"idx":5}', ["uid", "idx"])] == [0, 5]
    assert [v["idx"] for v, _ in smallfiles.objects_in(deep[:-9] + '\n{"uid":1,"idx":5}', ["uid", "idx"])] == [5]


def test_keys_that_do_not_fit(spark):
    bodies = ['{"uid":"1","idx":0}{"uid":1.0,"idx":2}{"uid":true,"idx":1}{"uid":1,"idx":3000000000}{"uid":1,"idx":1.5}']
    found = smallfiles.extract_records(files(spark, bodies), "body", {"uid": "bigint", "idx": "int"}, ("kind",))
    assert rows(found.select("uid", "idx")) == [(1, 2)]


SMALL = {"run_bytes": 1500, "range_bytes": 4000}


def test_store_holds_each_record_once_and_sorted(spark, tmp_path):
    bodies = ['{"uid":%d,"idx":%d,"area":%d}' % (i % 25, i % 3, i) for i in range(600)]
    path, manifest = smallfiles.consolidate_files(files(spark, bodies).repartition(7), path=f"file://{tmp_path}/store", target_bytes=2000, fan_in=3, **SMALL)
    store = smallfiles.read_store(spark, path)
    assert rows(store.select("uid", "idx")) == sorted({(i % 25, i % 3) for i in range(600)})
    first = {}
    for i, body in enumerate(bodies):  # odd numbers arrive first; of equal arrivals the least text stays
        first[i % 25, i % 3] = min(first.get((i % 25, i % 3), (2, "")), (1 - i % 2, body))
    assert all(first[r["uid"], r["idx"]][1] == r["record"] for r in store.collect())
    parts = sorted(manifest.collect(), key=lambda r: r["first_key"])
    assert len(parts) > 1 and sum(r["rows"] for r in parts) == store.count()
    assert all(a["last_key"] < b["first_key"] for a, b in zip(parts, parts[1:]))


@pytest.mark.parametrize("hot", [0.0, 0.4])
def test_merge_keeps_duplicates_and_cuts_a_hot_key(spark, tmp_path, hot):
    import random

    r = random.Random(int(hot * 10))
    made = [(None if r.random() < 0.1 else ("hot" if r.random() < hot else f"k{r.randrange(40):02d}"), r.randrange(5), "v" * r.randrange(9)) for _ in range(4000)]
    df = spark.createDataFrame(made, "k string, n int, v string")
    out = smallfiles.consolidate(df.repartition(5), ["k", "n"], f"file://{tmp_path}/s", target_bytes=4000, run_bytes=20_000, range_bytes=10_000, fan_in=4)
    store = smallfiles.read_store(spark, f"file://{tmp_path}/s")
    key = lambda x: (x[0] is not None, x[0] or "", x[1], x[2])
    assert sorted(map(tuple, store.collect()), key=key) == sorted(made, key=key)
    assert sum(x["rows"] for x in out.collect()) == 4000
    if hot:
        assert sum(x["first_key"]["k"] == "hot" == x["last_key"]["k"] for x in out.collect()) > 1


def test_a_store_takes_more_records_and_updates_its_ranges(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    df = spark.range(5000).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    one = smallfiles.consolidate(df, ["k"], path, target_bytes=3000, run_bytes=40_000, range_bytes=40_000).collect()
    two = smallfiles.consolidate(df.filter("k between 1000 and 1100"), ["k"], path, target_bytes=3000, run_bytes=40_000, range_bytes=40_000).collect()
    assert smallfiles.read_store(spark, path).count() == 5101 == sum(r["rows"] for r in two)
    untouched = {r["file"] for r in one if r["last_key"]["k"] < 1000 or r["first_key"]["k"] > 1100}
    assert untouched and untouched <= {r["file"] for r in two} and len({r["file"] for r in one} - {r["file"] for r in two}) >= 1
    keys = sorted((r["first_key"]["k"], r["last_key"]["k"]) for r in two)
    assert all(a[1] <= b[0] for a, b in zip(keys, keys[1:]))
    smallfiles.consolidate(df.limit(0), ["k"], path)
    assert smallfiles.read_store(spark, path).count() == 5101
    assert smallfiles.vacuum(spark, path) >= 1 and smallfiles.read_store(spark, path).count() == 5101
    assert smallfiles.vacuum(spark, path) == 0


def test_tiny_files_on_disk(spark, tmp_path):
    for i in range(40):
        (tmp_path / "in" / f"d{i % 3}").mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / f"d{i % 3}" / f"{i}.json").write_bytes(b'{"uid":%d,"idx":0,"s":"\xff"}\n{"uid":%d,"idx":1}' % (i, i // 2))
    files = smallfiles.tiny_files(spark, f"file://{tmp_path}/in").withColumn("kind", F.regexp_extract("path", "/(d[0-9])/", 1))
    path, parts = smallfiles.consolidate_files(files, path=f"file://{tmp_path}/out")
    assert smallfiles.read_store(spark, path).count() == 80 - sum(1 for i in range(40) for j in range(i) if i // 2 == j // 2 and i % 3 == j % 3)
    assert parts.count() == 3 and all(r["first_key"]["kind"] == r["last_key"]["kind"] for r in parts.collect())


def test_consolidation_of_odd_tables(spark, tmp_path):
    twice = spark.createDataFrame([("a", 1), ("a", 1), ("b", None)], "k string, v int")
    smallfiles.consolidate(twice, ["k", "v"], f"file://{tmp_path}/d")
    assert smallfiles.read_store(spark, f"file://{tmp_path}/d").count() == 3
    empty = smallfiles.consolidate(twice.limit(0), ["k", "v"], f"file://{tmp_path}/e")
    assert empty.count() == 0 and smallfiles.read_store(spark, f"file://{tmp_path}/e").count() == 0
    with pytest.raises(ValueError):
        smallfiles.consolidate(twice.withColumn("x", F.lit(1.5)), ["x"], f"file://{tmp_path}/f")


def changes(spark, bodies, stream="s"):
    made = [(i, stream, "eval", T(2025, 1 + i % 12, 1 + i), T(2026, 1, 1), b) for i, b in enumerate(bodies)]
    df = spark.createDataFrame(made + made[:1], "file_id bigint, stream_id string, kind string, written_at timestamp, arrived_at timestamp, body string")
    return drift.schema_changes(drift.read_fields(drift.single_files(df)))


def test_each_kind_of_change(spark):
    found = changes(spark, ['{"a": 1, "mean_iou": 0.51, "b": {"c": "x"}}', '{"a": "1", "meanIou": 0.52, "b": {"c": null}, "n": [1, 2]}', '{"a": "1", "summary": {"meanIou": 0.52}, "b": {"c": 3}}', "no json", "[1]", None])
    assert rows(found) == sorted([
        (1, "renamed", "mean_iou", "meanIou"), (1, "retyped", "a", "a"), (1, "added", "", "n"),
        (2, "renamed", "meanIou", "summary.meanIou"), (2, "removed", "n", ""), (2, "retyped", "b.c", "b.c"),
    ])


def test_files_of_many_rows_have_statistics(spark):
    bodies = ['{"a": 1, "b": null}\n{"a": 2.5}\n{"a": 7, "c": {"d": [1]}}', '[{"a": "x"}, {"a": "y"}, {"a": 1}]', "{torn", None, ""]
    df = spark.createDataFrame([(i, "s", A, b) for i, b in enumerate(bodies)], "file_id bigint, stream_id string, written_at timestamp, body string")
    fields = drift.read_fields(df)
    got = {(r["file_id"], r["path"]): (r["type"], r["value"], r["n"], r["types"]) for r in fields.collect()}
    assert got == {
        (0, "a"): ("integer", "1", 3, {"integer": 2, "decimal": 1}), (0, "b"): (None, None, 1, {}), (0, "c.d"): ("list", "[1]", 1, {"list": 1}),
        (1, "a"): ("string", "x", 3, {"string": 2, "integer": 1}),
    }
    total = {(r["path"], r["type"]): (r["files"], r["rows"]) for r in drift.drift_statistics(fields).collect()}
    assert total == {("a", "integer"): (2, 3), ("a", "decimal"): (1, 1), ("a", "string"): (1, 2), ("c.d", "list"): (1, 1)}


def test_words_of_many_names_tell_little():
    weights = drift.word_weights(["mean_iou", "meanConfidence", "mean_size", "backend", "iou_max", "num_masks"])
    assert weights["mean"] < weights["iou"] < weights["backend"]
    assert drift.name_likeness("a.mean_iou", "b.meanIou", weights) == 1.0
    assert drift.name_likeness("mean_iou", "mean_size", weights) < drift.name_likeness("mean_iou", "iou_max", weights)


def test_unlike_fields_are_no_rename(spark):
    found = changes(spark, ['{"mean_mask_best_iou": 0.7, "k": 1}', '{"total_selected_masks": 700, "k": 1.0}'])
    assert rows(found) == [(1, "added", "", "total_selected_masks"), (1, "removed", "mean_mask_best_iou", ""), (1, "retyped", "k", "k")]


def test_first_files_and_empty_tables_have_no_change(spark):
    assert changes(spark, ['{"a": 1}']).count() == 0
    assert changes(spark, ['{"a": 1}'] * 3).count() == 0
    assert changes(spark, ['{"a": 1}', '{"b": true}'], None).count() == 2


def test_typed_table_and_failed_casts(spark):
    bodies = ['{"v": 1.5, "t": "x"}', '{"v": "bad", "t": "y"}', '{"v": [2.5], "t": null}', '{"v": "50%"}']
    made = [(i, "s", "eval", T(2025, 1, 1 + i), A, b) for i, b in enumerate(bodies)]
    df = drift.single_files(spark.createDataFrame(made, "file_id bigint, stream_id string, kind string, written_at timestamp, arrived_at timestamp, body string"))
    fields = drift.read_fields(df)
    values, types = drift.typed_values(fields, drift.schema_changes(fields))
    numbers = {"t": "string", "v": "double"}
    assert set(types) == {"t", "v"}
    table = {r["file_id"]: r["v"] for r in drift.consistent_table(df, values, numbers).collect()}
    assert table == {0: 1.5, 1: None, 2: 2.5, 3: 0.5}
    assert rows(drift.failed_casts(values, numbers).select("file_id", "field", "value", "wanted")) == [(1, "v", "bad", "double")]


def test_every_row_of_a_file_is_in_the_table_or_reported(spark):
    bodies = ['{"v": 1.5}\n{"v": "bad"}\n{"v": 3.5, "a.b": 1, "a": {"b": "odd"}}', '[{"v": 4.5}, {"v": null}]', "{torn"]
    made = [(i, "s", "eval", T(2025, 1, 1 + i), A, b) for i, b in enumerate(bodies)]
    df = drift.single_files(spark.createDataFrame(made, "file_id bigint, stream_id string, kind string, written_at timestamp, arrived_at timestamp, body string"))
    fields = drift.read_fields(df)
    values, types = drift.typed_values(fields, drift.schema_changes(fields))
    wanted = {"b": "bigint", "v": "double"}
    assert set(types) == {"b", "v"} and types["v"] == "double"
    table = {(r["file_id"], r["row"]): r["v"] for r in drift.consistent_table(df, values, wanted).collect()}
    assert table == {(0, 0): 1.5, (0, 1): None, (0, 2): 3.5, (1, 0): 4.5, (1, 1): None, (2, None): None}
    assert rows(drift.failed_casts(values, wanted).select("file_id", "row", "field", "value")) == [(0, 1, "v", "bad"), (0, 2, "b", "odd")]


@pytest.mark.parametrize("seed", range(3))
def test_row_before_over_buckets_equals_a_plain_scan(spark, seed):
    import random

    r = random.Random(seed)
    made = [(i, r.choice([None, "a", "b"]), r.randrange(60), r.choice([None, 1, 2])) for i in range(80)]
    df = spark.createDataFrame(made, "id int, g string, t int, v int")
    got = {x["id"]: x["before"]["v"] if x["before"] else None for x in drift.before_in_group(df, ["g"], ["t", "id"], F.floor(F.col("t") / 7), ["v"], F.col("v").isNotNull()).collect()}
    for i, g, t, _ in made:
        earlier = sorted((b, a, v) for a, h, b, v in made if h == g and (b, a) < (t, i) and v is not None)
        assert got[i] == (earlier[-1][2] if earlier else None)


def test_places_below_the_root(spark):
    given = {"a/b.pt": "a/b.pt", ".\\a\\b.pt": "a/b.pt", "a/x/../b.pt": "a/b.pt", "./a//./b.pt": "a/b.pt", "../a": "a", "A/b.pt": "A/b.pt", "": None, ".": None, None: None, "/a/": "a"}
    df = spark.createDataFrame([(k,) for k in given], "p string").select("p", references.below_root(F.col("p")).alias("q"))
    assert {r["p"]: r["q"] for r in df.collect()} == given


def test_states_and_match_semantics(spark):
    refs = spark.createDataFrame([(1, 1, "a", A), (2, 1, "b", A), (3, 1, "c", A), (4, 1, "d", B), (5, None, "a", A), (6, None, None, A), (1, 1, "a", A), (7, 2, "a", None), (8, None, "zz", A)], "id int, s int, n string, created timestamp")
    targets = spark.createDataFrame([(1, "b", A, D), (1, "b", B, D), (1, "c", B, None), (1, "c", C, None), (1, "d", A, None), (None, "a", A, None), (2, "a", D, None)], "s int, n string, arrived timestamp, deleted timestamp")
    state = lambda m: rows(references.reference_states(refs, "id", ["s", "n"], "created", targets, ["s", "n"], "arrived", "deleted", m))
    sound = [(1, "missing", "2025-01"), (2, "deleted", "2025-01"), (3, "late", "2025-01")]
    assert state("simple") == sound
    assert state("full") == sound + [(5, "missing", "2025-01"), (8, "missing", "2025-01")]
    assert state("partial") == sound + [(8, "missing", "2025-01")]
    assert references.reference_states(refs.limit(0), "id", ["s", "n"], "created", targets, ["s", "n"], "arrived").count() == 0
    nothing = references.reference_states(refs, "id", ["s", "n"], "created", targets.limit(0), ["s", "n"], "arrived")
    assert {r["state"] for r in nothing.collect()} == {"missing"}
    with pytest.raises(ValueError):
        state("other")
