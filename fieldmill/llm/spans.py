"""Long exact spans shared between records, by prefix-partitioned suffix subtrees.

A suffix of a text matters only if its first ``min_len`` characters occur in another record. Its *prefix key* ends with the anchor: the
leftmost ``gram``-character substring of least hash among those inside the first ``min_len`` characters. The key's length varies with
the text (``gram`` to ``min_len`` characters), and equal suffixes have equal keys, so the keys partition all suffixes. Neighbouring
suffixes mostly share their anchor; such a run is one row, about two rows for every ``min_len - gram`` characters. Keys met in one record
only are dropped before any text moves. The rest become subtrees: the suffixes of a key, sorted, in which neighbours that agree on
``min_len`` characters lie below one deep internal node. A node with two records or more makes its characters shared.

Equal contexts are joined into one before they are sorted. A key with more contexts than fit one subtree is partitioned again by longer
prefixes: its suffixes are halved by how far before the anchor they begin, all suffixes of a half have more characters around the anchor
in common, and these extend the key; keys that then belong to one record only are dropped. At the last step the key is the whole piece of
``min_len`` characters, whose equal contexts are one row, so every group becomes small, whatever a third of all records share. Texts of any
length are cut into overlapping pieces, never shortened.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldmill.session import cut, discard, partitions

#: Bytes of contexts that one task sorts.
_TASK_BYTES = 16 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BATCH = 1_500_000
_PIECE = 4_000_000
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        up = np.full(n, _BASE)
        down = np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)))
        up[:1] = down[:1] = 1
        _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS[0], _POWERS[1]


def _gram_hashes(points: np.ndarray, gram: int) -> np.ndarray:
    """A mixed 64-bit hash of each ``gram`` consecutive code points."""
    n = len(points)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.multiply(points + np.uint64(1), up[:n], out=sums[1:])
    np.cumsum(sums, out=sums)
    h = sums[gram:] - sums[:-gram]
    h *= down[: n - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` consecutive values, from running minima of blocks in both directions."""
    n = len(x)
    pad = np.full(-n % w, np.iinfo(x.dtype).max, dtype=x.dtype)
    blocks = np.concatenate([x, pad]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def _runs(texts: list[str], min_len: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of several texts: which text, key hash, first suffix, number of suffixes and the anchor's place, one entry a run."""
    sizes = np.array([len(t) for t in texts])
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    w = min_len - gram + 1
    h = _gram_hashes(points, gram)
    packed = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    place = (_sliding_min(packed, w) & np.uint64(0xFFFFFF)).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    inside = np.zeros(len(points) + 1, dtype=np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + sizes - min_len + 1, -1)
    valid = np.cumsum(inside[: len(place)]) > 0
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(place)]
    first = valid.copy()
    first[1:] &= (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    # A run ends before the next one, or where its text has no further suffix of min_len characters.
    who = owner[at]
    end = np.minimum(np.append(at[1:], len(place)), (starts + sizes - min_len + 1)[who])
    return who, h[place[at]].view(np.int64), at - starts[who], end - at, place[at] - starts[who]


def _pieces(docs: list[int | str], texts: list[str | None], min_len: int) -> Iterator[list[tuple[object, int, str]]]:
    """Batches of (record, offset, text) that fit in memory together; long texts in pieces that overlap by min_len - 1."""
    batch, size = [], 0
    for doc, text in zip(docs, texts):
        if doc is None or text is None or len(text) < min_len:
            continue
        for start in range(0, max(1, len(text) - min_len + 1), _PIECE):
            piece = text[start : start + _PIECE + min_len - 1]
            if batch and size + len(piece) > _BATCH:
                yield batch
                batch, size = [], 0
            batch.append((doc, start, piece))
            size += len(piece)
    if batch:
        yield batch


def suffix_runs(df: DataFrame, id_col: str, text_col: str, min_len: int, gram: int) -> DataFrame:
    """One row a run of neighbouring suffixes with one prefix key: doc, h, start, n, anchor."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _pieces(batch.column(0).to_pylist(), batch.column(1).to_pylist(), min_len):
                who, h, start, n, anchor = _runs([x[2] for x in part], min_len, gram)
                docs = pa.array([x[0] for x in part], batch.schema.field(0).type).take(pa.array(who))
                base = np.array([x[1] for x in part])[who]
                yield pa.RecordBatch.from_arrays(
                    [docs, pa.array(h), *(pa.array(x.astype(np.int32)) for x in (start + base, n, anchor + base))],
                    ["doc", "h", "start", "n", "anchor"],
                )

    return df.select(id_col, text_col).mapInArrow(run, f"doc {kind}, h bigint, start int, n int, anchor int")


def _contexts(runs: DataFrame, df: DataFrame, id_col: str, text_col: str, min_len: int) -> DataFrame:
    """The text under each run: doc, start, h, anchor (in the context), context."""
    by_doc = runs.groupBy("doc").agg(F.collect_list(F.struct("start", "n", "anchor", "h")).alias("runs"))
    texts = df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    joined = texts.join(by_doc.hint("shuffle_hash"), "doc")
    cell = F.col("run")
    return joined.select("doc", "text", F.explode("runs").alias("run")).select(
        "doc",
        cell.start.alias("start"),
        cell.h.alias("h"),
        (cell.anchor - cell.start).alias("anchor"),
        F.substring(F.col("text"), cell.start + 1, cell.n + (min_len - 1)).alias("context"),
    )


def common_prefix(a: str, b: str, known: int = 0) -> int:
    """Length of the longest common prefix of two texts that agree on ``known`` characters, by halving."""
    low, high = known, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def deep_nodes(suffixes: list[str], min_len: int) -> Iterator[tuple[int, int, int]]:
    """(depth, first leaf, last leaf) of the internal nodes of at least ``min_len`` characters of the suffix tree whose leaves are the sorted
    ``suffixes``, children before their parents. A node's depth is what all suffixes below it have in common: a repeat that no further
    character to the right prolongs."""
    stack: list[tuple[int, int]] = []  # (depth, first leaf) of the open nodes, the deepest last
    for k in range(1, len(suffixes) + 1):
        depth = 0
        if k < len(suffixes) and suffixes[k - 1][:min_len] == suffixes[k][:min_len]:
            depth = common_prefix(suffixes[k - 1], suffixes[k], min_len)
        first = k - 1
        while stack and stack[-1][0] > depth:
            deep, first = stack.pop()
            yield deep, first, k - 1
        if depth >= min_len and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def _shared_intervals_of(rows: list[tuple], min_len: int) -> Iterator[tuple[bytes, int, int]]:
    """Shared intervals of the contexts under one prefix key; rows: digest, anchor, context, least record, greatest record, from, to.

    The subtree's leaves are the suffixes of the contexts; each one is shared up to the depth of the deepest node above it that has leaves
    of two records.
    """
    found: dict[bytes, list[tuple[int, int]]] = {}
    for digest, _, context, least, greatest, _, _ in rows:
        if least < greatest:  # the context itself stands in two records
            found.setdefault(digest, []).append((0, len(context)))
    lengths = range(min(r[5] for r in rows), max(r[6] for r in rows)) if len(rows) > 1 else range(0)
    step = max(1, 100_000 // len(rows))
    for low in range(lengths.start, lengths.stop, step):
        # Suffixes whose key reaches from low to low + step characters before the anchor: a subtree that fits in memory.
        leaves = []
        for i, (_, anchor, context, _, _, a, b) in enumerate(rows):
            for ahead in range(max(low, a, anchor - (len(context) - min_len)), min(low + step, b, anchor + 1)):
                leaves.append((context[anchor - ahead :], i, anchor - ahead))
        leaves.sort()
        covered: list[tuple[int, int]] = []  # disjoint runs of leaves below shared nodes met so far
        for depth, first, last in deep_nodes([x[0] for x in leaves], min_len):
            below = leaves[first : last + 1]
            if min(rows[x[1]][3] for x in below) == max(rows[x[1]][4] for x in below):
                continue
            inner = []
            while covered and covered[-1][0] >= first:
                inner.append(covered.pop())
            done = first
            for start, stop in reversed(inner):
                for _, k, at in leaves[done:start]:
                    found.setdefault(rows[k][0], []).append((at, at + depth))
                done = stop + 1
            for _, k, at in leaves[done : last + 1]:
                found.setdefault(rows[k][0], []).append((at, at + depth))
            covered.append((first, last))
    for digest, spans in found.items():
        spans.sort()
        start, end = spans[0]
        for a, b in spans[1:]:
            if a > end:
                yield digest, start, end
                start, end = a, b
            end = max(end, b)
        yield digest, start, end


def _extended(contexts: DataFrame, min_len: int) -> DataFrame:
    """Contexts of heavy keys under longer ones: the suffixes lo..hi characters before the anchor in two halves, each context cut to what
    the suffixes of its half reach, the key extended by the characters that all of them have; keys of one record are dropped."""
    middle = F.expr("(lo + hi) div 2")
    halves = F.array(F.struct(F.col("lo").alias("l"), middle.alias("r")), F.struct(middle.alias("l"), F.col("hi").alias("r")))
    size = F.length("context")
    rows = contexts.withColumn("half", F.explode(halves)).select("doc", "start", "h", "anchor", "context", F.col("half.l").alias("lo"), F.col("half.r").alias("hi"))
    rows = rows.filter("lo < hi and anchor >= lo").filter(F.col("anchor") - (size - min_len) < F.col("hi"))
    begin = F.greatest(F.lit(0), F.col("anchor") - (F.col("hi") - 1))
    end = F.least(size, F.col("anchor") - F.col("lo") + min_len)
    core = F.substring(F.col("context"), F.col("anchor") - F.col("lo") + 1, F.lit(min_len + 1) - F.col("hi") + F.col("lo"))
    cutout = rows.select(
        "doc", (F.col("start") + begin).alias("start"), F.xxhash64("h", "lo", "hi", core).alias("h"), (F.col("anchor") - begin).alias("anchor"),
        F.substring(F.col("context"), begin + 1, end - begin).alias("context"), "lo", "hi",
    ).withColumn("digest", F.unhex(F.md5("context")))
    cutout = cut(cutout, "contexts")
    keys = cutout.groupBy("h").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).filter("a < b").select("h")
    return cutout.join(keys, "h", "left_semi").select("doc", "start", "h", "anchor", "context", "lo", "hi", "digest")


def _light(contexts: DataFrame, min_len: int, split_above: int) -> DataFrame:
    """All contexts under keys of at most ``split_above`` distinct ones."""
    done = []
    while True:
        crowded = contexts.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > split_above).select("h")
        heavy = contexts.join(crowded, "h", "left_semi").groupBy("h", "digest").agg(F.lit(1)).groupBy("h").agg(F.count("*").alias("n"))
        heavy = cut(heavy.filter(F.col("n") > split_above).select("h"), "heavy")
        if heavy.isEmpty():
            break
        done.append(contexts.join(heavy, "h", "left_anti").select(contexts.columns))
        contexts = cut(_extended(contexts.join(heavy, "h", "left_semi"), min_len), "contexts")
    for part in done:
        contexts = contexts.union(part)
    return contexts


def shared_intervals(
    df: DataFrame, id_col: str, text_col: str, min_len: int = 200, gram: int = 64, split_above: int = 4096
) -> DataFrame:
    """``id_col``, span_start, span_end: the maximal runs of characters that lie in a piece of ``min_len`` or more characters which
    occurs exactly so in another record (code points, from 0, end exclusive).

    Null ids, null texts and texts under ``min_len`` characters have no span; rows repeated under one id are one record; an empty table
    gives no rows. Other columns are not read. ``gram`` and ``split_above`` change the work, never the result.
    """
    if not 0 < gram <= min_len:
        raise ValueError("gram must lie between 1 and min_len")
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    runs = cut(suffix_runs(df, id_col, text_col, min_len, gram), "runs")
    keys = runs.groupBy("h").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).filter("a < b").select("h")
    contexts = _contexts(runs.join(keys, "h", "left_semi"), df, id_col, text_col, min_len)
    whole = contexts.withColumns({"lo": F.lit(0), "hi": F.lit(min_len - gram + 1), "digest": F.unhex(F.md5("context"))})
    contexts = cut(whole.select("doc", "start", "h", "anchor", "context", "lo", "hi", "digest"), "contexts")
    discard(runs)
    tasks = max(partitions(spark), -(-contexts.count() * 3 * min_len // _TASK_BYTES))
    contexts = _light(contexts, min_len, split_above)
    placed = contexts.groupBy("h", "lo", "hi", "anchor", "digest").agg(F.first("context").alias("context"), F.min("doc").alias("a"), F.max("doc").alias("b"))
    wanted = ["h", "lo", "hi", "digest", "anchor", "context", "a", "b"]
    placed = placed.select(wanted).repartition(tasks, "h").sortWithinPartitions("h", "lo")

    def subtrees(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if len(rows) > 1 or rows[0][3] < rows[0][4]:
                found = list(_shared_intervals_of(rows, min_len))
                if found:
                    d, s, e = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array(d, pa.binary()), pa.array(s, pa.int32()), pa.array(e, pa.int32())], ["digest", "s", "e"])

        group, rows = None, []
        for batch in batches:
            h, lo, hi, digest, anchor, context, a, b = (c.to_pylist() for c in batch.columns)
            for i in range(len(h)):
                if (h[i], lo[i]) != group:
                    if rows:
                        yield from out(rows)
                    group, rows = (h[i], lo[i]), []
                rows.append((digest[i], anchor[i], context[i], a[i], b[i], lo[i], hi[i]))
        if rows:
            yield from out(rows)

    found = placed.mapInArrow(subtrees, "digest binary, s int, e int").distinct()
    spans = contexts.select("digest", "doc", "start").join(found, "digest")
    spans = spans.select("doc", (F.col("start") + F.col("s")).alias("s"), (F.col("start") + F.col("e")).alias("e"))
    order = Window.partitionBy("doc").orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("new", F.when(reach >= F.col("s"), 0).otherwise(1))
    islands = opened.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("doc", "island").agg(F.min("s").alias("span_start"), F.max("e").alias("span_end")).select(
        F.col("doc").cast(kind).alias(id_col), "span_start", "span_end"
    )


def shared_share(df: DataFrame, id_col: str, text_col: str, **options: int) -> DataFrame:
    """For each record its length in characters, how many of them are shared elsewhere, and their share (0 for an empty text)."""
    spans = shared_intervals(df, id_col, text_col, **options)
    totals = spans.groupBy(id_col).agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"), F.count("*").alias("spans"))
    sizes = df.groupBy(id_col).agg(F.max(F.coalesce(F.length(text_col), F.lit(0))).cast("bigint").alias("n_chars"))
    shared = F.coalesce("shared_chars", F.lit(0)).cast("bigint")
    share = F.round(F.when(F.col("n_chars") > 0, shared / F.col("n_chars")).otherwise(0.0), 6)
    return sizes.join(totals, id_col, "left").select(
        id_col, "n_chars", shared.alias("shared_chars"), F.coalesce("spans", F.lit(0)).cast("bigint").alias("spans"), share.alias("share")
    )


def shared_passages(df: DataFrame, id_col: str, text_col: str, **options: int) -> DataFrame:
    """The maximal shared passages as texts: length, number of records with just this run, first record and its place."""
    spans = shared_intervals(df, id_col, text_col, **options)
    piece = F.substring(F.col(text_col), F.col("span_start") + 1, F.col("span_end") - F.col("span_start"))
    cutouts = spans.join(df.select(id_col, text_col), id_col).select(id_col, "span_start", piece.alias("passage"))
    grouped = cutouts.groupBy(F.md5("passage").alias("digest")).agg(
        F.first("passage").alias("passage"), F.count_distinct(id_col).alias("records"), F.min(F.struct(id_col, "span_start")).alias("at")
    )
    return grouped.select("digest", F.length("passage").alias("n_chars"), "records", F.col(f"at.{id_col}").alias("first_record"), F.col("at.span_start").alias("first_start"), "passage")
