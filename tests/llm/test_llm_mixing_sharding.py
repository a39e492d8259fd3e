import math
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from martloom.llm import mixing, sharding
from martloom.llm.common import components, positions, word_count


def brute_targets(sizes, weights, share, most):
    open_, target = {s for s in sizes if weights[s] > 0}, {}
    left = share * sum(sizes.values())
    while open_:
        total = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / total > most * sizes[s]}
        if not over:
            target.update({s: left * weights[s] / total for s in open_})
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return {s: target.get(s, 0.0) for s in sizes}


def test_targets_are_filled_by_weight(spark):
    cases = [
        ({"a": 100, "b": 1000, "c": 10, "d": 0}, {"a": 5.0, "b": 2.0, "c": 1.0, "d": 5.0}),
        ({"a": 10, "b": 10, "c": 10000}, {"a": 1.0, "b": 1.0, "c": 0.0}),
        ({"a": 7}, {"a": 3.0}),
        ({None: 50, "é": 5, "z": 500, "y": 1}, {None: 1.0, "é": 5.0, "z": 2.0, "y": 9.0}),
    ]
    for sizes, weights in cases:
        got = mixing.targets(
            spark.createDataFrame(list(sizes.items()), "source string, source_size long"),
            spark.createDataFrame(list(weights.items()), "source string, weight double"),
        ).collect()
        want = brute_targets(sizes, weights, 1.5, 2.0)
        assert {r.source for r in got} == set(want)
        for r in got:
            assert math.isclose(r.target, want[r.source], rel_tol=1e-12), (sizes, r)


def test_mix_of_edge_documents(spark, docs):
    run = lambda: mixing.mix(docs, word_count(F.col("text")), mixing.cycle_weights(docs))
    rows = run().collect()
    assert len(rows) == docs.count()
    by = defaultdict(list)
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.row.text or ""))
        by[r.source].append(r)
    order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    sizes = {s: sum(r.size for r in by[s]) for s in by}
    want = brute_targets(sizes, {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(order)}, 1.5, 2.0)
    for s, members in by.items():
        assert math.isclose(members[0].target, want[s], rel_tol=1e-12) and members[0].source_size == sizes[s]
        assert all(0 <= r.copies <= 2 for r in members)
        taken = sum(r.copies * r.size for r in members)
        assert abs(taken - want[s]) <= 2 * max(r.size for r in members)
        # Systematic: in order of size, copies up to any place are within one of what is expected.
        rate = want[s] / sizes[s]
        drawn = 0
        for k, r in enumerate(sorted(members, key=lambda r: (r.size, r.row.doc_id is not None, r.row.doc_id or 0, -r.copies)), 1):
            drawn += r.copies
            assert abs(drawn - k * rate) <= 2
    again = Counter((r.row, r.copies) for r in run().collect())
    assert Counter((r.row, r.copies) for r in rows) == again
    out = mixing.emit(run(), docs.columns)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in rows)


def test_one_source_with_most_rows(spark):
    df = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"),
        (F.col("id") % 50).alias("n"),
    )
    rows = mixing.mix(df, F.col("n"), mixing.cycle_weights(df)).collect()
    taken, target = Counter(), {}
    for r in rows:
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 100 for s in target)


def test_jump_is_consistent():
    keys = np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64)

    def plain(key, n):
        b, j, key = -1, 0, int(key)
        while j < n:
            b = j
            key = (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
        return b

    got = sharding.jump(keys, 40)
    assert got[:2000].tolist() == [plain(k, 40) for k in keys[:2000]]
    grown = sharding.jump(keys, 41)
    assert set(grown[grown != got]) == {40} and abs((grown != got).mean() - 1 / 41) < 0.005
    assert np.bincount(got, minlength=40).min() > 400 and (sharding.jump(keys, 1) == 0).all()


def test_shards_of_edge_documents(spark, docs, edge_dir, tmp_path):
    import zlib

    rows = sharding.op9_sharding(spark, edge_dir).collect()
    source = docs.select("doc_id", "text").collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter(
        (r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in source
    )
    slots, shard = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        shard[r.doc_id].add((r.shard, r.grown_shard))
        assert r.law == "key" and r.grown_shard in (r.shard, 40) and 0 <= r.shard < 40
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in shard.values())
    sharding.write_shards(docs, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out")).drop("__shard")
    assert back.columns == docs.columns and back.count() == docs.count()


def test_positions_and_components(spark):
    df = spark.range(500).select((F.col("id") % 5).alias("g"), F.lit(1).alias("tie"), F.col("id").alias("v"))
    rows = positions(df.where("g < 4"), ["g"], ["tie"], "p").collect()
    found = defaultdict(list)
    for r in rows:
        found[r.g].append(r.p)
    assert all(sorted(p) == list(range(100)) for p in found.values())
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(1000, 1080)] + [(2000, k) for k in range(2001, 2200)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
