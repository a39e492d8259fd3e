"""Hot groups, rare groups, counts beyond 32 bits, keys of other types."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from martloom.llm import common, fertility, interpolation, mixing, sharding, simhash
from martloom.session import stage


def test_edges_of_a_hub_are_split(spark, monkeypatch):
    plans = []

    def spied(df, name):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stage(df.repartition(6), name)  # a partition is split between the tasks that wrote it

    monkeypatch.setattr(common, "stage", spied)
    small = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.files.maxPartitionBytes": "32k", "spark.sql.files.openCostInBytes": "0",
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        edges = spark.range(1, 40_000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
        found = common.components(edges.union(spark.range(50_000, 60_000).select((F.col("id") * 2).alias("a"), (F.col("id") * 2 + 1).alias("b"))))
        assert found.where("root = 0").count() == 40_000 and found.where("root > 0").count() == 20_000
    finally:
        for key in small:
            spark.conf.unset(key)
    assert any("skew=true" in p for p in plans)


def test_totals_beyond_32_bits(spark):
    hashes, many = np.array([5, 9], np.uint64), np.array([3_000_000_000, 7], np.uint32)
    packed = [interpolation.squeeze(np.diff(hashes, prepend=np.uint64(0))), interpolation.squeeze(many), interpolation.squeeze(many)]
    rows = [(0, block, 1, *packed) for block in (1, 2)]
    asked = spark.createDataFrame(rows, "shard int, block long, kind int, hashes binary, total binary, left_out binary")
    found = interpolation.totals(asked).collect()
    told = [r for r in found if r.block is not None]
    assert all(interpolation.expand(r.total, np.uint64).tolist() == [6_000_000_000, 14] for r in told) and len(told) == 2
    assert [r["sum"] for r in found if r.types is not None] == [6_000_000_014]


def brute_kept(rows):
    """Bands by their definition; rows as measured."""
    fair = [r for r in rows if not (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)]

    def quart(group, m):
        values = sorted(getattr(r, m) for r in group)
        return [values[math.ceil(q * len(values)) - 1] for q in (0.25, 0.75)]

    def drawn(group, m, wider):
        return [(a * len(group) + b * 30) / (len(group) + 30) for a, b in zip(quart(group, m), wider)] if group else wider

    out = {}
    for r in rows:
        kept = r in fair and r.byte_share <= 0.1
        for m, upper in (("chars_per_token", True), ("entropy", False)):
            script = drawn([x for x in fair if x.script == r.script], m, quart(fair, m))
            low, high = drawn([x for x in fair if x.lang == r.lang], m, script)
            reach = 4 * (1 + math.sqrt(64 / max(r.n_tokens, 1))) * (high - low)
            kept = kept and getattr(r, m) >= low - reach and (not upper or getattr(r, m) <= high + reach)
        out[r.row.doc_id] = kept
    return out


def test_bands_equal_brute_force(spark, docs):
    few = docs.where("doc_id < 200").dropDuplicates(["doc_id"]).withColumn("lang", F.when(F.col("doc_id") % 11 == 0, "rare").otherwise(F.col("lang")))
    measured = stage(fertility.measured(few), "measured")
    got = {r.row.doc_id: r.kept for r in fertility.judge(measured).collect()}
    assert got == brute_kept(measured.collect())


@pytest.mark.parametrize("n", [1, 25, 29, 30, 31, 50])
def test_rare_languages_have_bands(spark, n):
    rng = random.Random(n)

    def prose(letters):
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(150))

    rows = [(k, prose("aeioulnrst"), "en") for k in range(80)] + [(100 + k, prose("aeioulnrst"), "fr") for k in range(n)]
    rows += [(999, " ".join("%&#@~" for _ in range(200)) + " " + " ".join(map(str, range(90))), "fr"), (998, prose("aeioulnrst"), "xx")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.row.doc_id: r.kept for r in fertility.judge(fertility.measured(frame)).collect()}
    assert not got[999] and all(v for k, v in got.items() if k != 999)


def test_scripts():
    texts = {"Привет, world!": "cyrillic", "ab где": "cyrillic", "αβγ": "greek", "漢字 ab": "latin", "漢字漢": "han", "": "none", "12 34": "none", "é": "latin"}
    assert {t: fertility.script_of(t) for t in texts} == texts


def test_shard_does_not_depend_on_the_key_type(spark):
    ids = spark.range(2000).select("id", F.col("id").cast("int").alias("small"), F.col("id").cast("string").alias("text"))
    found = ids.select(*[sharding.shard_of(F.col(c), 200).alias(c) for c in ids.columns]).collect()
    assert all(r.id == r.small == r.text for r in found) and len({r.id for r in found}) == 200


def test_mixing_stage_moves_texts_once_and_unsorted(spark, docs):
    got = mixing.stage_mix(spark, docs, "")
    assert got.columns == docs.columns
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    want = mixing.emit(mixing.mix(docs, common.word_count(F.col("text")), mixing.cycle_weights(docs)), docs.columns)
    count = lambda df: {r.s: r.n for r in df.groupBy(F.col("source").alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert count(got) == count(want)


def test_many_sources_are_named(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "MANY", 2)
    with pytest.warns(UserWarning, match="sources"):
        mixing.mix(docs, F.lit(1), mixing.cycle_weights(docs))


@pytest.mark.parametrize("own", [60, 6])
def test_pairs_grow_with_texts_that_share_a_notice(spark, monkeypatch, own):
    """A notice of fifty words in every text: what is verified does not grow with the square."""
    rng = random.Random(own)
    notice = " ".join(f"n{k}" for k in range(50))
    met = {}

    def spied(df, name):
        out = stage(df, name)
        if name in ("star-pairs", "open-pairs"):
            met[n] = met.get(n, 0) + out.count()
        return out

    monkeypatch.setattr(simhash, "stage", spied)
    for n in (300, 1200):
        texts = [(k, " ".join(f"w{rng.randrange(10**6)}" for _ in range(own)) + " " + notice) for k in range(n)]
        found = simhash.groups_of_near_copies(stage(spark.createDataFrame(texts, "id long, text string"), "texts"))
        assert found.count() == 0
    assert met[1200] <= 6 * max(met[300], 300)
