"""Prefix trie, resampling, decontamination: edge tables against SQL and brute force."""

import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from martloom.llm import decontamination as dec
from martloom.llm import resampling as res
from martloom.llm import trie
from martloom.llm.common import plain_words
from martloom.session import stage


def sql_rows(sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(f"_{name}", frame.toArrow())
        con.execute(f"CREATE TABLE {name} AS FROM _{name}")
    return Counter(con.execute(sql).fetchall())


def rows_of(df):
    return Counter(map(tuple, df.collect()))


# ---- 11 ------------------------------------------------------------------


def conversations():
    rng = random.Random(11)
    pool = [("user", "hello there"), ("assistant", "hi"), ("user", None), (None, "x y z"), ("assistant", ""), ("user", "é ü ☃ \x1c w")]
    rows = []
    for c in [*range(-25, 65), 1000, 1001, 1019]:
        for k in range(rng.randint(0, 6)):
            role, text = pool[rng.choice([0, 0, 0, 1, 2, 3, 4, 5])]
            rows.append((c, rng.choice([k, k, None]), role, text, 1.5))
    rows += [(200 + c, k, *pool[k % 2], 1.0) for c in range(40) for k in range(4)]  # one very common conversation
    rows += [(7, 3, "user", "tie a", 1.0), (7, 3, "user", "tie b", 1.0), (7, 3, "user", "tie b", 1.0), (None, 0, "user", "nobody's", 1.0)]
    rows += [(8, k, "user", f"turn {k} " * (k % 5), 2.0) for k in range(300)]  # a long one
    rows += [(9, 0, "user", "long " * 20_000, 2.0)]
    return rows


@pytest.fixture(scope="module")
def talk_dir(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("talk"))
    schema = "conv_id long, turn long, role string, text string, `d1.x` double"
    spark.createDataFrame(conversations(), schema).withColumn("shard", F.lit("s")).repartition(3).write.parquet(f"{root}/conversations.parquet")
    return root


def test_trie_equals_sql(spark, talk_dir):
    want = sql_rows(trie.OP11_SQL, conversations=spark.read.parquet(f"{talk_dir}/conversations.parquet"))
    found = trie.op11_trie(spark, talk_dir)
    assert {t for _, t in found.dtypes} == {"bigint", "string"}
    assert rows_of(found) == want


def test_trie_does_not_depend_on_shards(spark, talk_dir):
    lists = trie.turn_lists(spark.read.parquet(f"{talk_dir}/conversations.parquet"))
    members = stage(trie.paths(trie.graft(lists)), "paths")
    many = rows_of(trie.prefix_trie(members, shard_turns=5).select("d1", "d2", "conv_id", "n_convs", "n_ends", "n_leaves", "saved_tokens"))
    few = rows_of(trie.prefix_trie(members).select("d1", "d2", "conv_id", "n_convs", "n_ends", "n_leaves", "saved_tokens"))
    assert many == few


def test_member_digest_in_pieces(spark, talk_dir, monkeypatch):
    lists = trie.turn_lists(spark.read.parquet(f"{talk_dir}/conversations.parquet"))
    members = stage(trie.paths(lists), "paths")
    whole = rows_of(trie.ends_digest(members))
    monkeypatch.setattr(trie, "CHUNK_IDS", 3)
    assert rows_of(trie.ends_digest(members)) == whole


def test_slots_are_minimal_and_verified():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 10, 1000, 20_000):
        keys = np.unique(rng.integers(0, 2**63, (n, 2), np.uint64), axis=0)
        slots = trie.SlotTable(keys)
        assert sorted(slots.find(keys)) == list(range(len(keys)))
        with pytest.raises(ValueError):
            slots.find(keys[:1] + np.uint64(1))


# ---- 12 ------------------------------------------------------------------


def items(spark):
    rows = [(1, "b a d c b a"), (2, None), (None, "ab é☃ cd"), (1, "a b a b"), (3, ""), (4, "w " * 50)]
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.fixture(scope="module")
def text_dir(spark, docs, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("texts"))
    docs.write.parquet(f"{root}/documents.parquet")
    item = docs.where(F.col("doc_id").between(2, 9)).select((F.col("doc_id") % 6).alias("item_id"), F.substring("text", 20, 400).alias("text"))
    item.union(items(spark)).coalesce(1).write.parquet(f"{root}/benchmark.parquet")
    return root


def both_tables(spark, root):
    return {name: spark.read.parquet(f"{root}/{name}.parquet") for name in ("documents", "benchmark")}


def test_resampling_equals_sql(spark, text_dir):
    want = sql_rows(res.OP12_SQL, **both_tables(spark, text_dir))
    found = rows_of(res.op12_resampling(spark, text_dir))
    assert found == want and sum(r[4] is not None for r in found) > 3


def test_cutoff_is_exact(spark):
    rng = random.Random(3)
    rows = [(rng.choice([0, 0, 0, rng.randint(-50, 50)]), k % 9 == 0, k % 40, k % 3, k) for k in range(3000)]
    keys = stage(spark.createDataFrame(rows, "worse long, none boolean, ident long, n_features long, rid long").repartition(5), "keys")
    ordered = sorted(rows)
    for wanted in (1, 2, 777, 1500, 2999, 3000):
        assert tuple(res.cutoff(keys, wanted, few=1, chunk=100)) [:5] == ordered[wanted - 1]
        assert tuple(res.cutoff(keys, wanted))[:5] == ordered[wanted - 1]


def test_text_ids_longer_features_and_other_columns(spark, docs):
    named = docs.withColumn("doc_id", F.concat(F.lit("n"), F.col("doc_id").cast("string"))).withColumn("weight", F.lit(1))
    found = res.resample(named, items(spark), longest=3, percent=50, min_words=5)
    got = found.select("row.*", "n_words", "n_features", F.col("rank").alias("drawn_at")).collect()
    assert len(got) == docs.count() and set(named.columns) <= set(found.select("row.*").columns)
    assert all(r.n_features == sum(max(r.n_words - k, 0) for k in range(3)) for r in got)
    places = sorted(r.drawn_at for r in got if r.drawn_at)
    assert places == list(range(1, sum(r.n_words >= 5 for r in got) // 2 + 1))


def test_empty_target_and_nothing_drawn(spark, docs):
    nothing = items(spark).limit(0)
    assert res.resample(docs, nothing).where("rank is not null").count() > 0
    assert res.resample(docs, items(spark), percent=0).where("rank is not null").count() == 0


# ---- 13 ------------------------------------------------------------------


def test_decontamination_equals_sql(spark, text_dir):
    want = sql_rows(dec.OP13_SQL, **both_tables(spark, text_dir))
    found = rows_of(dec.op13_decontamination(spark, text_dir))
    assert found == want and 3 < sum(n for r, n in found.items() if r[5]) < sum(found.values())


def test_blocks_of_items_change_nothing(spark, text_dir):
    t = both_tables(spark, text_dir)
    columns = ["row.doc_id", "n_words", "n_hit", F.array_join("items", ",")]
    one = rows_of(dec.overlaps(t["documents"], t["benchmark"]).select(*columns))
    assert rows_of(dec.overlaps(t["documents"], t["benchmark"], block_words=600).select(*columns)) == one


def brute(words, pieces, window):
    hit, found = set(), set()
    for item, w in pieces:
        m = min(window, len(w))
        for k in range(len(w) - m + 1 if w else 0):
            for i in range(len(words) - m + 1):
                if words[i : i + m] == w[k : k + m]:
                    hit.update(range(i, i + m))
                    found.add(item)
    return hit, found


word = st.sampled_from([b"a", b"b", b"c"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(word, max_size=12), max_size=4), st.lists(st.sampled_from([b"a", b"b", b"c", b"z"]), max_size=30), st.integers(1, 5))
def test_automaton_equals_brute_force(texts, words, window):
    pieces = [(f"i{k % 3}", t) for k, t in enumerate(texts)]
    auto = dec.SuffixAutomaton(pieces, window)
    ids = np.array([auto.vocabulary.get(w, -1) for w in words], np.int64)
    spans, names, _ = auto.leaks(ids)
    hit, found = brute(words, pieces, window)
    assert {i for a, b in spans for i in range(a, b + 1)} == hit and set(names) == found


def test_long_item_in_pieces(spark):
    rng = random.Random(5)
    words = [f"w{rng.randint(0, 900)}" for _ in range(3000)]
    item = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    cut = dec.item_pieces(item, piece=100).collect()
    windows = {tuple(words[i : i + 10]) for i in range(2991)}
    found = [bytes(r.words).decode().split(" ") for r in cut]
    assert {tuple(p[i : i + 10]) for p in found for i in range(len(p) - 9)} == windows and len(cut) == 30


def test_removed_spans(spark):
    leak = "the quick brown fox jumps over the lazy dog and then some more words"
    clean = " ".join(f"own{k}" for k in range(40))
    rows = [(1, f"É {clean}: {leak.upper()}! after", "x"), (2, leak + " b", "x"), (3, None, "x"), (4, "", "x"), (5, clean, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    item = spark.createDataFrame([(1, leak)], "item_id long, text string")
    left = {r.doc_id: r.text for r in dec.decontaminate(docs, item).collect()}
    assert left == {1: f"É {clean}: ! after", 3: None, 4: "", 5: clean}
    kept = dec.decontaminate(docs, item, limit=20, coverage=1.0)
    assert kept.columns == docs.columns and {r.doc_id: r.text for r in kept.collect()} == {r[0]: r[1] for r in rows}


def test_plain_words():
    assert plain_words("A-b É3[z_] \x1c0É".encode()) == ["a".encode(), b"b", "É3".encode(), b"z", "0É".encode()]
