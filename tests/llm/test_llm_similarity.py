"""SimHash and nearest neighbours against brute force."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from martloom.llm import neighbours, simhash


def brute_fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(prints, bits=2):
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(parent, 2):
        if (a ^ b).bit_count() <= bits:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {p: root(p) for p in parent}


def test_query_on_edge_documents(spark, docs, edge_dir):
    got = simhash.op6_simhash(spark, edge_dir).collect()
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.select("doc_id", "text").collect() if len(r.text or "") < 50_000]
    long = {r.doc_id for r in docs.select("doc_id", "text").collect() if len(r.text or "") >= 50_000}
    assert len(got) == docs.count()
    known = {r.fingerprint for r in got}
    group = roots({int(p, 16) for p in known})
    least = {}
    for r in got:
        g = group[int(r.fingerprint, 16)]
        if r.doc_id is not None:
            least[g] = min(least.get(g, r.doc_id), r.doc_id)
    assert all(r.component_id == least.get(group[int(r.fingerprint, 16)]) for r in got)
    mine = Counter((r.doc_id, r.fingerprint) for r in got if r.doc_id not in long)
    assert mine == Counter((i, f"{p:016x}") for i, p in rows)


@pytest.mark.parametrize("hot", [2, 5, 1000])
def test_links_connect_what_brute_force_connects(spark, hot):
    rng = random.Random(hot)
    prints = set()
    for _ in range(12):
        value = rng.getrandbits(64)
        for _ in range(25):  # chains and clouds of a few bits
            prints.add(value)
            for _ in range(rng.randint(0, 3)):
                value ^= 1 << rng.randrange(64)
    prints |= {0, (1 << 64) - 1, 1 << 63, 3}
    nodes = [(k, p % 2, simhash.signed(p)) for k, p in enumerate(sorted(prints))]
    nodes += [(1000 + k, kind, fp) for k, kind, fp in nodes[:40]]  # equal fingerprints
    found = simhash.links(spark.createDataFrame(nodes, "id long, print int, fp long"), hot=hot).collect()
    by = {i: (kind, fp) for i, kind, fp in nodes}
    for a, b in found:
        assert a < b and by[a][0] == by[b][0] and ((by[a][1] ^ by[b][1]) & ((1 << 64) - 1)).bit_count() <= 2
    parent = {i: i for i in by}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    want = dict(parent)
    for a, b in found:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    mine = {i: root(i) for i in by}
    parent = want
    for a, b in itertools.combinations(by, 2):
        if by[a][0] == by[b][0] and ((by[a][1] ^ by[b][1]) & ((1 << 64) - 1)).bit_count() <= 2:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    assert mine == {i: root(i) for i in by}


def test_position_choices_miss_no_pair():
    for bits, size in ((0, 8), (1, 4), (2, 4), (2, 3)):
        choices = simhash.position_choices(bits, size)
        for gone in itertools.combinations(range(8), bits):
            # Every position that is left is in a choice of positions that are all left.
            assert set().union(*[c for c in choices if not set(c) & set(gone)]) == set(range(8)) - set(gone)


def test_tally_counts_shared_bytes_and_drops_the_rest(spark):
    rng = random.Random(4)
    base = rng.getrandbits(64)
    prints = {base}
    for _ in range(300):  # single bits, whole bytes, several bytes
        value = base
        for _ in range(rng.randint(1, 5)):
            value ^= rng.choice([1, 3, 255, 129]) << (8 * rng.randrange(8))
        prints.add(value)
    prints = sorted(map(simhash.signed, prints))
    masks = simhash.position_choices()
    rows = [(p, p, n, p & simhash.signed(sum(255 << (8 * k) for k in c)), sum(1 << k for k in c)) for p in prints for n, c in enumerate(masks)]
    postings = spark.createDataFrame(rows, "id long, fp long, choice int, bytes long, held int")
    found = {(r.a, r.b): r.shared for r in simhash.tallied(postings, ["choice", "bytes"], F.col("held")).collect()}
    dropped = 0
    for a, b in itertools.combinations(prints, 2):
        same = [k for k in range(8) if not ((a ^ b) >> (8 * k)) & 255]
        seen = set().union(*[set(c) for c in masks if set(c) <= set(same)])
        assert found.get((a, b), 0) == len(seen) and (len(same) < 6 or len(seen) == len(same))
        dropped += 0 < len(seen) < 6
        assert len(seen) >= 6 or ((a ^ b) & ((1 << 64) - 1)).bit_count() > 2
    assert dropped > 100


def test_near_dedup_stage(spark, docs):
    rows = docs.collect()
    kept = simhash.stage_near_dedup(spark, docs, "").collect()
    assert kept and not Counter(kept) - Counter(rows)
    sets = {}
    for r in rows:
        words = (r.text or "").lower().split()
        sets[r] = frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()
    groups = defaultdict(list)
    for r, s in sets.items():
        groups[s].append(r)
    # Exact copies: one row stays of each word sequence, the least doc_id.
    for s, members in groups.items():
        assert sum(r in set(kept) for r in members) <= 1
    assert sum(r.doc_id is not None and 71 <= r.doc_id < 77 for r in kept) == 1  # the planted near copies
    # Clean rows stay: those unlike any other.
    for r, s in sets.items():
        alike = [x for t, x in sets.items() if t is not r and len(s & x) >= 0.7 * len(s | x)]
        if s and not alike:
            assert r in set(kept)


def kept_by_brute_force(texts):
    """Least text of each component of Jaccard similarity 0.8 or more on five-word shingles."""
    sets = []
    for t in texts:
        words = t.lower().split()
        sets.append(frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))))
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {k for k in parent if root(k) == k}


def stage_keeps(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id for r in simhash.stage_near_dedup(spark, df, "").collect()}


def test_near_dedup_finds_every_passage_edit(spark):
    rng = random.Random(4)
    prose = lambda n: [f"w{rng.randrange(900)}" for _ in range(n)]
    texts = []
    for n in (100, 260, 800):
        for share in (0.05, 0.08, 0.1, 0.15, 0.2, 0.24, 0.26):  # Jaccard of about 0.95 to 0.8 and just below
            base, more = prose(n), prose(int(n * share))
            at = rng.randrange(n - len(more))
            texts += [" ".join(base), " ".join(base + more)]
            base = prose(n)
            texts += [" ".join(base), " ".join(base[:at] + more[: len(more) // 2] + base[at + len(more) // 2 :])]
    texts += ["a", "a b", "A  b", "", "one two three four five"]
    kept = kept_by_brute_force(texts)
    assert len(kept) < len(texts) - 30
    assert stage_keeps(spark, texts) == kept


def test_parity_sketches_let_no_link_go(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(300)}" for _ in range(200)]
    texts = ["", "a"]
    for _ in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 12)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(50)}"
        texts.append(" ".join(words[: rng.randint(120, 200)]))
    rows = simhash.parity_sketches(spark.createDataFrame(list(enumerate(texts)), "id long, text string"))
    sized = rows.join(simhash.shingle_sets(spark.createDataFrame(list(enumerate(texts)), "id long, text string")), "id").withColumn("size", F.size("shingles"))
    found = sized.alias("l").join(sized.alias("r"), F.col("l.id") < F.col("r.id")).select(
        simhash.may_agree("l", "r").alias("may"), F.size(F.array_intersect("l.shingles", "r.shingles")).alias("both"),
        (F.col("l.size") + F.col("r.size")).alias("sizes"),
    ).collect()
    similar = [r.may for r in found if r.sizes and 5 * r.both >= 4 * (r.sizes - r.both)]
    assert len(similar) > 50 and all(similar) and sum(not r.may for r in found) > 500


def test_near_dedup_of_one_vocabulary_in_other_orders(spark):
    """Pairs alike to each other and not to the least text of their many shared shingles."""
    rng = random.Random(6)
    words = [f"v{k}" for k in range(60)]
    texts, common = [], [f"c{k}" for k in range(12)]
    for _ in range(40):
        order = rng.sample(words, 60) + common
        texts += [" ".join(order), " ".join(order + ["end"])]
    rng.shuffle(texts)
    kept = kept_by_brute_force(texts)
    assert len(kept) == 40
    assert stage_keeps(spark, texts) == kept


def test_near_dedup_keeps_no_pair_far_apart_in_words(spark):
    """Appended passages of new words at exactly 0.8 and one shingle below."""
    texts = []
    for n in range(104, 404, 20):  # n - 4 shingles, of which the longer text has a quarter more
        base = [f"t{n}w{k}" for k in range(n)]
        more = (n - 4) // 4
        texts += [" ".join(base), " ".join(base + [f"t{n}x{k}" for k in range(more)])]
        texts.append(" ".join([f"u{n}w{k}" for k in range(n)]))
        texts.append(" ".join([f"u{n}w{k}" for k in range(n)] + [f"u{n}x{k}" for k in range(more + 1)]))
    kept = kept_by_brute_force(texts)
    assert len(kept) == len(texts) * 3 // 4
    assert stage_keeps(spark, texts) == kept


def brute_nearest(ids, x, top=20):
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        score = (x * x[q]).sum(axis=1)
        order = [k for k in np.lexsort((ids, -score)) if ids[k] != ids[q]]
        out[ids[q]] = [(int(ids[k]), float(score[k])) for k in order[:top]]
    return out


@pytest.mark.parametrize("cell, block", [(4096, 8192), (60, 40)])
def test_neighbours_recall_and_scores(spark, folder, monkeypatch, cell, block):
    monkeypatch.setattr(neighbours, "CELL", cell)
    monkeypatch.setattr(neighbours, "BLOCK", block)
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = table.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    want = brute_nearest(ids, x)
    got = defaultdict(list)
    for r in neighbours.nearest(table).collect():
        got[r.query_id].append((r["rank"], r.id, r.score))
    assert set(got) == set(want)
    hit = 0
    for q, found in got.items():
        found = sorted(found)
        assert [f[0] for f in found] == list(range(1, 21)) and [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found)
        exact = dict(brute_nearest(ids, x, len(ids))[q]) if q == min(got) else None
        assert exact is None or all(abs(exact[f[1]] - f[2]) < 1e-12 for f in found)
        hit += len({f[1] for f in found} & {k for k, _ in want[q]})
    assert hit >= 0.95 * 20 * len(want)


@pytest.mark.parametrize("top", [5, 20, 100])
def test_block_search_ends_at_the_top_asked_for(top):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((60, 16)) * 4
    x = np.concatenate([c + 0.3 * rng.standard_normal((100, 16)) for c in centres])
    space = neighbours.Projection(16, float(np.linalg.norm(x, axis=1).max()))
    q = x[::150]
    k = top + 1 + neighbours.SPARE
    rows, _ = neighbours.search_block(space, x, q, np.full(len(q), np.inf), k)
    want = np.argsort(-(q @ x.T), axis=1)[:, : top + 1]
    assert sum(len(set(a) & set(b)) for a, b in zip(rows, want)) >= 0.99 * want.size


def test_neighbours_of_edge_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((90, 4)) * rng.uniform(0.1, 10, (90, 1))
    rows = [(k, v.tolist(), "x") for k, v in enumerate(base)]
    rows += [(200 + k, base[7].tolist(), "x") for k in range(50)]  # one common vector, three queries among it
    rows += [(3, base[3].tolist(), "x"), (3, base[3].tolist(), "x")]  # repeated rows
    bad = [None, [0.0] * 4, [1.0, None, 0.0, 0.0], [float("nan"), 1.0, 1.0, 1.0], [float("inf"), 0.0, 0.0, 0.0], [1.0, 2.0], []]
    rows += [(400 + 20 * k, v, "x") for k, v in enumerate(bad)] + [(None, [1.0, 1.0, 1.0, 1.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, ids string").repartition(5)
    good = {k: v for k, v, _ in rows if k is not None and k < 400}
    ids, x = np.array(sorted(good)), np.array([good[k] for k in sorted(good)])
    want = brute_nearest(ids, x)
    got = defaultdict(list)
    for r in neighbours.nearest(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.id)
    assert set(got) == set(want)
    for q in want:
        assert got[q] == [k for k, _ in want[q]]
    few = neighbours.nearest(df.where("vec_id in (0, 1, 2, 440)")).collect()
    assert sorted((r.query_id, r.id) for r in few) == [(0, 1), (0, 2)]


def test_near_dedup_takes_the_links_between_fingerprints(spark):
    """Texts within two bits of each other are near copies, also where their five-word sets are less alike than 0.8."""
    rng = random.Random(8)
    prose = lambda n: [f"w{rng.randrange(900)}" for _ in range(n)]
    bits = lambda t: simhash.fingerprint(simhash.shingle_hashes(t, simhash.WORDS))
    texts, pairs = [" ".join(prose(80)) for _ in range(20)], 0
    while pairs < 3:
        words = prose(200)
        other = list(words)
        for k in rng.sample(range(5, 195), 6):
            other[k] = "changed"
        a, b = " ".join(words), " ".join(other)
        if (bits(a) ^ bits(b)).bit_count() <= 2 and len(kept_by_brute_force([a, b])) == 2:
            texts += [a, b]
            pairs += 1
    assert stage_keeps(spark, texts) == set(range(20)) | {20, 22, 24}
