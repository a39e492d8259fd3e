"""The whole pipeline against brute force, each stage on its own input."""

import hashlib
import random
import struct
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from martloom.llm import bpe, fertility
from martloom.session import stage
from test_llm_groups import brute_kept
from test_llm_similarity import kept_by_brute_force
from test_llm_text import brute_lines

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def texts():
    rng = random.Random(12)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(600)]

    def prose(n, line=11):
        out = [rng.choice(words) for _ in range(n)]
        return "\n".join(" ".join(out[k : k + line]) for k in range(0, n, line))

    found = [prose(rng.randint(5, 400)) for _ in range(70)]
    found += [found[3], found[30], found[30] + "\n" + prose(5), found[31].upper()]  # copies and near copies
    shared = prose(80)
    found += [prose(60) + "\n" + shared + "\n" + prose(50) for _ in range(5)]  # a passage of many documents
    found += [" ".join(f"{w}%&#" for w in prose(100).split()), "again and " * 60, None, "", "☃䷀" * 200 + prose(30)]
    return [(k, t, ["en", "de", "xx"][k % 3 if k % 17 else 2], ["a", "b", "b", "b", None][k % 5], len(t or "")) for k, t in enumerate(found)]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(texts(), COLUMNS).repartition(3).write.parquet(f"{root}/documents.parquet")
    seen = [spark.read.parquet(f"{root}/documents.parquet")]
    for _, step in corpus_pipeline.STAGES:
        seen.append(stage(step(spark, seen[-1], root), "step"))
    return [df.collect() for df in seen], seen


def test_quality_rules(spark, stages):
    (before, after, *_), (frame, *_) = stages
    want = brute_kept(stage(fertility.measured(frame), "measured").collect())
    assert {r.doc_id for r in after} == {d for d, kept in want.items() if kept} and len(after) < len(before)


def test_line_dedup(stages):
    before, after = (sorted(rows, key=lambda r: r.doc_id) for rows in stages[0][1:3])
    left = {r.doc_id: t for r, t in zip(before, brute_lines([r.text for r in before], 50)) if t and t.split()}
    assert {r.doc_id: r.text for r in after} == left
    assert all(r.n_chars == len(r.text) for r in after) and any(left.get(r.doc_id) != r.text for r in before)


def test_near_dedup(stages):
    before, after = (sorted(rows, key=lambda r: r.doc_id) for rows in stages[0][2:4])
    kept = kept_by_brute_force([r.text for r in before])
    assert [r.doc_id for r in after] == [r.doc_id for k, r in enumerate(before) if k in kept]


def test_mixing(stages):
    before, after = stages[0][3:5]
    size = {r.doc_id: len(r.text.split()) for r in before}
    of, copies = defaultdict(int), Counter(r.doc_id for r in after)
    for r in before:
        of[r.source] += size[r.doc_id]
    # Weights 5, 2, 1 by source, null last; shares of 150 %, none above twice its source.
    weight = dict(zip(sorted(of, key=lambda s: (s is None, s)), (5, 2, 1)))
    left, open_, target = 1.5 * sum(of.values()), set(of), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * level > 2 * of[s]]
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in full:
            target[s] = 2 * of[s]
            left -= target[s]
            open_.remove(s)
    for s in of:
        ours = [r for r in before if r.source == s]
        rate = target[s] / of[s]
        assert all(int(rate) <= copies[r.doc_id] <= int(rate) + (rate > int(rate)) for r in ours)
        assert abs(sum(copies[r.doc_id] * size[r.doc_id] for r in ours) - target[s]) <= 2 * max(size[r.doc_id] for r in ours)
    assert set(copies) <= set(size)


def test_encoding(stages):
    before, after = stages[0][4:6]
    plain = bpe.codec(bpe.VOCABULARY).encoding.encode_ordinary
    want = Counter()
    for r in before:
        ids = plain(r.text)
        want[(r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in after) == want
