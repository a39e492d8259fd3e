"""Rules, encoding, classifier, language model and line dedup against brute force."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from martloom.llm import bpe, classifier, fertility, interpolation, line_dedup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def key(row):
    return tuple((v is not None, v) for v in row)


def test_base_counts_of_edge_documents(spark, docs):
    rows = fertility.judge(fertility.measured(docs)).collect()
    assert Counter(r.row for r in rows) == Counter(docs.collect())
    for r in rows:
        text = r.row.text or ""
        words = WORDS.findall(text)
        seen, dup = set(), 0
        for line in text.split("\n"):
            if WORDS.search(line):
                dup += line in seen
                seen.add(line)
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        repeated = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated))
        assert r.base_failed == (len(words) < 20 or 100 * len(repeated) > 30 * len(words))
        assert r.kept is not None and not (r.kept and r.base_failed)


def test_windows_that_only_look_alike(monkeypatch):
    words = [b"a", b"b"] * 4 + [b"c"] + [b"a", b"b"] * 4
    want = fertility.repeated_words(words)
    # With every hash equal, windows are told apart by their words.
    monkeypatch.setattr(np, "argsort", lambda a, kind=None, f=np.argsort: f(a * 0, kind=kind))
    assert want == 16 and fertility.repeated_words([b"%d" % k for k in range(30)]) == 0


def test_bands_reject_odd_texts_and_keep_clean_ones(spark, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = fertility.op4_fertility(spark, folder).join(labels, "doc_id").where("not base_failed").collect()
    clean = [r.kept for r in rows if r.quality == 1]
    assert len(clean) > 30 and all(clean)
    rng = random.Random(1)
    prose = [(k, " ".join("".join(rng.choice("aeioulnrst") for _ in range(5)) for _ in range(200)), "en") for k in range(60)]
    odd = [(100, " ".join(w + "%&#" for w in prose[0][1].split()), "en"), (101, prose[1][1] + " ☃䷀" * 90, "en")]
    got = {r.row.doc_id: r.kept for r in fertility.judge(fertility.measured(spark.createDataFrame(prose + odd, "doc_id long, text string, lang string"))).collect()}
    assert not got[100] and not got[101] and all(got[k] for k in range(60))


def test_encoding_equals_the_library(spark, docs):
    plain = bpe.codec(bpe.VOCABULARY).encoding.encode_ordinary
    rng = random.Random(4)
    parts = [" ", "  ", "\n", "\n\n", "a", "bc", "'s", "'ll", "'", "1", "22", "!?", "é", "☃", " x", "\t", "\x1c"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 200))) for _ in range(150)]
    texts += ["a" * 500, " " * 333, "", "\n" * 200 + "x", "'" * 100 + "ll", None, "ab " * 70, "ab " * 70]
    small = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "id long, text string")
    for frame, sizes in ((small, (16, 6)), (small, (7, 7)), (docs, (bpe.CHUNK, bpe.OVERLAP)), (docs, (997, 64))):
        rows = bpe.decode(bpe.encode(frame, chunk=sizes[0], overlap=sizes[1])).collect()
        assert Counter(r.row for r in rows) == Counter(frame.collect())
        for r in rows:
            ids = plain(r.row.text or "")
            assert bytes(r.ids) == struct.pack(f"<{len(ids)}I", *ids)
            assert bytes(r.decoded) == (r.row.text or "").encode()


def test_encoding_query(spark, folder):
    plain = bpe.codec(bpe.VOCABULARY).encoding.encode_ordinary
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in bpe.op5_bpe(spark, folder).collect():
        ids = plain(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_classifier_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    rows = classifier.op8_classifier(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert len(held) > 50 and sum(r.predicted == r.quality for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_classifier_equals_plain_model(spark, folder):
    """Moments, shrinkage and scores against numpy on all labelled rows, densities by solving and determinants."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    rows = classifier.described(docs, ["doc_id"]).collect()
    x = {r.doc_id: np.array(r.x) for r in rows}
    assert all(np.allclose(x[r.doc_id], classifier.statistics(r.text or "")) for r in docs.collect())
    learned = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None and r.doc_id in x and zlib.crc32(str(r.doc_id).encode()) % 5}
    groups = [np.stack([x[d] for d, y in learned.items() if y == k]) for k in (0, 1)]
    n = [len(g) for g in groups]
    own = [np.cov(g.T, bias=True) for g in groups]
    common = (n[0] * own[0] + n[1] * own[1]) / sum(n)

    def density(k, v):
        c = 0.8 * own[k] + 0.2 * common
        c = 0.9 * c + 0.1 * np.diag(np.diag(c)) + 0.05 * np.eye(len(c))
        d = v - groups[k].mean(axis=0)
        return np.log(n[k] / sum(n)) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * d @ np.linalg.solve(c, d)

    got = {r.doc_id: r.score for r in classifier.op8_classifier(spark, folder).collect()}
    for d, v in x.items():
        assert abs(got[d] - 1 / (1 + np.exp(np.clip(density(0, v) - density(1, v), -500, 500)))) < 1e-6


def test_classifier_learns_from_no_held_out_label(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    spark.read.parquet(f"{folder}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    turned.write.parquet(f"{tmp_path}/labels.parquet")
    scores = [{r.doc_id: r.score for r in classifier.op8_classifier(spark, f).collect()} for f in (folder, str(tmp_path))]
    assert all(math.isclose(scores[0][k], scores[1][k], abs_tol=1e-9) for k in scores[0])


def test_classifier_edge_labels(spark, docs):
    rows = classifier.described(docs, ["doc_id", "label"])
    assert rows.count() == docs.count()
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (4, None), (999, 1), (None, 1), (5, 1), (6, 0)], "doc_id long, quality int")
    model = classifier.fit(rows.join(labels, "doc_id"), "quality")
    assert classifier.score(rows, model).where("score between 0 and 1").count() == docs.count()
    for one in (labels.where("quality = 1"), labels.limit(0)):
        got = classifier.score(rows, classifier.fit(rows.join(one, "doc_id"), "quality")).select("score").distinct().collect()
        assert [r.score for r in got] == [1.0 if one.count() else 0.5]


def brute_model(texts, folds):
    """(base, score) by the formulas, with the weights of the same number of rounds."""
    tokens = [t.encode().lower().split() + [None] for t in texts]
    total, left = (Counter(), Counter()), (Counter(), Counter())
    for t, f in zip(tokens, folds):
        for counters, on in ((total, f != 2), (left, f == 4)):
            if on:
                counters[0].update(t)
                counters[1].update(zip([None] + t, t))
    n, v = sum(total[0].values()), len(total[0])
    kept = [total[k] - left[k] for k in (0, 1)]
    kept_n = sum(kept[0].values())
    bucket = lambda c: min(int(math.log2(c + 1)), interpolation.BUCKETS - 1)
    parts = lambda uni, bi, size, a, b: (bi[a, b] / max(uni[a], 1), uni[b] / max(size, 1), 1 / (v + 1))
    weights = {b: (0.0, 0.5, 0.5) if b == 0 else (1 / 3,) * 3 for b in range(interpolation.BUCKETS)}
    for _ in range(interpolation.ROUNDS):
        gained = {b: [0.0] * 3 for b in weights}
        for (a, b), times in left[1].items():
            p = [x * y for x, y in zip(weights[bucket(kept[0][a])], parts(kept[0], kept[1], kept_n, a, b))]
            for k in range(3):
                gained[bucket(kept[0][a])][k] += times * p[k] / sum(p)
        new = {b: tuple(x / sum(g) for x in g) if sum(g) else weights[b] for b, g in gained.items()}
        moved = max(abs(x - y) for b in weights for x, y in zip(weights[b], new[b]))
        weights = new
        if moved < 1e-4:
            break
    out = []
    for t in tokens:
        base = sum(math.log10((total[0][w] + 1) / (n + v + 1)) for w in t)
        score = sum(math.log10(sum(x * y for x, y in zip(weights[bucket(total[0][a])], parts(total[0], total[1], n, a, b)))) for a, b in zip([None] + t, t))
        out.append((len(t), sum(total[0][w] > 0 for w in t), n, base, score))
    return out


@pytest.mark.parametrize("block", [2_000, 1_000_000])
def test_interpolation_equals_brute_force(spark, docs, block):
    rows = sorted(docs.select("doc_id", "text").collect(), key=key)
    folds = [zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 for r in rows]
    want = brute_model([r.text or "" for r in rows], folds)
    got = interpolation.score(docs, block=block).collect()
    shape = lambda i, held, n, known, total, base, score: (i is not None, i or 0, held, n, known, total, round(base, 4), round(score, 4))
    assert sorted(shape(*r) for r in got) == sorted(shape(r.doc_id, f == 2, *w) for r, f, w in zip(rows, folds, want))


def test_interpolation_beats_base_on_held_out_texts(spark):
    held = [r for r in interpolation.op2_interpolation(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def brute_lines(rows, least):
    """Texts left by the definition: a line goes if any window with it, of any length, of ``least`` words came before."""
    seen, out = set(), []
    for text in rows:
        lines = (text or "").split("\n")
        worded = [k for k, line in enumerate(lines) if WORDS.search(line)]
        gone = set()
        for s in range(len(worded)):
            words = 0
            for e in range(s, len(worded)):
                words += len(WORDS.findall(lines[worded[e]]))
                if words >= least:
                    window = tuple(lines[k] for k in worded[s : e + 1])
                    if window in seen:
                        gone.update(range(s, e + 1))
                    seen.add(window)
        drop = {worded[s] for s in gone}
        for s in gone:
            if s + 1 in gone:
                drop.update(range(worded[s], worded[s + 1]))
        out.append(None if text is None else "\n".join(x for k, x in enumerate(lines) if k not in drop))
    return out


@pytest.mark.parametrize("least", [1, 7, 50])
def test_line_dedup_equals_brute_force(spark, least):
    rng = random.Random(least)
    lines = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(25)] + ["", "  \t"]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    texts += [texts[3], texts[3], None, "", "x\n" * 90, "x\n" * 90, "one\n\n\ntwo\r\n"]
    df = spark.createDataFrame([(k, t, "x", "y", "z") for k, t in enumerate(texts)], "doc_id long, text string, id string, seq string, `r.w` string")
    got = {r.row.doc_id: r.text for r in line_dedup.dedup(df, min_words=least).collect()}
    want = brute_lines(texts, least)
    assert [got[k] for k in range(len(texts))] == want


def text_of(words, tag):
    return "\n".join(" ".join(f"{tag}{k}w{i}" for i in range(n)) for k, n in enumerate(words))


@pytest.mark.parametrize("least", [7, 50])
def test_line_dedup_deletes_maximal_runs(spark, least):
    rng = random.Random(least)
    lines = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(25)] + [""]
    base = ["\n".join(rng.choice(lines) for _ in range(40)) for _ in range(12)]
    texts = base + ["\n".join([*t.split("\n")[5 : 5 + rng.randint(5, 30)], "other " * 3, *t.split("\n")[:9]]) for t in base]
    for sizes in ([60, 40], [25, 25, 10], [10, 60, 3, 3], [49], [50, 1]):
        texts += [text_of(sizes, sizes)] * 2 + [text_of(sizes, sizes) + "\nand more"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.row.doc_id: r.text for r in line_dedup.dedup(df, min_words=least).collect()}
    assert [got[k] for k in range(len(texts))] == brute_lines(texts, least)


def test_line_dedup_stage_leaves_no_tails(spark):
    rows = [(2 * n + k, text_of(sizes, n)) for n, sizes in enumerate(([60, 40], [25, 25, 10])) for k in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in line_dedup.stage_line_dedup(spark, df, "").collect()) == [0, 2]


def test_line_dedup_runs_few_jobs(spark):
    """The driver keeps what it knows of each job and broadcast: a round of doubling is two writes, not a ranking."""
    texts = ["\n".join(f"w{i}" for i in range(70))] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sc = spark.sparkContext
    sc.setJobGroup("line-dedup-jobs", "")
    try:
        done = line_dedup.dedup(df)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup("line-dedup-jobs")) < 75
    assert sorted(len(r.text) > 0 for r in done.collect()) == [False, True]


def test_line_dedup_of_edge_documents(spark, docs):
    done = line_dedup.dedup(docs).collect()
    assert Counter(r.row for r in done) == Counter(docs.collect())
    for r in done:
        assert (r.text is None) == (r.row.text is None)
        if r.runs is None:
            assert r.text == r.row.text
    copies = [r for r in done if r.row.text and sum(x.row.text == r.row.text for x in done) > 1 and len(r.row.text.split()) >= 50]
    # Only one of equal texts keeps its words.
    for text in {r.row.text for r in copies}:
        assert sum(bool(r.text.split()) for r in copies if r.row.text == text) == 1
