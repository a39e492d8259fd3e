"""Importance resampling towards the distribution of a target set.

Hashed word features of the documents and of the target set are counted into
arrays of ``BUCKETS`` cells. A cell's gain is the log ratio of its smoothed shares
in both; a text's weight is the mean gain of its features, looked up in that
array. Gumbel noise drawn from the document's id turns the highest scores into a
sample without replacement that favours texts like the target's.

The exact cutoff of the highest scores is found by weighted medians of medians:
every chunk of the rows that remain gives its median, the median of these,
weighted by the sizes of their chunks, has a quarter of all rows at least on
either side, so each round counts the rows up to it and discards a quarter or
more. Rounds work on narrow rows written anew each time, which together are a
few times the first. Only the winners are sorted.

Defined results: a null text is an empty one, without features and of weight 0;
a null id is drawn as an empty id and stands last among ties; rows that tie in
score and id stand by their number of features, and what then ties is alike;
repeated rows are rows of their own; an empty target set, or none of the words
known to it, gives gains from the documents alone; an empty table gives no rows. A
text of any length is one row and is read whole. Other columns are carried,
whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martloom.llm.common import named, output, packed, plain_words, positions, table
from martloom.session import stage

BUCKETS = 10_000
LONGEST = 1  # words of a feature
SEED = 2024
MIN_WORDS = 20
PERCENT = 10  # of the documents with MIN_WORDS words
CHUNK = 1 << 20  # rows with one median
FEW = 64  # keys that are sorted to find the cutoff
KNOWN = 1 << 20  # words whose bucket a worker remembers

#: Best first: lower score, no id, id, features, row.
KEY = ["worse", "none", "ident", "n_features", "rid"]


class Buckets(dict):
    """The bucket of each feature, remembered for a while."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.buckets
        return found

    def of(self, words: list[bytes], longest: int) -> np.ndarray:
        features = words if longest == 1 else [b" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]
        return np.fromiter(map(self.__getitem__, features), np.int64, len(features))


def _bytes(text: str) -> Column:
    return F.coalesce(named(text), F.lit("")).cast("binary").alias("text")


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How often each bucket occurs; one sum per bucket reaches the driver."""

    def count(batches):
        seen, total = Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for t in batch.column("text").to_pylist():
                total += np.bincount(seen.of(plain_words(t), longest), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    parts = docs.select(_bytes(text)).mapInArrow(count, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in parts.groupBy("bucket").agg(F.sum("n")).collect():  # at most ``buckets`` rows
        out[bucket] = n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket floor(1000 ln of target share over raw share), both with one count more in each bucket."""
    s_all, t_all = float(raw.sum() + len(raw)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(raw.tolist(), target.tolist())])


def weighted(docs: DataFrame, gain: np.ndarray, text: str = "text", key: str = "doc_id", longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """Documents in ``row``, with ``doc`` (their id), n_words, n_features, weight and score."""

    def score(batches):
        seen = Buckets(len(gain))
        for batch in batches:
            found = []
            for t, name in zip(batch.column("text").to_pylist(), batch.column("name").to_pylist()):
                words = plain_words(t)
                at = seen.of(words, longest)
                weight = int(gain[at].sum()) // len(at) if len(at) else 0
                h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
                noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
                found.append((len(words), len(at), weight, weight + noise))
            if found:
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc"), *map(pa.array, zip(*found))], names)

    names = ["row", "doc", "n_words", "n_features", "weight", "score"]
    rows = docs.select(packed(docs), named(key).alias("doc"), F.coalesce(named(key).cast("string"), F.lit("")).alias("name"), _bytes(text))
    return rows.mapInArrow(score, output(rows, ["row", "doc"], "n_words long, n_features long, weight long, score long"))


def _up_to(bound, strictly: bool = False) -> Column:
    here = F.struct(*KEY)
    there = F.struct(*[F.lit(bound[c]).alias(c) for c in KEY])
    return here < there if strictly else here <= there


def cutoff(keys: DataFrame, wanted: int, few: int = FEW, chunk: int = CHUNK):
    """The key at place ``wanted`` (from 1) of a staged table of distinct keys, by weighted medians of medians."""

    def medians(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= chunk:
                yield middle(held)
                held, n = [], 0
        if n:
            yield middle(held)

    def middle(held):
        rows = pa.Table.from_batches(held)
        order = pa.compute.sort_indices(rows, sort_keys=[(c, "ascending") for c in KEY])
        at = rows.take(order.slice((len(order) - 1) // 2, 1))
        return at.append_column("weight", pa.array([len(order)])).combine_chunks().to_batches()[0]

    left, size = keys, keys.count()
    while size > few:
        # One row per chunk.
        found = left.mapInArrow(medians, output(left, KEY, "weight long")).orderBy(*KEY).collect()
        passed, pivot = 0, None
        for pivot in found:
            passed += pivot.weight
            if 2 * passed >= size:
                break
        lower = left.where(_up_to(pivot)).count()
        if lower == wanted:
            return pivot
        if lower > wanted:
            left, size = stage(left.where(_up_to(pivot, strictly=True)), "cutoff"), lower - 1
        else:
            left, size, wanted = stage(left.where(~_up_to(pivot)), "cutoff"), size - lower, wanted - lower
    return left.orderBy(*KEY).limit(wanted).collect()[-1]


def drawn(rows: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """Staged rows of ``weighted`` with ``rank``: 1, 2, 3, ... for what is drawn, best first, else null."""
    columns = [c for c in rows.columns if c != "rid"]
    none, kind = F.col("doc").isNull(), rows.schema["doc"].dataType
    ident = F.coalesce(F.col("doc"), F.lit("0").cast(kind))  # an order of ids has no use for nulls
    keyed = rows.withColumns({"worse": -F.col("score"), "none": none, "ident": ident})
    fair = F.col("n_words") >= min_words
    keys = stage(keyed.where(fair).select(*KEY), "keys")
    wanted = keys.count() * percent // 100
    wins = fair & _up_to(cutoff(keys, wanted)) if wanted else F.lit(False)
    ranked = positions(keyed.where(wins), [], KEY, "rank").select(*columns, (F.col("rank") + 1).alias("rank"))
    return ranked.union(keyed.where(~wins).select(*columns, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", buckets: int = BUCKETS,
             longest: int = LONGEST, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """Documents in ``row``, with n_words, n_features, weight, score and rank; those with a rank are the sample."""
    gain = gains(bucket_counts(docs, text, buckets, longest), bucket_counts(target, "text", buckets, longest))
    scored = weighted(docs, gain, text, key, longest, seed).withColumn("rid", F.monotonically_increasing_id())
    # Pinned by writing: the row number is the last part of the key.
    return drawn(stage(scored, "weights"), percent, min_words)


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    target = table(spark, sf_dir, "benchmark")
    gain = gains(bucket_counts(docs), bucket_counts(target))
    narrow = weighted(docs, gain).withColumn("row", F.struct("row.doc_id")).withColumn("rid", F.monotonically_increasing_id())
    found = drawn(stage(narrow, "weights"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_features", "weight", "score", "rank")


OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words
  FROM documents
), items AS (
  SELECT coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words
  FROM benchmark
), found AS (
  SELECT rid, word, count(*) AS n FROM (SELECT rid, unnest(words) AS word FROM docs) GROUP BY rid, word
), wanted AS (
  SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM items) GROUP BY word
), hexed AS (
  SELECT word, hex(encode(word)) AS hx FROM (SELECT word FROM found UNION SELECT word FROM wanted)
), hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, CAST(len(hx) AS BIGINT), 2), lambda i: CAST('0x' || substr(hx, i, 2) AS BIGINT))),
           lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: xor(c >> 1, (c & 1) * 3988292384))),
         4294967295) % 10000 AS bucket
  FROM hexed
), s AS (SELECT bucket, sum(n) AS n FROM found JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS n FROM wanted JOIN hashed USING (word) GROUP BY bucket),
gained AS (
  SELECT s.bucket, CAST(floor(1000 * ln(CAST(coalesce(t.n, 0) + 1 AS DOUBLE) * CAST((SELECT sum(n) FROM s) + 10000 AS DOUBLE)
         / (CAST(s.n + 1 AS DOUBLE) * CAST(coalesce((SELECT sum(n) FROM t), 0) + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM s LEFT JOIN t ON t.bucket = s.bucket
), summed AS (
  SELECT rid, CAST(sum(n * gain) AS BIGINT) AS total FROM found JOIN hashed USING (word) JOIN gained USING (bucket) GROUP BY rid
), weighed AS (
  SELECT d.rid, d.doc_id, CAST(len(d.words) AS BIGINT) AS n_features,
         CASE WHEN len(d.words) = 0 THEN 0 ELSE (total - ((total % len(d.words)) + len(d.words)) % len(d.words)) // len(d.words) END AS weight,
         CAST('0x' || substr(sha256('2024:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM docs d LEFT JOIN summed USING (rid)
), scored AS (
  SELECT *, CAST(weight + floor(-1000 * ln(-ln((CAST(h AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score FROM weighed
), placed AS (
  SELECT *, n_features >= 20 AS fair,
         row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, rid) AS place,
         count(*) FILTER (n_features >= 20) OVER () AS n
  FROM scored
)
SELECT doc_id, n_features, CAST(weight AS BIGINT) AS weight, score, CASE WHEN fair AND place <= 10 * n // 100 THEN place END AS rank FROM placed
"""
