"""Language-model scores by deleted interpolation.

A word's probability is a mixture of its share after the word before it, its
share of all words, and an even share:

    P(w | v) = a2 * c(v w) / c(v) + a1 * c(w) / N + a0 / (V + 1)

The weights depend on how often the context v was seen, in buckets of powers
of two, and are learned by expectation-maximisation: one part of the training
texts is deleted from the counts, and its word pairs are the events.

Words and pairs are counted over all training texts. Texts are packed into
blocks of about ``BLOCK`` tokens. A block sends each of its distinct words and
pairs (a 64-bit hash) once, with its own counts, to the shard of the hash; a
shard adds up and sends back what other blocks have, in the same order, so
replies need no hashes. What is shuffled is thus the distinct pairs of each
block, however common a pair is, and no table of counts is broadcast. A task
holds one block, or one shard's hashes; with more shards, take larger blocks.
Two hashes of different pairs meet with a chance of 2^-64.

Defined results: a null text is an empty one: its end token is still scored;
a null id counts as empty text in the fold; repeated rows are texts of their
own and count again; a text of any length stays whole in one block; with no training text the counts are zero and P is
the even share; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martloom.llm.common import fold, named, shuffle_partitions, table
from martloom.session import stage

FOLDS, HELD_OUT, DELETED = 7, 2, 4
BLOCK = 1_000_000  # tokens
END = b" "  # no word holds a blank
SHARD_BLOCKS = 4  # blocks whose counts together are as many as one shard's
ROUNDS = 12
BUCKETS = 48
TRAIN, LEFT_OUT, TEST = 0, 1, 2


def squeeze(values: np.ndarray) -> bytes:
    """Compressed with equal bytes of all numbers side by side."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return zstandard.compress(planes.tobytes(), 1)


def expand(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    mixed = first * np.uint64(0x9E3779B97F4A7C15) ^ (second + (first >> np.uint64(7))) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(32))


class Block:
    """Token numbers of some texts, laid end to end, and what follows from them."""

    def __init__(self, words: np.ndarray, tokens: np.ndarray, lengths: np.ndarray, roles: np.ndarray):
        self.words, self.tokens, self.lengths, self.roles = words, tokens, lengths, roles
        self.end = int(np.searchsorted(words, xxhash.xxh64_intdigest(END)))
        self.role = np.repeat(roles, lengths)
        # A text follows the end of another.
        self.before = np.concatenate(([self.end], tokens[:-1])) if len(tokens) else tokens
        self.pairs, self.at, self.pair = np.unique(
            pair_hash(words[self.before], words[tokens]), return_index=True, return_inverse=True
        )

    def counts(self, which: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Of all training texts, and of the left-out part of them."""
        out = [np.bincount(which[m], minlength=size).astype(np.uint32) for m in (self.role != TEST, self.role == LEFT_OUT)]
        return out[0], out[1]


def pack(texts: list[bytes], roles: list[int]) -> dict:
    numbers: dict[bytes, int] = {END: 0}
    ids, lengths = [], []
    for text in texts:
        words = text.lower().split()
        ids += [numbers.setdefault(w, len(numbers)) for w in words]
        ids.append(0)
        lengths.append(len(words) + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, numbers), np.uint64, len(numbers))
    words, place = np.unique(hashes, return_inverse=True)
    tokens = place[np.array(ids, np.int64)].astype(np.uint32)
    return {
        "words": squeeze(np.diff(words, prepend=np.uint64(0))), "tokens": squeeze(tokens),
        "lengths": squeeze(np.array(lengths, np.uint32)), "roles": squeeze(np.array(roles, np.uint8)),
    }


def unpack(row: dict) -> Block:
    words = np.cumsum(expand(row["words"], np.uint64), dtype=np.uint64)
    return Block(
        words, expand(row["tokens"], np.uint32).astype(np.int64),
        expand(row["lengths"], np.uint32).astype(np.int64), expand(row["roles"], np.uint8),
    )


PACKED = "words binary, tokens binary, lengths binary, roles binary"
REPLY = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("shard", pa.int32()), ("total", pa.binary()),
                   ("left_out", pa.binary()), ("types", pa.int64()), ("sum", pa.int64()), ("left_sum", pa.int64())])


def blocks_of(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """One row per block: ids of its texts, and the packed tokens."""
    remainder = fold(named(key), FOLDS)
    role = F.when(remainder == HELD_OUT, TEST).when(remainder == DELETED, LEFT_OUT).otherwise(TRAIN)
    rows = docs.select(named(key).cast("long").alias("id"), role.alias("role"), F.coalesce(named(text), F.lit("")).alias("text"))

    def gather(batches):
        ids, texts, roles, held = [], [], [], 0

        def block():
            return pa.RecordBatch.from_pylist([{"ids": ids, **pack(texts, roles)}], pa.schema(
                [("ids", pa.list_(pa.int64())), *[(c.split()[0], pa.binary()) for c in PACKED.split(", ")]]))

        for batch in batches:
            for i, r, t in zip(batch.column("id").to_pylist(), batch.column("role").to_pylist(), batch.column("text")):
                raw = t.as_py().encode()
                if held and held + len(raw) > 6 * size:
                    yield block()
                    ids, texts, roles, held = [], [], [], 0
                ids.append(i)
                texts.append(raw)
                roles.append(r)
                held += len(raw) + 6
        if ids:
            yield block()

    return rows.mapInArrow(gather, f"ids array<long>, {PACKED}").withColumn("block", F.monotonically_increasing_id())


def shard_edges(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shards are equal ranges of the hash, so sorted hashes fall into slices."""
    starts = np.array([(s << 64) // shards for s in range(shards)], np.uint64)
    return np.append(np.searchsorted(hashes, starts), len(hashes))


def requests(blocks: DataFrame, shards: int) -> DataFrame:
    kinds = "shard int, block long, kind int, hashes binary, total binary, left_out binary"

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = unpack(row)
                for kind, hashes, which in ((1, block.words, block.tokens), (2, block.pairs, block.pair)):
                    total, left_out = block.counts(which, len(hashes))
                    cut = shard_edges(hashes, shards)
                    out = [
                        (s, row["block"], kind, squeeze(np.diff(hashes[a:b], prepend=np.uint64(0))), squeeze(total[a:b]), squeeze(left_out[a:b]))
                        for s, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if a < b
                    ]
                    types = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out), types)], [c.split()[0] for c in kinds.split(", ")]
                    )

    return blocks.select("block", *[c.split()[0] for c in PACKED.split(", ")]).mapInArrow(ask, kinds)


def totals(asked: DataFrame) -> DataFrame:
    """Replies: per block, kind and shard the counts over all blocks, in the order asked; and sums of each shard."""

    def add(group: pa.Table) -> pa.Table:
        out = []
        for kind in (1, 2):
            rows = [r for r in group.to_pylist() if r["kind"] == kind]
            if not rows:
                continue
            hashes = [np.cumsum(expand(r["hashes"], np.uint64), dtype=np.uint64) for r in rows]
            names, which = np.unique(np.concatenate(hashes), return_inverse=True)
            sums = [np.zeros(len(names), np.uint64) for _ in range(2)]
            for c, held in zip(("total", "left_out"), sums):
                np.add.at(held, which, np.concatenate([expand(r[c], np.uint32) for r in rows]).astype(np.uint64))
            at = 0
            for r, h in zip(rows, hashes):
                mine = which[at : at + len(h)]
                at += len(h)
                out.append({"block": r["block"], "kind": kind, "shard": r["shard"],
                            "total": squeeze(sums[0][mine]), "left_out": squeeze(sums[1][mine])})
            if kind == 1:
                out.append({"types": int((sums[0] > 0).sum()), "sum": int(sums[0].sum()), "left_sum": int(sums[1].sum())})
        return pa.Table.from_pylist(out, REPLY)

    return asked.groupBy("shard").applyInArrow(
        add, "block long, kind int, shard int, total binary, left_out binary, types long, sum long, left_sum long"
    )


COUNTED = [f"{n}_{k}" for k in ("words", "pairs") for n in ("all", "left")]
EVENTS = ["e_pair", "e_context", "e_word", "e_times"]


def counted_blocks(blocks: DataFrame, replies: DataFrame) -> DataFrame:
    """Blocks with the counts of their words and pairs, and the events of their left-out texts."""
    names = [*[c.split()[0] for c in PACKED.split(", ")], *COUNTED, *EVENTS]

    def meet(own: pa.Table, told: pa.Table) -> pa.Table:
        row = own.to_pylist()[0]
        block = unpack(row)
        found = {}
        for kind, name in ((1, "words"), (2, "pairs")):
            parts = sorted((r for r in told.to_pylist() if r["kind"] == kind), key=lambda r: r["shard"])
            for column, label in (("total", "all"), ("left_out", "left")):
                found[f"{label}_{name}"] = np.concatenate([expand(p[column], np.uint64) for p in parts])
        times = block.counts(block.pair, len(block.pairs))[1]
        seen = np.flatnonzero(times)
        at = block.at[seen]
        kept = {name: found[f"all_{name}"] - found[f"left_{name}"] for name in ("words", "pairs")}
        events = [kept["pairs"][seen], kept["words"][block.before[at]], kept["words"][block.tokens[at]], times[seen].astype(np.uint64)]
        more = {**found, **dict(zip(EVENTS, events))}
        return pa.table({"ids": own.column("ids"), **{c: pa.array([row[c] if c in row else squeeze(more[c])], pa.binary()) for c in names}})

    kinds = ", ".join(["ids array<long>", *[f"{c} binary" for c in names]])
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(meet, kinds)


def bucket_of(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(context + 1.0).astype(np.int64), BUCKETS - 1)


def shares(pair: np.ndarray, context: np.ndarray, word: np.ndarray, total: int, types: int) -> np.ndarray:
    """The three estimates of each event, one column each."""
    f2 = pair / np.maximum(context, 1)
    return np.stack([f2, word / max(total, 1), np.full(len(word), 1.0 / (types + 1))], axis=1)


def learn(counted: DataFrame, total: int, types: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights by bucket: expectation over all events on Spark, one row per bucket to the driver, in each round."""
    weights = np.full((BUCKETS, 3), 1 / 3)
    weights[0] = (0.0, 0.5, 0.5)  # an unseen context has no pairs

    for _ in range(rounds):
        def expect(batches, weights=weights):
            gained = np.zeros((BUCKETS, 3))
            for batch in batches:
                for row in batch.to_pylist():
                    pair, context, word, times = [expand(row[c], np.uint64).astype(float) for c in EVENTS]
                    bucket = bucket_of(context)
                    parts = weights[bucket] * shares(pair, context, word, total, types)
                    parts *= (times / parts.sum(axis=1))[:, None]
                    for k in range(3):
                        gained[:, k] += np.bincount(bucket, parts[:, k], BUCKETS)
            yield pa.RecordBatch.from_pydict({"bucket": np.arange(BUCKETS), **{f"g{k}": gained[:, k] for k in range(3)}})

        sums = counted.select(*EVENTS).mapInArrow(expect, "bucket long, g0 double, g1 double, g2 double")
        rows = sums.groupBy("bucket").agg(*[F.sum(f"g{k}").alias(f"g{k}") for k in range(3)]).collect()
        before = weights.copy()
        for row in rows:
            gained = np.array(row[1:])
            if gained.sum() > 0:
                weights[row["bucket"]] = gained / gained.sum()
        if np.abs(weights - before).max() < 1e-4:
            break
    return weights


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text."""
    spark = docs.sparkSession
    blocks = stage(blocks_of(docs, key, text, block), "token-blocks")
    # A shard's counts are one group: their number follows the data, not only the setting.
    shards = max(shuffle_partitions(spark), -(-blocks.count() // SHARD_BLOCKS))
    answers = stage(totals(requests(blocks, shards)), "counts")
    sums = answers.where("types is not null").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("types", "sum", "left_sum")]
    ).first()
    types, total = sums["types"], sums["sum"]
    counted = stage(counted_blocks(blocks, answers.where("block is not null").drop("types", "sum", "left_sum")), "counted-blocks")
    weights = learn(counted, total - sums["left_sum"], types)

    def tell(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = unpack(row)
                words, pairs = expand(row["all_words"], np.uint64), expand(row["all_pairs"], np.uint64)
                base = np.log10((words + 1.0) / (total + types + 1.0))
                context = words[block.before[block.at]].astype(float)
                parts = shares(pairs.astype(float), context, words[block.tokens[block.at]].astype(float), total, types)
                scores = np.log10((weights[bucket_of(context)] * parts).sum(axis=1))
                first = np.cumsum(block.lengths) - block.lengths
                yield pa.RecordBatch.from_pydict({
                    "id": pa.array(row["ids"], pa.int64()), "held_out": block.roles == TEST, "n_tokens": block.lengths,
                    "n_known": np.add.reduceat((words > 0)[block.tokens].astype(np.int64), first),
                    "train_tokens": np.full(len(first), total),
                    "base_score": np.add.reduceat(base[block.tokens], first),
                    "score": np.add.reduceat(scores[block.pair], first),
                })

    needed = ["ids", *[c.split()[0] for c in PACKED.split(", ")], "all_words", "all_pairs"]
    return counted.select(*needed).mapInArrow(
        tell, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def op2_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")
