"""Byte-level BPE encoding in overlapping chunks, and decoding.

A text is cut into chunks that overlap. Each chunk is split into pre-tokens on
its own, in parallel. The split pattern only looks ahead, so two chunks that
have one boundary in common agree on every boundary behind it: the texts are
stitched at the first boundary of the later chunk's head that is also a sure
boundary in the earlier chunk's tail. Chunks that share none (one endless
pre-token) are joined and split again as one. The pieces between the cuts
are encoded by rank, in parallel, and their ids concatenated in order. Decoding
concatenates the bytes of the ids.

A text of one chunk stays in the task that read it, so only longer texts are
shuffled, and of those a task holds one run of chunks; the ids of one text are
one row.

Defined results: a null text is an empty one and has no ids; equal rows are
rows of their own; an empty table gives no rows. All columns of the documents
are carried, whatever their names. Special tokens are never made: their
strings are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from martloom.llm.common import output, packed, shuffle_partitions, table
from martloom.session import stage

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
CHUNK = 1 << 16  # characters
OVERLAP = 1 << 10
#: The pattern decides a pre-token by at most so many characters behind its start or end.
LOOKAHEAD = 3
KEPT_PIECES = 100_000  # encoded pieces that a worker remembers


class Codec:
    """Ranks of one vocabulary file, with a memory of short pieces."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.words = [b""] * (max(ranks.values()) + 1)
        for word, rank in ranks.items():
            self.words[rank] = word
        self.known: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        ids = np.array(self.encoding.encode_ordinary(piece), "<u4").tobytes()
        if len(piece) <= 64:
            if len(self.known) >= KEPT_PIECES:
                self.known.clear()
            self.known[piece] = ids
        return ids

    def encode(self, pieces: list[str]) -> bytes:
        known = self.known.get
        return b"".join([known(p) or self.piece(p) for p in pieces])

    def decode(self, ids: bytes) -> bytes:
        return b"".join([self.words[i] for i in np.frombuffer(ids, "<u4").tolist()])


@lru_cache(2)
def codec(vocabulary: str) -> Codec:
    return Codec(vocabulary)


@lru_cache(1)
def pattern() -> regex.Pattern:
    return regex.compile(public_tokenizers.PATTERN)


def cut_text(text: str, chunk: int, overlap: int) -> Iterator[tuple[int, str]]:
    """(start, chunk) pairs; each chunk but the last runs ``overlap`` into the next."""
    for start in range(0, max(1, len(text) - overlap), chunk):
        yield start, text[start : start + chunk + overlap]


def edges(start: int, text: str, chunk: int, overlap: int) -> tuple[list[int], list[int]]:
    """Boundaries in the head, and sure boundaries in the tail, as places in the whole text."""
    ends = [m.end() for m in pattern().finditer(text)]
    head = [0, *[e for e in ends if e <= overlap]] if start == 0 else [e for e in ends if e <= overlap]
    tail = [e for e in ends if chunk <= e <= len(text) - LOOKAHEAD]
    return [start + e for e in head], [start + e for e in tail]


def encode(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY,
           chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Documents in ``row`` and their ``ids``: unsigned 32-bit numbers, little-endian."""
    rows = docs.select(packed(docs), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    one_chunk = F.length("text") <= chunk + overlap

    def whole(batches):
        coder, split = codec(vocabulary), pattern().findall
        for batch in batches:
            ids = [coder.encode(split(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(ids, pa.binary())], ["row", "ids"])

    short = rows.where(one_chunk).mapInArrow(whole, output(rows, ["row"], "ids binary"))

    # The id is pinned by writing it.
    long = stage(rows.where(~one_chunk).withColumn("id", F.monotonically_increasing_id()), "long-texts")

    def cut(batches):
        for batch in batches:
            for key, t in zip(batch.column("id").to_pylist(), batch.column("text")):
                for n, (start, part) in enumerate(cut_text(t.as_py(), chunk, overlap)):
                    yield pa.RecordBatch.from_pydict({"id": [key], "n": [n], "start": [start], "part": [part]})

    chunks = long.select("id", "text").mapInArrow(cut, "id long, n long, start long, part string")

    def scan(batches):
        for batch in batches:
            found = [edges(s, p, chunk, overlap) for s, p in zip(*[batch.column(c).to_pylist() for c in ("start", "part")])]
            kind = pa.list_(pa.int64())
            more = [pa.array([f[k] for f in found], kind) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "head", "tail"])

    scanned = stage(
        chunks.repartition(shuffle_partitions(docs.sparkSession), "id", "n").mapInArrow(
            scan, "id long, n long, start long, part string, head array<long>, tail array<long>"
        ),
        "chunks",
    )
    tails = scanned.select("id", (F.col("n") + 1).alias("n"), F.col("tail").alias("before"))
    cuts = scanned.select("id", "n", "head").join(tails, ["id", "n"], "left").select(
        "id", "n", F.when(F.col("n") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("before", "head"))).alias("cut")
    )
    # Chunks of one text, not texts, stand in a window; a chunk without a cut goes on with the run before it.
    order = Window.partitionBy("id").orderBy("n")
    runs = cuts.withColumn("run", F.count("cut").over(order))
    firsts = runs.where("cut is not null").withColumn("stop", F.lead("cut").over(Window.partitionBy("id").orderBy("run")))
    placed = (
        scanned.select("id", "n", "start", "part").join(runs.select("id", "n", "run"), ["id", "n"])
        .join(firsts.select("id", "run", F.col("cut").alias("begin"), "stop"), ["id", "run"])
    )

    def stitch(group: pa.Table) -> pa.Table:
        parts = sorted(zip(*[group.column(c).to_pylist() for c in ("start", "part", "begin", "stop")]))
        joined, at = [], parts[0][0]
        for start, part, _, _ in parts:
            joined.append(part[at - start :])
            at = start + len(part)
        begin, stop, origin = parts[0][2], parts[0][3], parts[0][0]
        text = "".join(joined)[begin - origin :]
        pieces = []
        # Not cut at ``stop`` beforehand: what follows decides how blanks before it are split.
        left = len(text) if stop is None else stop - begin
        for m in pattern().finditer(text):
            if m.start() >= left:
                break
            pieces.append(m.group())
        ids = codec(vocabulary).encode(pieces)
        return pa.table({"id": group.column("id")[:1], "run": group.column("run")[:1], "ids": pa.array([ids], pa.binary())})

    encoded = placed.groupBy("id", "run").applyInArrow(stitch, "id long, run long, ids binary")

    def gather(group: pa.Table) -> pa.Table:
        ids = b"".join(x for _, x in sorted(zip(group.column("run").to_pylist(), group.column("ids").to_pylist())))
        return pa.table({"id": group.column("id")[:1], "ids": pa.array([ids], pa.binary())})

    whole_ids = encoded.groupBy("id").applyInArrow(gather, "id long, ids binary")
    return short.union(long.join(whole_ids, "id").select("row", "ids"))


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Adds ``decoded``, the bytes of the ids."""

    def spell(batches):
        words = codec(vocabulary)
        for batch in batches:
            out = [words.decode(i.as_py()) for i in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])

    return encoded.select("row", "ids").mapInArrow(spell, output(encoded, ["row", "ids"], "decoded binary"))


def digest(docs: DataFrame) -> DataFrame:
    done = decode(encode(docs.select("doc_id", "text")).select(F.struct("row.doc_id").alias("row"), "ids"))
    return done.select(
        F.col("row.doc_id").alias("doc_id"),
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))


def stage_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: token counts and digests of every document that is left."""
    return digest(docs)
