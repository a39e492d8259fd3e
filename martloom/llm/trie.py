"""Prefix trie of conversations in minimal-perfect-hash node tables.

A node is a distinct sequence of first turns. Each conversation becomes its path
of prefix digests: every digest hashes the one before it with the turn, so one
digest names a whole prefix. Conversations that are equal from end to end are
counted as one path. Paths are dealt to shards by a hash of their last digest,
so neither a common first turn nor a common conversation makes a large shard.

A shard enumerates its distinct digests, gives each a slot of a minimal perfect
hash, keeps the digest in its slot and verifies every lookup by it, and scatters
counts into flat numpy arrays. The array of parent slots then carries the counts
up, deepest nodes first. A node that several shards know is added up by its
digest; parent, depth and words must agree, or the job stops. What must count
once, such as a leaf, is given back to the one shard that owns the node and
carried up there in a second accumulation through the same parent slots.

Defined results: turns stand by ``turn``, null first, equal turns by the SHA-256
of role and text; a null role or text is an empty one; repeated rows are turns of
their own; a row without a conversation id belongs to no conversation; a
conversation without turns is a member of the root; an empty table gives no rows.
Other columns are ignored, whatever their names. A path (24 bytes a turn) is one
row, so a conversation may have some ten million turns; texts of any length leave
the first stage as digests. The hash over a node's members runs through them in
order in one task, in pieces; nothing else of a common conversation is in one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martloom.llm.common import named, shuffle_partitions, table, word_count
from martloom.session import stage

ROOT = bytes(16)
SHARD_TURNS = 200_000  # turns of a shard, about
CHUNK_IDS = 4_096  # member ids in one piece of text
EVERY = 20  # conversations with one common beginning
MOST = 4  # a borrowed beginning has fewer turns than this

LOCAL = "shard int, slot int, parent int, depth long, d1 long, d2 long, p1 long, p2 long, words long, n long, first long, ends long"


class SlotTable:
    """Minimal perfect hash of distinct 128-bit keys, an (n, 2) array of uint64.

    On each level a key takes a cell of a table twice as large as what is left;
    keys alone in their cell get the next slots, the others go one level down.
    """

    def __init__(self, keys: np.ndarray):
        self.levels: list[np.ndarray] = []
        left, used = keys, 0
        while len(left):
            cells = self._cell(left, len(self.levels), 2 * len(left) + 1)
            alone = np.bincount(cells, minlength=2 * len(left) + 1) == 1
            self.levels.append(np.where(alone, np.cumsum(alone) - 1 + used, -1))
            used += int(alone.sum())
            left = left[~alone[cells]]
        self.keys = np.empty_like(keys)
        self.keys[self._slots(keys)] = keys

    @staticmethod
    def _cell(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        mixed = (keys[:, 0] ^ np.uint64(level * 0x9E3779B9 + 1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed = (mixed ^ (mixed >> np.uint64(32)) ^ keys[:, 1]) * np.uint64(0xC2B2AE3D27D4EB4F)
        return ((mixed ^ (mixed >> np.uint64(29))) % np.uint64(size)).astype(np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        found = np.full(len(keys), -1, np.int64)
        for level, slots in enumerate(self.levels):
            open_ = np.flatnonzero(found < 0)
            found[open_] = slots[self._cell(keys[open_], level, len(slots))]
        return found

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; a key that is not in the table stops the job."""
        found = self._slots(keys)
        if (found < 0).any() or (self.keys[found] != keys).any():
            raise ValueError("a prefix digest is not in its node table")
        return found


def carry_up(parent: np.ndarray, depth: np.ndarray, *steps) -> None:
    """Apply ``(ufunc, values)`` from every node to its parent's slot, deepest nodes first."""
    order = np.argsort(depth, kind="stable")
    starts = np.searchsorted(depth[order], np.arange(1, depth.max() + 2))
    for d in range(len(starts) - 2, -1, -1):
        nodes = order[starts[d] : starts[d + 1]]
        for add, values in steps:
            add.at(values, parent[nodes], values[nodes])


# ---- conversations to paths ----------------------------------------------


def turn_lists(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): a conversation's turns in order, each as its digest and its words."""
    said_by, said = F.coalesce(named(role), F.lit("")), F.coalesce(named(text), F.lit(""))
    digest = F.sha2(F.concat(F.length(said_by).cast("string"), F.lit(":"), said_by, said), 256)
    rows = conversations.where(named(conv).isNotNull()).select(
        named(conv).cast("long").alias("conv_id"), named(turn).alias("turn"), F.unhex(digest).alias("h"), word_count(said).alias("words")
    )
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "h", "words"))).alias("turns"))


def graft(lists: DataFrame, every: int = EVERY, most: int = MOST) -> DataFrame:
    """Every conversation with its first turns replaced by those of its block's first conversation.

    The number of turns replaced is drawn from the id. A turn that the other
    conversation does not have is left out.
    """
    n = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    home = F.col("conv_id") - F.col("conv_id") % every
    heads = lists.where(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("home"), F.slice("turns", 1, most - 1).alias("head")
    )
    both = lists.select("conv_id", "turns", home.alias("home"), n.alias("h")).join(heads, "home", "left")
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return both.select("conv_id", F.concat(head, own).alias("turns"))


def paths(lists: DataFrame) -> DataFrame:
    """(conv_id, path, words, e1, e2): prefix digests of 16 bytes each, words per turn, the last digest as two longs."""

    def chain(batches):
        for batch in batches:
            found, ends = [], []
            for hashes in batch.column("hashes").to_pylist():
                at, path = ROOT, []
                for h in hashes:
                    at = hashlib.sha256(at + h).digest()[:16]
                    path.append(at)
                found.append(b"".join(path))
                ends.append(np.frombuffer(at, np.int64))
            ends = np.array(ends, np.int64).reshape(-1, 2)
            columns = [batch.column("conv_id"), pa.array(found, pa.binary()), batch.column("words"), pa.array(ends[:, 0]), pa.array(ends[:, 1])]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "path", "words", "e1", "e2"])

    rows = lists.select("conv_id", F.col("turns.h").alias("hashes"), F.col("turns.words").alias("words"))
    return rows.mapInArrow(chain, "conv_id long, path binary, words array<long>, e1 long, e2 long")


# ---- paths to nodes ------------------------------------------------------


def _local_nodes(rows: pa.Table) -> pa.Table:
    """A shard's nodes: slots, parent slots, members and smallest member as far as this shard knows."""
    steps = [np.frombuffer(p, np.uint64).reshape(-1, 2) for p in rows["path"].to_pylist()]
    sizes = np.array([len(s) for s in steps], np.int64)
    root = np.zeros((1, 2), np.uint64)
    keys = np.concatenate([root, *steps])
    words = np.concatenate([[0], *map(np.asarray, rows["words"].to_pylist())]).astype(np.int64)
    firsts = np.cumsum(sizes) - sizes + 1  # where each path begins in keys
    depth = np.concatenate([[0], np.arange(1, len(keys)) - np.repeat(firsts, sizes) + 1])
    above = np.concatenate([root, keys[:-1]])
    above[firsts[sizes > 0]] = 0
    ordered = np.lexsort((keys[:, 1], keys[:, 0]))
    new = np.concatenate([[True], (keys[ordered[1:]] != keys[ordered[:-1]]).any(axis=1)])
    nodes = SlotTable(keys[ordered[new]])
    slot, parent_of = nodes.find(keys), nodes.find(above)
    n = len(nodes.keys)
    parent, level, count = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64)
    parent[slot], level[slot], count[slot] = parent_of, depth, words
    if (parent[slot] != parent_of).any() or (level[slot] != depth).any() or (count[slot] != words).any():
        raise ValueError("two prefixes share a digest")
    last = slot[np.where(sizes > 0, firsts + sizes - 1, 0)]
    ends, first = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
    np.add.at(ends, last, rows["n_ends"].to_numpy())
    np.minimum.at(first, last, rows["conv_id"].to_numpy())
    members = ends.copy()
    carry_up(parent, level, (np.add, members), (np.minimum, first))
    here, above = nodes.keys.view(np.int64), nodes.keys[parent].view(np.int64)
    shard = np.full(n, rows["shard"][0].as_py(), np.int32)
    columns = [shard, np.arange(n, dtype=np.int32), parent.astype(np.int32), level, here[:, 0], here[:, 1], above[:, 0], above[:, 1]]
    return pa.table([pa.array(c) for c in [*columns, count, members, first, ends]], [c.split()[0] for c in LOCAL.split(", ")])


def _carried(rows: pa.Table) -> pa.Table:
    """A shard's share of what counts once per node, added up below each of its nodes."""
    n = rows.num_rows
    at = rows["slot"].to_numpy()

    def by_slot(name: str) -> np.ndarray:
        out = np.empty(n, np.int64)
        out[at] = rows[name].to_numpy()
        return out

    parent, depth, first = by_slot("parent"), by_slot("depth"), by_slot("first")
    own = by_slot("owner") == by_slot("shard")
    saved = np.where(own, (by_slot("n_convs") - 1) * by_slot("words"), 0)
    leaves = (own & (by_slot("n_children") == 0)).astype(np.int64)
    carry_up(parent, depth, (np.add, saved), (np.add, leaves))
    above = pa.array(first[parent], mask=depth == 0)
    return pa.table([pa.array(by_slot("d1")), pa.array(by_slot("d2")), above, pa.array(leaves), pa.array(saved)],
                    ["d1", "d2", "parent_conv_id", "n_leaves", "saved_tokens"])


def prefix_trie(members: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie over staged ``paths``: digest d1, d2 and parent's digest p1, p2,
    conv_id (smallest member), depth, words, n_convs, n_ends (members that end here), n_children,
    parent_conv_id, n_leaves, saved_tokens.
    """
    spark = members.sparkSession
    turns = members.agg(F.sum(F.length("path"))).first()[0] or 0
    shards = max(shuffle_partitions(spark), turns // (16 * shard_turns) + 1)
    # Members with one end are one path, that of the smallest of them.
    ends = members.groupBy("e1", "e2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_ends"))
    shard = F.pmod(F.xxhash64("e1", "e2"), F.lit(shards)).cast("int").alias("shard")
    dealt = members.join(ends.select("conv_id", "n_ends"), "conv_id").select(shard, "conv_id", "path", "words", "n_ends")
    local = stage(dealt.groupBy("shard").applyInArrow(_local_nodes, LOCAL), "local-nodes")
    agree = ["depth", "words", "p1", "p2"]
    known = local.groupBy("d1", "d2").agg(
        F.sum("n").alias("n_convs"), F.min("first").alias("first"), F.sum("ends").alias("n_ends"), F.min("shard").alias("owner"),
        *[F.min(c).alias(c) for c in agree], *[F.max(c).alias(f"max_{c}") for c in agree],
    )
    alike = F.struct(*agree) == F.struct(*[F.col(f"max_{c}") for c in agree])
    depth = F.when(alike, F.col("depth")).otherwise(F.raise_error(F.lit("two prefixes share a digest")).cast("long"))
    known = stage(known.withColumn("depth", depth).drop(*[f"max_{c}" for c in agree]), "nodes")
    children = known.where("depth > 0").groupBy(F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stage(known.join(children, ["d1", "d2"], "left").fillna(0, ["n_children"]), "nodes-with-children")
    told = local.select("shard", "slot", "parent", "depth", "words", "d1", "d2").join(
        nodes.select("d1", "d2", "n_convs", "first", "owner", "n_children"), ["d1", "d2"]
    )
    parts = told.groupBy("shard").applyInArrow(_carried, "d1 long, d2 long, parent_conv_id long, n_leaves long, saved_tokens long")
    below = parts.groupBy("d1", "d2").agg(
        F.max("parent_conv_id").alias("parent_conv_id"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")
    )
    return nodes.drop("owner").withColumnRenamed("first", "conv_id").join(below, ["d1", "d2"])


def ends_digest(members: DataFrame) -> DataFrame:
    """(e1, e2, ends_sha256): the ids that end at a node, ascending and joined by commas, hashed."""

    def pieces(batches):
        key, ids = None, []
        for batch in batches:
            out = []
            for e1, e2, conv in zip(*(batch.column(c).to_pylist() for c in ("e1", "e2", "conv_id"))):
                if ids and (key != (e1, e2) or len(ids) == CHUNK_IDS):
                    out.append((*key, ids[0], ",".join(map(str, ids))))
                    ids = []
                key = (e1, e2)
                ids.append(conv)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["e1", "e2", "first", "ids"])
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*key, ids[0], ",".join(map(str, ids)))], ["e1", "e2", "first", "ids"])

    def hashed(batches):
        key, running = None, None
        names = ["e1", "e2", "ends_sha256"]
        for batch in batches:
            out = []
            for e1, e2, ids in zip(*(batch.column(c).to_pylist() for c in ("e1", "e2", "ids"))):
                if key == (e1, e2):
                    running.update(b"," + ids.encode())
                    continue
                if key:
                    out.append((*key, running.hexdigest()))
                key, running = (e1, e2), hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names)
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*key, running.hexdigest())], names)

    parts = shuffle_partitions(members.sparkSession)
    order = ["e1", "e2", "conv_id"]
    dealt = members.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    chunks = dealt.mapInArrow(pieces, "e1 long, e2 long, first long, ids string")
    gathered = chunks.repartition(parts, "e1", "e2").sortWithinPartitions("e1", "e2", "first")
    return gathered.mapInArrow(hashed, "e1 long, e2 long, ends_sha256 string")


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = turn_lists(table(spark, sf_dir, "conversations"))
    members = stage(paths(graft(stage(lists, "turn-lists"))), "paths")
    nodes = prefix_trie(members)
    ended = ends_digest(members).withColumnsRenamed({"e1": "d1", "e2": "d2"})
    nothing = hashlib.sha256(b"").hexdigest()
    return nodes.join(ended, ["d1", "d2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )


OP11_SQL = r"""
WITH told AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({'r': r, 'x': x} ORDER BY turn NULLS FIRST, sha256(length(r) || ':' || r || x)) AS turns FROM told GROUP BY conv_id
), drawn AS (
  SELECT *, conv_id - conv_id % 20 AS home,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
               lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: xor(c >> 1, (c & 1) * 3988292384))),
             4294967295) % 4 AS h
  FROM own
), rebuilt AS (
  SELECT o.conv_id, list_concat(coalesce(b.turns[1 : o.h], []), o.turns[o.h + 1 :]) AS turns
  FROM drawn o LEFT JOIN own b ON b.conv_id = o.home
), steps AS (
  SELECT conv_id, d, turns[1 : d] AS prefix, turns[1 : d - 1] AS above, d = len(turns) AS is_end,
         CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(turns[d].x, '[^\x20\x09-\x0D]+')) END AS words
  FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT prefix, any_value(above) AS above, min(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256
  FROM steps GROUP BY prefix
), children AS (
  SELECT above, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY above
), below AS (
  SELECT s.conv_id, s.d, s.prefix, n.saved, c.n IS NULL AS leaf
  FROM nodes n JOIN steps s ON s.conv_id = n.conv_id AND s.d <= n.depth LEFT JOIN children c ON c.above = n.prefix
), sums AS (
  SELECT prefix, sum(saved) AS saved_tokens, count(*) FILTER (leaf) AS n_leaves FROM below GROUP BY prefix
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, CASE WHEN n.depth > 0 THEN p.conv_id END AS parent_conv_id, n.n_convs,
       coalesce(c.n, 0) AS n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.prefix = n.prefix LEFT JOIN children c ON c.above = n.prefix LEFT JOIN nodes p ON p.prefix = n.above
"""
