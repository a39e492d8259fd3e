"""SimHash near-duplicates through an inverted index of byte positions.

A 64-bit fingerprint is eight bytes. Two fingerprints that differ in at most d
bits differ in at most d bytes, so they share at least 8 - d bytes in place. A
posting of one position and its byte would hold a 256th of all fingerprints, so
postings are refined to four positions with their bytes, out of a small family:
any 8 - d positions are covered, each of them, by members of the family that lie
wholly inside. Pairs that meet in a bucket bring the positions they share there;
these are tallied by pair over all buckets. A pair that shares 8 - d bytes or more
reaches a tally of as many, so pairs below that minimum go without being looked
at, and the rest is verified by its bits.

A bucket with more than ``HOT`` fingerprints does not list its pairs. Its
fingerprints hang on hubs instead, which are themselves and every value one bit
away: two values within two bits always have a hub in common, and every two
members of a hub are within two bits. A hub links its members to its least one,
so a large bucket costs 65 rows per fingerprint and loses no connection.

Fingerprints equal each other in groups of any size; they are reduced to one
before the index is made.

The pipeline stage takes the links between fingerprints as they are, by the same
index, tally and hubs. After that it looks for what fingerprints do not see: it also
links texts with a Jaccard similarity of 0.8 or more on their sets of five-word
shingles and misses none. Pairs that fingerprints have connected are not compared again. In one order of all shingles, two such sets have their first common shingle near
the start of both (prefix filter), so only the first fifth of each set is
listed, and texts meet under a shingle only if enough of both sets is left from
there on. The order puts shingles from fuller cells of a table of counts last.
Texts under one shingle are verified with the least of them first; then those not
connected with one member of the largest group a round, for a few rounds; then all
pairs still apart, so no bucket's size decides what stays. Of these a pair is made
only if the parities of both sets, 512 bits each, differ in no more places than
the sets may differ in shingles: a shingle that one set has alone changes one bit.

Defined results: a null text is an empty one; texts without words have
fingerprint zero and are linked like any others; a text of any length is one row
and is read whole, its shingles are counted in blocks; a null id is never a component
id unless the whole component has none; repeated rows are rows of their own;
an empty table gives no rows. In the stage all columns are carried and one row
of each group stays: the one with the least doc_id, then the first read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martloom.llm.common import components, named, output, packed, same, table, unpacked
from martloom.session import scratch_scope, stage

SEED = 42
BYTES = 8
BITS = 2  # that linked fingerprints may differ in
KEY_BYTES = 4
HOT = 48
WORDS = 3  # of a shingle of the query's fingerprint
BLOCK = 1 << 15  # shingles counted at once

SET_WORDS = 5
SIMILAR = (4, 5)  # least Jaccard similarity of a link, as a fraction of whole numbers
ROUNDS = 2  # of one centre per bucket before pairs are made
SKETCH = 8  # longs of a set's parity sketch
CELL_BITS = 18  # of a shingle's hash: its cell in the table of counts


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes, as an unsigned number; zero of none."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        block = hashes[at : at + BLOCK].astype("<u8", copy=False)
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def shingle_hashes(text: str, size: int) -> np.ndarray:
    words = text.encode().lower().split()  # bytes: ASCII letters and blanks only
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    stops = np.cumsum(lengths + 1) - 1
    starts = stops - lengths
    spans = zip(starts[: len(words) - size + 1].tolist(), stops[size - 1 :].tolist())
    return np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], np.uint64)


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(key, fp) with the fingerprint as a signed long."""
    rows = docs.select(named(key).alias("key"), F.coalesce(named(text), F.lit("")).alias("text"))

    def hashed(batches):
        for batch in batches:
            prints = [signed(fingerprint(shingle_hashes(t.as_py(), words))) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(prints, pa.int64())], ["key", "fp"])

    return rows.mapInArrow(hashed, output(rows, ["key"], "fp long"))


def position_choices(bits: int = BITS, size: int = KEY_BYTES) -> list[tuple[int, ...]]:
    """Choices of ``size`` positions such that those inside any ``BYTES - bits`` positions cover all of these."""
    sets = [frozenset(s) for s in combinations(range(BYTES), BYTES - bits)]
    bare = {(s, p) for s in sets for p in s}
    choices = []
    while bare:
        best = max(combinations(range(BYTES), size), key=lambda c: sum((s, p) in bare for s in sets if s.issuperset(c) for p in c))
        choices.append(best)
        bare -= {(s, p) for s in sets if s.issuperset(best) for p in best}
    return choices


def tallied(postings: DataFrame, bucket: list[str], positions: Column) -> DataFrame:
    """(a, fa, b, fb, shared): pairs that meet in any bucket, with the number of positional bytes they were seen to share."""
    side = {n: [*bucket, F.col("id").alias(n), F.col("fp").alias(f"f{n}")] for n in ("a", "b")}
    left, right = postings.select(*side["a"], positions.alias("positions")), postings.select(*side["b"])
    met = left.join(right, bucket).where("a < b")
    pairs = met.groupBy("a", "fa", "b", "fb").agg(F.bit_or("positions").alias("positions"))
    return pairs.select("a", "fa", "b", "fb", F.bit_count("positions").alias("shared"))


def links(nodes: DataFrame, bits: int = BITS, hot: int = HOT) -> DataFrame:
    """Links (a, b), a < b, between nodes (id, print, fp) whose fingerprints of one kind are within ``bits``.

    Together they connect whatever is connected; buckets of at most ``hot``
    nodes give all links whose tally they reach together, nodes of a larger one
    get links to hubs' least nodes. A pair that falls short because it shares a
    larger bucket is among the latter with both its nodes.
    Needs ``bits`` of at most 2.
    """
    if bits > 2:
        raise ValueError("hubs one bit away only join values within two bits")
    nodes = stage(nodes.select("id", "print", "fp"), "prints")
    masks = [signed(sum(255 << (8 * k) for k in c)) for c in position_choices(bits)]
    entries = F.array(*[
        F.struct((F.col("print") * len(masks) + n).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("bytes"))
        for n, m in enumerate(masks)
    ])
    index = nodes.select("id", "fp", F.explode(entries).alias("e")).select("id", "fp", "e.*")
    bucket = ["choice", "bytes"]
    filled = stage(index.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    posted = stage(index.join(filled, bucket), "postings")

    # Nodes of one small bucket meet: at most ``hot`` partners for each.
    held = F.array(*[F.lit(sum(1 << k for k in c)) for c in position_choices(bits)])
    pairs = tallied(posted.where(F.col("n") <= hot), bucket, F.get(held, F.col("choice") % len(masks)))
    enough = pairs.where(F.col("shared") >= BYTES - bits)
    met = enough.where(F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= bits).select("a", "b")

    kind = F.floor(F.col("choice") / len(masks)).cast("int").alias("print")
    crowded = stage(posted.where(F.col("n") > hot).select("id", kind, "fp").distinct(), "crowded")
    least = crowded.groupBy("print", "fp").agg(F.min("id").alias("id"))
    equal = star(crowded, least.withColumnRenamed("id", "least"), ["print", "fp"])
    flips = F.array(F.lit(0).cast("long"), *[F.lit(signed(1 << k)) for k in range(64)])
    hubs = stage(least.select("id", "print", F.explode(flips).alias("flip"), "fp").select(
        "id", "print", F.col("fp").bitwiseXOR(F.col("flip")).alias("hub")
    ), "hubs")
    around = hubs.groupBy("print", "hub").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return met.union(equal).union(star(hubs, around.drop("n"), ["print", "hub"])).distinct()


def star(members: DataFrame, centres: DataFrame, keys: list[str]) -> DataFrame:
    return members.join(centres, keys).where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"))


def print_roots(prints: DataFrame) -> DataFrame:
    """(fp, root) of each distinct ``fp``: fingerprints connected by links within ``BITS`` have one root."""
    # Equal fingerprints are one node, which is its own id.
    nodes = stage(prints.select(F.col("fp").alias("id"), F.lit(0).alias("print"), "fp").distinct(), "distinct-prints")
    roots = components(links(nodes))
    return nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = stage(fingerprints(table(spark, sf_dir, "documents")), "fingerprints")
    groups = prints.groupBy("fp").agg(F.min("key").alias("least")).join(print_roots(prints), "fp")
    ids = groups.groupBy("root").agg(F.min("least").alias("component_id"))
    found = groups.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return prints.join(found, "fp").select(
        F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def word_hashes(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents in ``row`` with ``same``, a hash of the word sequence, and ``fp``, the fingerprint."""
    rows = docs.select(packed(docs), F.coalesce(named(text), F.lit("")).alias("text"))

    def hashed(batches):
        for batch in batches:
            same, prints = [], []
            for t in batch.column("text"):
                same.append(xxhash.xxh3_128_digest(b" ".join(t.as_py().encode().lower().split())))
                prints.append(signed(fingerprint(shingle_hashes(t.as_py(), WORDS))))
            columns = [batch.column("row"), pa.array(same, pa.binary()), pa.array(prints, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "same", "fp"])

    return rows.mapInArrow(hashed, output(rows, ["row"], "same binary, fp long"))


def shingle_set(text: str, size: int = SET_WORDS) -> np.ndarray:
    """Distinct hashes of the shingles; of all words where there are fewer than ``size``."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    known = {w: xxhash.xxh64_intdigest(w, SEED) for w in set(words)}
    base = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - size + 1)
    mixed = np.ones(n, np.uint64)
    for k in range(min(size, len(words))):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + base[k : k + n]
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return np.unique(mixed ^ (mixed >> np.uint64(30)))


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(id, shingles) from (id, text)."""

    def hashed(batches):
        for batch in batches:
            found = [shingle_set(t.as_py()).view(np.int64) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.list_(pa.int64()))], ["id", "shingles"])

    return texts.mapInArrow(hashed, "id long, shingles array<long>")


def parity_sketches(texts: DataFrame) -> DataFrame:
    """(id, parity): for each of 64 * ``SKETCH`` cells whether an odd number of the text's shingles falls into it."""

    def sketched(batches):
        for batch in batches:
            found = []
            for t in batch.column("text"):
                cells = np.bincount((shingle_set(t.as_py()) % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
                found.append(np.packbits(cells.astype(np.uint8)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.list_(pa.int64()))], ["id", "parity"])

    return texts.mapInArrow(sketched, "id long, parity array<long>")


def may_agree(a: str, b: str) -> Column:
    """False only for sets that differ in more shingles than SIMILAR allows: every differing parity is one such shingle at least."""
    part, whole = SIMILAR
    differ = [F.bit_count(F.get(f"{a}.parity", F.lit(k)).bitwiseXOR(F.get(f"{b}.parity", F.lit(k)))) for k in range(SKETCH)]
    total = (F.col(f"{a}.size") + F.col(f"{b}.size")).cast("long")
    return sum(differ[1:], differ[0]) * (part + whole) <= (whole - part) * total


def cell_ranks(texts: DataFrame) -> np.ndarray:
    """Place of each cell of shingle hashes when the emptiest comes first."""

    def counted(batches):
        counts = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            for t in batch.column("text"):
                np.add.at(counts, shingle_set(t.as_py()) >> np.uint64(64 - CELL_BITS), 1)
        cells = np.flatnonzero(counts)
        for at in range(0, len(cells), BLOCK):
            part = cells[at : at + BLOCK]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(counts[part], pa.int64())], ["cell", "n"])

    # At most 2^CELL_BITS rows for any input.
    found = texts.mapInArrow(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << CELL_BITS, np.int64)
    counts[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    ranks = np.empty(1 << CELL_BITS, np.uint32)
    ranks[np.argsort(counts, kind="stable")] = np.arange(1 << CELL_BITS, dtype=np.uint32)
    return ranks


def prefixes(texts: DataFrame) -> DataFrame:
    """(shingle, id, size, rest): the shingles that can be the first common one of a link.

    ``size``: shingles of the text. ``rest``: how many of them stand at this one or behind.
    """
    ranks = cell_ranks(texts)
    part, whole = SIMILAR
    below = np.uint64(64 - CELL_BITS)

    def listed(batches):
        for batch in batches:
            ids, shingles, sizes, rests = [], [], [], []
            for key, t in zip(batch.column("id").to_pylist(), batch.column("text")):
                found = shingle_set(t.as_py())
                # The cell is replaced by its rank, so that hashes stay distinct and sort in the common order.
                found = np.sort((ranks[found >> below].astype(np.uint64) << below) | (found & np.uint64((1 << int(below)) - 1)))
                n = len(found)
                first = n - (part * n + whole - 1) // whole + 1 if n else 0
                ids.append(np.full(first, key, np.int64))
                shingles.append(found[:first].view(np.int64))
                sizes.append(np.full(first, n, np.int32))
                rests.append(np.arange(n, n - first, -1, dtype=np.int32))
            if ids:
                columns = [pa.array(np.concatenate(c)) for c in (shingles, ids, sizes, rests)]
                yield pa.RecordBatch.from_arrays(columns, ["shingle", "id", "size", "rest"])

    return texts.mapInArrow(listed, "shingle long, id long, size int, rest int")


def can_link(a: str, b: str) -> Column:
    """Whether sets whose first common shingle is this one can be SIMILAR: what is left of both holds what they must share."""
    part, whole = SIMILAR
    total = (F.col(f"{a}.size") + F.col(f"{b}.size")).cast("long")
    return F.least(f"{a}.rest", f"{b}.rest") * (part + whole) >= part * total


def verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that are SIMILAR, by their whole sets."""
    with scratch_scope(texts.sparkSession) as keep:
        wanted = stage(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "wanted")
        # Both lists of ids grow with the texts: dealt by id at every size, not broadcast while they are short.
        sets = stage(shingle_sets(texts.join(wanted.hint("merge"), "id", "left_semi")), "shingles")
        both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(
            sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b"
        )
        shared = F.size(F.array_intersect("sa", "sb"))
        part, whole = SIMILAR
        return keep(both.where(whole * shared >= part * (F.size("sa") + F.size("sb") - shared)).select("a", "b"), "verified")


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) that ``roots`` (node, root) does not connect."""
    a, b = (roots.select(F.col("node").alias(n), F.col("root").alias(f"r{n}")) for n in ("a", "b"))
    return pairs.join(a, "a", "left").join(b, "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def groups_of_near_copies(texts: DataFrame, linked: DataFrame | None = None) -> DataFrame:
    """(node, root) of texts (id, text) that are connected by links of SIMILAR or more, or by ``linked`` (node, root)."""
    spark = texts.sparkSession
    if linked is None:
        linked = spark.createDataFrame([], "node long, root long")
    with scratch_scope(spark) as keep:
        listed = stage(prefixes(texts), "prefixes")
        filled = stage(listed.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("shingle"), "buckets")
        posted = keep(listed.join(filled, "shingle"), "postings")
    # First every text with the least one under a shingle.
    centres = stage(posted.groupBy("shingle").agg(F.min(F.struct("id", "size", "rest")).alias("c")).select("shingle", "c.*"), "centres")
    met = posted.alias("p").join(centres.alias("c"), F.col("p.shingle") == F.col("c.shingle"))
    others = met.where("p.id <> c.id")
    stars = others.where(can_link("p", "c")).select(F.col("c.id").alias("a"), F.col("p.id").alias("b"))
    found = verified(texts, stage(apart(stars.distinct(), linked), "star-pairs"))
    found = found.union(linked.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b")))
    roots = stage(components(found), "star-roots")
    # Then what is not connected yet under a shingle, with members of its largest group, one a round: linear in the bucket.
    mixed = unconnected(others.select("p.*"), roots)
    # Only their texts take part from here on.
    texts = stage(texts.join(mixed.select("id").distinct().hint("merge"), "id", "left_semi"), "open-texts")
    for number in range(ROUNDS):
        if mixed.isEmpty():
            break
        turn = F.min(F.struct(F.xxhash64("id", F.lit(number)).alias("turn"), "id", "size", "rest"))
        centres = stage(mixed.where("root = main").groupBy("shingle").agg(turn.alias("c")).select("shingle", "c.*"), "centres")
        met = mixed.where("root <> main").alias("p").join(centres.alias("c"), same("p", "c", ["shingle"]))
        pairs = met.where(can_link("p", "c")).select(F.least("p.id", "c.id").alias("a"), F.greatest("p.id", "c.id").alias("b"))
        more = verified(texts, stage(pairs.distinct(), "star-pairs"))
        if more.isEmpty():
            break
        found = found.union(more)
        roots = stage(components(found), "star-roots")
        mixed = unconnected(mixed.select("shingle", "id", "size", "rest"), roots)
    # Last, all pairs that are still apart. The largest group of a bucket is not paired with itself.
    mixed = stage(mixed.join(stage(parity_sketches(texts), "sketches"), "id"), "sketched")
    left, right = mixed.where("root <> main").alias("l"), mixed.alias("r")
    split = (F.col("l.root") != F.col("r.root")) & ((F.col("r.root") == F.col("r.main")) | (F.col("l.id") < F.col("r.id")))
    pairs = left.join(right, (F.col("l.shingle") == F.col("r.shingle")) & split & can_link("l", "r") & may_agree("l", "r")).select(
        F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b")
    )
    more = verified(texts, stage(pairs.distinct(), "open-pairs"))
    return components(found.union(more))


def unconnected(postings: DataFrame, roots: DataFrame) -> DataFrame:
    """Postings of the buckets with more than one group, with ``root``, their group, and ``main``, the bucket's largest one."""
    with scratch_scope(postings.sparkSession) as keep:
        rooted = stage(
            postings.join(roots, F.col("id") == F.col("node"), "left").select(
                "shingle", "id", "size", "rest", F.coalesce("root", "id").alias("root")
            ),
            "rooted",
        )
        held = stage(rooted.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("n")), "bucket-groups")
        main = held.groupBy("shingle").agg(F.max(F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("groups"))
        main = stage(main.where("groups > 1").select("shingle", F.col("main.root").alias("main")), "mixed-buckets")
        return keep(rooted.join(main, "shingle"), "mixed")


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: one document of each group of exact and near copies."""
    rows = stage(word_hashes(docs).withColumn("id", F.monotonically_increasing_id()), "word-hashes")
    first = F.min(F.struct(F.col("row.doc_id").isNull().alias("none"), F.col("row.doc_id").alias("doc_id"), "id"))
    # One row for each word sequence, then one for each group of those: by fingerprints, and by what the shingles add.
    single = stage(rows.groupBy("same").agg(first.alias("first"), F.min("fp").alias("fp")).select("first.*", "fp"), "single")
    with scratch_scope(spark) as keep:
        rooted = stage(single.join(print_roots(single), "fp").select("id", "root"), "rooted-prints")
        least = rooted.groupBy("root").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
        # The rows of a group hang on its least one; the join is null-safe, so that a large group can be split over tasks.
        linked = keep(rooted.alias("p").join(least.alias("l"), same("p", "l", ["root"])).select(F.col("id").alias("node"), F.col("least").alias("root")), "linked")
    texts = rows.select("id", F.coalesce("row.text", F.lit("")).alias("text"))
    roots = groups_of_near_copies(stage(texts.join(single.select("id").hint("merge"), "id", "left_semi"), "single-texts"), linked)
    grouped = single.join(roots, F.col("id") == F.col("node"), "left")
    kept = grouped.groupBy(F.coalesce("root", "id").alias("g")).agg(F.min(F.struct("none", "doc_id", "id")).alias("m"))
    stay = rows.join(kept.select("m.id").hint("merge"), "id", "left_semi")
    return stay.select(*unpacked(stay, docs.columns))
