"""Benchmark decontamination through a generalised suffix automaton.

The normalised words of all test items go into one automaton: its states are the
classes of word runs that end at the same places of the items. A document's words
are streamed through it, and every state reached has the length of the longest
run of item words that ends there. A run of ``WINDOW`` words or more is a leak;
its window state, the class of its last ``WINDOW`` words, names the items that
hold it. An item with fewer words counts as a whole.

The automaton starts anew behind every pair of words that no item has side by
side, so only stretches of known pairs are streamed, the rest is passed over in
numpy. Test items are a stated query set: they are cut into pieces that overlap
by a window less one, dealt to blocks of about ``BLOCK_WORDS`` words, and each
block's automaton is broadcast, never larger than a block, whatever the number of
items. Documents are not shuffled with one block; with more of them they are read
once a block and what was found is joined up by document.

``decontaminate`` removes the spans whose longest match reaches ``limit`` words
and drops documents of which more than ``coverage`` of the words are hit.

Defined results: a null text has no words and is clean; an item without words has
no window; items with one id are one item, a null id is an empty id; repeated rows
are rows of their own; an empty table of items leaves every document clean, an
empty table of documents gives no rows. A text of any length is one row and is read
whole. Other columns are carried, whatever their names.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martloom.llm.common import PLAIN, named, output, packed, plain_words, table, unpacked
from martloom.session import stage

WINDOW = 10
BLOCK_WORDS = 200_000
PIECE_WORDS = 20_000
LIMIT = 10  # words of a match that is cut out
COVERAGE = 0.5  # of a document's words

FOUND = "n_words long, spans array<struct<first:long,last:long>>, items array<string>, longest long"


class SuffixAutomaton:
    """All runs of words of some items, with the items that hold each window."""

    def __init__(self, pieces: list[tuple[str, list[bytes]]], window: int = WINDOW):
        """``pieces``: (item, words); a piece under ``window`` words is a whole item."""
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        coded = [(item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for item, words in pieces if words]
        self.shortest = min([window, *[len(ids) for _, ids in coded]])
        self.base = max(len(self.vocabulary), 1)
        self.go: dict[int, int] = {}  # state * base + word -> state
        self.link, self.length, self._words = [-1], [0], [[]]
        for _, ids in coded:
            at = 0
            for w in ids:
                at = self._extend(at, w)
        self._name_windows(coded)
        pairs = [np.array(ids[:-1], np.int64) * self.base + ids[1:] for _, ids in coded if len(ids) > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)

    def _state(self, length: int, link: int) -> int:
        self.link.append(link)
        self.length.append(length)
        self._words.append([])
        return len(self.link) - 1

    def _put(self, state: int, word: int, target: int) -> None:
        key = state * self.base + word
        if key not in self.go:
            self._words[state].append(word)
        self.go[key] = target

    def _split(self, p: int, word: int, q: int) -> int:
        """The class of the runs of q that p leads to, apart from its longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        part = self._state(self.length[p] + 1, self.link[q])
        for w in self._words[q]:
            self._put(part, w, self.go[q * self.base + w])
        self.link[q] = part
        while p >= 0 and self.go.get(p * self.base + word) == q:
            self.go[p * self.base + word] = part
            p = self.link[p]
        return part

    def _extend(self, last: int, word: int) -> int:
        q = self.go.get(last * self.base + word)
        if q is not None:
            return self._split(last, word, q)
        new = self._state(self.length[last] + 1, 0)
        p = last
        while p >= 0 and p * self.base + word not in self.go:
            self._put(p, word, new)
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, word, self.go[p * self.base + word])
        return new

    def _name_windows(self, coded: list[tuple[str, list[int]]]) -> None:
        """Which items hold each window: per window state, and per state of a whole short item."""
        self.home = [-1] * len(self.link)  # the class of a run's last ``window`` words
        self.short_below = [-1] * len(self.link)  # nearest class along the links with a whole short item
        self.held: dict[int, set[str]] = {}
        self.whole: dict[int, dict[int, set[str]]] = {}
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        for v in order:
            if self.length[v] >= self.window:
                self.home[v] = v if self.length[self.link[v]] < self.window else self.home[self.link[v]]
        for item, ids in coded:
            v = 0
            for w in ids:
                v = self.go[v * self.base + w]
                if self.home[v] >= 0:
                    self.held.setdefault(self.home[v], set()).add(item)
            if len(ids) < self.window:
                # The item's run may be shorter than its state's longest one, never than the link's.
                self.whole.setdefault(v, {}).setdefault(len(ids), set()).add(item)
        for v in order:
            self.short_below[v] = v if v in self.whole else self.short_below[self.link[v]]
        del self._words

    def candidates(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Stretches [start, stop) of known words, each pair of which an item has, long enough for a leak."""
        known = ids >= 0
        joined = known[1:] & known[:-1]
        at = np.flatnonzero(joined)
        if len(at) and len(self.pairs):
            keys = ids[at] * self.base + ids[at + 1]
            place = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
            joined[at] = self.pairs[place] == keys
        else:
            joined[:] = False
        if self.shortest <= 1:
            breaks = np.flatnonzero(~joined) + 1
            edges = np.concatenate([[0], breaks, [len(ids)]])
            return [(int(a), int(b)) for a, b in zip(edges[:-1], edges[1:]) if b > a and known[a]]
        change = np.flatnonzero(np.diff(np.concatenate([[0], joined.view(np.int8), [0]])))
        starts, stops = change[::2], change[1::2] + 1
        long = stops - starts >= self.shortest
        return list(zip(starts[long].tolist(), stops[long].tolist()))

    def stream(self, ids: list[int], offset: int, spans: list[tuple[int, int]], states: set[int], shorts: set[tuple[int, int]]) -> int:
        """Follow the words; adds spans of leaks, window states and (state, length) of short items. Returns the longest match."""
        go, link, length, base, window = self.go, self.link, self.length, self.base, self.window
        v = matched = longest = 0
        for i, w in enumerate(ids, offset):
            to = go.get(v * base + w)
            while to is None and v:
                v = link[v]
                matched = length[v]
                to = go.get(v * base + w)
            v, matched = (0, 0) if to is None else (to, matched + 1)
            longest = max(longest, matched)
            if matched >= window:
                spans.append((i - matched + 1, i))
                states.add(self.home[v])
            u = self.short_below[v] if v else -1
            while u > 0:
                for n in self.whole[u]:
                    if n <= matched:
                        spans.append((i - n + 1, i))
                        shorts.add((u, n))
                u = self.short_below[link[u]]
        return longest

    def leaks(self, ids: np.ndarray) -> tuple[list[tuple[int, int]], list[str], int]:
        """(merged spans of words, item ids, longest match) of a document's coded words."""
        spans: list[tuple[int, int]] = []
        states: set[int] = set()
        shorts: set[tuple[int, int]] = set()
        longest = 0
        for start, stop in self.candidates(ids):
            longest = max(longest, self.stream(ids[start:stop].tolist(), start, spans, states, shorts))
        items = set().union(*[self.held[s] for s in states], *[self.whole[u][n] for u, n in shorts])
        return merged(spans), sorted(items), longest


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def item_pieces(items: DataFrame, text: str = "text", key: str = "item_id", window: int = WINDOW, piece: int = PIECE_WORDS) -> DataFrame:
    """(item, words, n_words): the items' words, joined by blanks; long items in overlapping pieces."""

    def cut(batches):
        for batch in batches:
            out = []
            for item, t in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                words = plain_words(t)
                for at in range(0, max(len(words) - window + 1, min(len(words), 1)), piece):
                    part = words[at : at + piece + window - 1]
                    out.append((item, b" ".join(part), len(part)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["item", "words", "n_words"])

    rows = items.select(F.coalesce(named(key).cast("string"), F.lit("")).alias("item"), F.coalesce(named(text), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(cut, "item string, words binary, n_words long")


def automata(items: DataFrame, text: str = "text", key: str = "item_id", window: int = WINDOW, block_words: int = BLOCK_WORDS):
    """One automaton per block of items, from pieces that are fetched block by block."""
    pieces = stage(item_pieces(items, text, key, window), "item-pieces")
    total = pieces.agg(F.sum("n_words")).first()[0] or 0
    blocks = total // block_words + 1
    block = F.pmod(F.xxhash64("item", "words"), F.lit(blocks))
    for b in range(blocks):
        held = pieces.where(block == b).select("item", "words").distinct().collect()  # about ``block_words`` words
        yield SuffixAutomaton([(r.item, bytes(r.words).split(b" ")) for r in sorted(held)], window)


def _scan(rows: DataFrame, automaton: SuffixAutomaton) -> DataFrame:
    """``rows`` (row, text) without the text, with FOUND."""
    shared = rows.sparkSession.sparkContext.broadcast(automaton)
    names = ["row", *[c.split()[0] for c in ("n_words", "spans", "items", "longest")]]
    span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def scan(batches):
        auto = shared.value
        code = auto.vocabulary.get
        for batch in batches:
            found = []
            for t in batch.column("text").to_pylist():
                words = plain_words(t)
                ids = np.fromiter((code(w, -1) for w in words), np.int64, len(words))
                spans, items, longest = auto.leaks(ids)
                found.append((len(words), [{"first": a, "last": b} for a, b in spans], items, longest))
            if found:
                n, spans, items, longest = zip(*found)
                columns = [pa.array(n), pa.array(spans, span), pa.array(items, pa.list_(pa.string())), pa.array(longest)]
                yield pa.RecordBatch.from_arrays([batch.column("row"), *columns], names)

    return rows.mapInArrow(scan, output(rows, ["row"], FOUND))


def overlaps(docs: DataFrame, items: DataFrame, text: str = "text", keep: list[str] | None = None, item_text: str = "text",
             item_key: str = "item_id", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Documents (columns ``keep``, or all) in ``row``, with n_words, spans of leaked words, items, the longest match, and n_hit."""
    rows = docs.select(packed(docs.select(*[named(c) for c in keep]) if keep else docs), F.coalesce(named(text), F.lit("")).cast("binary").alias("text"))
    found = list(automata(items, item_text, item_key, window, block_words))
    if len(found) == 1:
        return _scan(rows, found[0]).withColumn("n_hit", _covered(F.col("spans")))
    # The row's number is pinned by writing it.
    numbered = stage(rows.select(F.struct(F.monotonically_increasing_id().alias("rid"), "row").alias("row"), "text"), "numbered")
    parts = [_scan(numbered.select(F.struct("row.rid").alias("row"), "text"), a) for a in found]
    both = reduce(DataFrame.union, [p.select("row.rid", "n_words", "spans", "items", "longest").where("longest > 0") for p in parts])
    joined = both.groupBy("rid").agg(
        F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("longest").alias("longest"),
    )
    counted = _scan(numbered, SuffixAutomaton([], window)).select("row.rid", "row.row", "n_words")
    empty = F.lit([]).cast
    return counted.join(joined, "rid", "left").select(
        "row", "n_words", F.coalesce("spans", empty("array<struct<first:long,last:long>>")).alias("spans"),
        F.coalesce("items", empty("array<string>")).alias("items"), F.coalesce("longest", F.lit(0)).alias("longest"),
    ).withColumn("n_hit", _covered(F.col("spans")))


def _covered(spans: Column) -> Column:
    """Words in the union of spans sorted by their first word."""
    start = F.struct(F.lit(-1).cast("long").alias("reach"), F.lit(0).cast("long").alias("n"))

    def add(seen, s):
        new = F.greatest(s["last"] - F.greatest(s["first"] - 1, seen["reach"]), F.lit(0).cast("long"))
        return F.struct(F.greatest(seen["reach"], s["last"]).alias("reach"), (seen["n"] + new).alias("n"))

    return F.aggregate(spans, start, add, lambda seen: seen["n"])


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", limit: int = LIMIT, coverage: float = COVERAGE,
                  window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents of which at most ``coverage`` of the words are hit, without their spans of ``limit`` words or more."""
    found = overlaps(docs, items, text, window=window, block_words=block_words)
    fair = found.where(F.col("n_hit") <= F.col("n_words") * F.lit(float(coverage)))
    rows = fair.select("row", F.col("row").getField(text).alias("text"), F.filter("spans", lambda s: s["last"] - s["first"] + 1 >= limit).alias("spans"))
    kind = rows.schema["text"]

    def cut(batches):
        for batch in batches:
            texts = [without(t, s) if s else t for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    cleaned = rows.mapInArrow(cut, output(rows.select("row"), ["row"], "text string"))
    parts = [F.col("text").cast(kind.dataType).alias(c) if c == text else p for c, p in zip(docs.columns, unpacked(cleaned, docs.columns))]
    return cleaned.select(*parts)


def without(text: str, spans: list[dict]) -> str:
    """The text without the spans, each from its first word's begin to its last word's end."""
    raw = text.encode()
    words = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(PLAIN))]
    out, at = [], 0
    for s in spans:
        out.append(raw[at : words[s["first"]][0]])
        at = words[s["last"]][1]
    return b"".join([*out, raw[at:]]).decode()


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlaps(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[i : i + 9], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT m FROM windows),
seen AS (
  SELECT rid, i, m, array_to_string(w[i : i + m - 1], ' ') AS win
  FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM docs JOIN lengths ON len(w) >= m)
), hits AS (
  SELECT rid, i, m, item FROM seen JOIN windows USING (m, win)
), hit_words AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT rid, i, m FROM hits)) GROUP BY rid
), hit_items AS (
  SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(x.n, 0) AS n_items,
       sha256(coalesce(x.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words h USING (rid) LEFT JOIN hit_items x USING (rid)
"""
