"""Line dedup through names of repeated windows of lines.

Every line with a word gets a number; a document is the sequence of its numbers.
Distributed prefix doubling names all windows of 1, 2, 4, ... lines that occur
twice or more: a window of 2w lines is known by the pair of names of its halves,
and every pair that occurs twice gets a number. Two windows of as many lines are
equal if and only if their names are; the names' order means nothing. A window
whose half occurs once occurs once itself, so each round only keeps what is still
repeated.

A run of lines counts when it has at least ``MIN_WORDS`` words. For each suffix
the shortest such run is a prefix whose length in lines its own content decides;
suffixes that agree in it form one interval of common prefix. The first suffix of
an interval is the original, the runs at all others are later copies; overlapping copies are merged and deleted.
"First" is by doc_id, nulls last, then by input order, then by place in the text.

Runs that start at a line leave the end of a maximal repeated run, where fewer
than ``MIN_WORDS`` words follow, so the shortest run that ends at each line is
looked up by the same names. A line of a maximal run has enough words behind it
or is in the shortest run that ends with it: both together are the maximal
repeated runs, deleted to their very end.

DataFrame operations only. Line numbers are 128 bits of hash of the line.

Defined results: a null text has no lines and stays null; lines without a word
are no part of a run and go with a run only from inside it; a document whose
words are all later copies is left with an empty text, which the pipeline
stage drops; repeated rows are documents of their own, so whole copies of
``MIN_WORDS`` words or more are deleted but for the first; an empty table gives no rows.
A text of any length is read whole, line by line; only its lines' hashes are shuffled.
All columns are carried, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from martloom.llm.common import packed, same, table, word_count
from martloom.session import stage

MIN_WORDS = 50


def line_table(rows: DataFrame, min_words: int) -> DataFrame:
    """(id, seq, line, h1, h2, need, held) of the lines with a word.

    ``need`` is the number of lines of the shortest run of ``min_words`` words
    that starts at the line, null if the text ends before; ``held`` that of the
    shortest run that ends with the line, null if the text begins behind.
    """
    lines = F.filter(
        F.transform(F.split("text", "\n", -1), lambda t, i: F.struct(i.alias("line"), t.alias("t"), word_count(t).alias("words"))),
        lambda s: s["words"] > 0,
    )
    flat = rows.select("id", F.posexplode(lines).alias("seq", "s")).select(
        "id", "seq", F.col("s.line").alias("line"), F.col("s.words").alias("words"),
        F.xxhash64("s.t").alias("h1"), F.xxhash64("s.t", F.lit(1)).alias("h2"),
    )
    text = Window.partitionBy("id")
    at = flat.withColumn("at", F.sum("words").over(text.orderBy("seq")) - F.col("words"))
    # Lines that start less than min_words words behind this one's start.
    within = text.orderBy("at").rangeBetween(Window.currentRow, min_words - 1)
    sized = at.withColumn("count", F.count(F.lit(1)).over(within)).withColumn("all", F.sum("words").over(text))
    need = F.when(F.col("all") - F.col("at") >= min_words, F.col("count")).alias("need")
    # Lines that end less than min_words words before this one's end.
    sized = sized.withColumn("end", F.col("at") + F.col("words"))
    behind = text.orderBy("end").rangeBetween(1 - min_words, Window.currentRow)
    held = F.when(F.col("end") >= min_words, F.count(F.lit(1)).over(behind)).alias("held")
    return sized.select("id", "seq", "line", "h1", "h2", need, held)


def named_windows(windows: DataFrame, pair: list[str]) -> DataFrame:
    """(id, seq, name): windows that occur twice or more, with the number of their pair."""
    repeated = windows.groupBy(*pair).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*pair)
    # Written, so that the numbers hold and the join does not ride on the grouping's exchange.
    numbered = stage(repeated.withColumn("name", F.monotonically_increasing_id()), "repeated-windows")
    return stage(windows.join(numbered, pair).select("id", "seq", "name"), "names")


def suffix_names(lines: DataFrame, longest: int) -> list[DataFrame]:
    """Names of repeated windows of 2^k lines, k = 0, 1, ..., as far as any is repeated or ``longest`` lines."""
    levels = [named_windows(lines.select("id", "seq", "h1", "h2"), ["h1", "h2"])]
    while 2 ** len(levels) <= longest:
        width = 2 ** (len(levels) - 1)
        here = levels[-1]
        ahead = here.select("id", (F.col("seq") - width).alias("seq"), F.col("name").alias("name2"))
        doubled = here.join(ahead, ["id", "seq"]).select("id", "seq", F.col("name").alias("name1"), "name2")
        following = named_windows(doubled, ["name1", "name2"])
        if following.isEmpty():
            break
        levels.append(following)
    return levels


def copied_runs(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, first, last, source, lines): maximal runs of lines that are later copies.

    ``rows``: id, doc_id, text. ``source`` is the document of the original of the run's first part.
    """
    lines = stage(line_table(rows, min_words), "lines")
    starts = lines.where("need is not null").select("id", "seq", F.col("need").alias("m"))
    # A run may be the shortest from both of its ends.
    ends = lines.where("held is not null").select("id", (F.col("seq") - F.col("held") + 1).alias("seq"), F.col("held").alias("m"))
    starts = starts.union(ends).distinct()
    longest = starts.agg(F.max("m")).first()[0] or 0  # at most min_words, every line has a word
    levels = suffix_names(lines, longest)
    # Two windows of 2^k lines, from the front and from the back, cover a run of 2^k to 2^(k+1) - 1 lines.
    names = reduce(DataFrame.union, [n.select("id", "seq", F.lit(k).alias("k"), "name") for k, n in enumerate(levels)])
    wide = reduce(lambda c, k: c.when(F.col("m") < 2 ** (k + 1), k), range(1, len(levels)), F.when(F.col("m") < 2, 0))
    sized = starts.withColumn("k", wide).where("k is not null")
    back = names.select("id", F.col("seq").alias("back"), "k", F.col("name").alias("name2"))
    both = sized.join(names, ["id", "seq", "k"]).withColumn("back", F.expr("int(seq + m - shiftleft(1, k))")).join(back, ["id", "back", "k"])
    both = both.select("id", "seq", "m", F.col("name").alias("name1"), "name2")
    prefixes = stage(both.join(rows.select("id", "doc_id"), "id"), "prefixes")
    interval = ["m", "name1", "name2"]
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id", "seq")
    firsts = prefixes.groupBy(*interval).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # Null-safe, so that the join does not ride on the grouping's exchange and a common interval can be split.
    met = prefixes.alias("p").join(firsts.alias("f"), same("p", "f", interval))
    later = met.select("p.*", "f.first").where(place > F.col("first"))
    spans = later.select("id", "seq", (F.col("seq") + F.col("m") - 1).alias("stop"), "first")
    # Overlapping and touching copies of one text are one run.
    order = Window.partitionBy("id").orderBy("seq")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(reach.isNull() | (F.col("seq") > reach + 1), 1).otherwise(0)
    runs = spans.withColumn("run", begins).withColumn("run", F.sum("run").over(order)).groupBy("id", "run").agg(
        F.min("seq").alias("from"), F.max("stop").alias("to"), F.min(F.struct("seq", "first")).alias("origin")
    )
    line = lines.select("id", "seq", "line")
    return (
        runs.join(line.select("id", F.col("seq").alias("from"), F.col("line").alias("first")), ["id", "from"])
        .join(line.select("id", F.col("seq").alias("to"), F.col("line").alias("last")), ["id", "to"])
        .select("id", "first", "last", F.col("origin.first.doc_id").alias("source"), (F.col("to") - F.col("from") + 1).alias("lines"))
    )


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """Documents in ``row``, with ``text`` after dedup, ``runs`` (deleted line spans), ``n_lines`` and ``left_words``."""
    # The id is pinned by writing it, and gives equal rows their order.
    pinned = stage(docs.select(packed(docs), F.monotonically_increasing_id().alias("id")), "line-documents")
    rows = pinned.select("id", F.col("row").getField(key).alias("doc_id"), F.col("row").getField(text).alias("text"))
    runs = stage(copied_runs(rows, min_words), "copied-runs")
    span = F.struct("first", "last", "source")
    per_text = runs.groupBy("id").agg(F.sort_array(F.collect_list(span)).alias("runs"))
    # The runs grow with the texts: dealt by id at every size, not broadcast while they are few.
    both = pinned.join(per_text.hint("merge"), "id", "left")
    old = F.col("row").getField(text)
    lines = F.split(old, "\n", -1)
    # What is kept lies between the end of one run and the start of the next.
    gaps = F.transform(
        F.sequence(F.lit(0), F.size("runs")),
        lambda i: F.struct(
            F.when(i == 0, F.lit(0)).otherwise(F.get("runs", i - 1)["last"] + 1).alias("start"),
            F.coalesce(F.get("runs", i)["first"], F.size(lines)).alias("stop"),
        ),
    )
    kept = F.flatten(F.transform(gaps, lambda g: F.slice(lines, g["start"] + 1, F.greatest(g["stop"] - g["start"], F.lit(0)))))
    cleaned = F.when(F.col("runs").isNull(), old).otherwise(F.array_join(kept, "\n"))
    return both.select("row", cleaned.alias("text"), "runs", F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, the lines deleted, and the text that is left."""
    done = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    deleted = F.coalesce(F.aggregate("runs", F.lit(0), lambda s, r: s + r["last"] - r["first"] + 1), F.lit(0))
    return done.select(
        F.col("row.doc_id").alias("doc_id"),
        F.when(F.col("row.text").isNull(), 0).otherwise(F.col("n_lines")).cast("long").alias("n_lines"),
        deleted.cast("long").alias("n_deleted"),
        "text",
    )


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: the documents without later copies of runs; those that lost all their words go.

    ``n_chars`` of a changed text is counted anew.
    """
    done = dedup(docs).where(F.col("runs").isNull() | (word_count(F.col("text")) > 0))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("runs").isNotNull(), F.length("text")).otherwise(F.col("row").getField("n_chars")).cast("long")
    parts = [changed[c] if c in changed else F.col("row").getField(c) for c in docs.columns]
    return done.select(*[p.alias(c) for p, c in zip(parts, docs.columns)])


OP10_SQL = r"""
WITH split AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents
), worded AS (
  SELECT doc_id, t, line, row_number() OVER d - 1 AS seq, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS words
  FROM split WHERE regexp_matches(t, '[^\x20\x09-\x0D]') WINDOW d AS (PARTITION BY doc_id ORDER BY line)
), pairs AS (
  SELECT p.doc_id, p.seq, p.words, q.doc_id AS other, p.seq - q.seq AS shift
  FROM worded p JOIN worded q ON p.t = q.t AND (q.doc_id < p.doc_id OR (q.doc_id = p.doc_id AND q.seq < p.seq))
), runs AS (
  SELECT *, seq - row_number() OVER (PARTITION BY doc_id, other, shift ORDER BY seq) AS run FROM pairs
), copies AS (
  SELECT DISTINCT doc_id, min(seq) AS seq, max(seq) AS stop FROM runs GROUP BY doc_id, other, shift, run HAVING sum(words) >= 50
), gone AS (
  SELECT DISTINCT w.doc_id, w.line, w.seq FROM worded w JOIN copies c ON c.doc_id = w.doc_id AND w.seq BETWEEN c.seq AND c.stop
), bare AS (
  SELECT s.doc_id, s.line, s.t, g.line IS NOT NULL
         OR (NOT regexp_matches(s.t, '[^\x20\x09-\x0D]')
             AND coalesce(lag(g.seq IGNORE NULLS) OVER o + 1 = lead(g.seq IGNORE NULLS) OVER o, false)) AS deleted
  FROM split s LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.line = s.line
  WINDOW o AS (PARTITION BY s.doc_id ORDER BY s.line)
)
SELECT d.doc_id, CAST(coalesce(count(b.line), 0) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (b.deleted) AS BIGINT) AS n_deleted,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(string_agg(b.t, chr(10) ORDER BY b.line) FILTER (NOT b.deleted), '') END AS text
FROM documents d LEFT JOIN bare b ON b.doc_id = d.doc_id GROUP BY d.doc_id, d.text
"""
