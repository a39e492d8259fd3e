"""Quality rules from tokeniser fertility.

Public vocabularies measure each text: characters per token and the entropy of
its tokens under a byte-level vocabulary for many languages, and the share of
characters that a vocabulary with byte fallback would spell as bytes. Bands
for these come from quartiles over all texts, those of the text's script and
those of its language; short texts, which scatter more, have wider ones. A text
outside a band is rejected, as is one that fails the base rules (too short, too
much repetition).

A group's quartiles are drawn towards those of the next larger one as by
``PRIOR`` texts of it: script towards all texts, language towards script. A
large language has its own band, a rare or mistyped one all but its script's,
and no number of texts switches a band on or off.

Defined results: a null text has no words and fails the base rules; a null
``lang`` is a language, and a text's script is the one most of its letters are
of; where no text passes the base rules, only the fixed byte band holds; equal rows get
equal verdicts; an empty table gives no rows. A text of any length is one row
and is read whole. Other columns are carried, whatever their names.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martloom.llm.common import named, output, packed, table, unpacked
from martloom.session import stage

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WINDOW = 8  # words
MIN_WORDS = 20
MAX_REPEATED = 30  # per cent of words
WIDTH = 4.0  # quartile distances beyond the quartiles
SHORT = 64.0  # tokens at which a band is twice as wide
MAX_BYTES = 0.1  # share of characters spelled as bytes
PRIOR = 30.0  # texts
# First code points of stretches of letters; what lies between is no letter of a script told apart here.
SCRIPTS = {"latin": (0x41, 0x250), "greek": (0x370, 0x400), "cyrillic": (0x400, 0x530), "hebrew": (0x590, 0x600), "arabic": (0x600, 0x780),
           "indic": (0x900, 0xE00), "thai": (0xE00, 0xE80), "kana": (0x3040, 0x3100), "han": (0x3400, 0xA000), "hangul": (0xAC00, 0xD7B0)}
NAMES = ["none", *[n for name in SCRIPTS for n in (name, "none")]]
EDGES = np.array([edge for span in SCRIPTS.values() for edge in span], np.uint32)
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
MEASURES = "n_tokens long, chars_per_token double, entropy double, byte_share double, script string"


def script_of(text: str) -> str:
    """The script of most letters; blanks, digits and marks have none. Ties go to the first in the list."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    # Adjoining stretches have an empty one between them; marks between the letters of ASCII are taken for Latin.
    at = np.bincount(np.searchsorted(EDGES, codes, side="right"), minlength=len(NAMES))[1::2]
    return list(SCRIPTS)[int(at.argmax())] if at.any() else "none"


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words inside windows of ``size`` words that occur twice or more."""
    n = len(words)
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    if n <= size or len(numbers) == n:
        return 0
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    windows = n - size + 1
    hashed = np.zeros(windows, np.uint64)
    for k in range(size):
        hashed = hashed * np.uint64(0xD6E8FEB86659FD93) + mixed[k : k + windows]
    order = np.argsort(hashed, kind="stable")
    equal = hashed[order[1:]] == hashed[order[:-1]]
    if not equal.any():
        return 0
    # Equal hashes are compared word by word; should two windows only look alike, tell all apart by their words.
    spans = np.lib.stride_tricks.sliding_window_view(ids, size)
    pairs = np.flatnonzero(equal)
    repeated = np.zeros(windows, bool)
    if (spans[order[pairs]] == spans[order[pairs + 1]]).all():
        repeated[order[pairs]] = repeated[order[pairs + 1]] = True
    else:
        _, which, times = np.unique(spans, axis=0, return_inverse=True, return_counts=True)
        repeated = times[which.ravel()] > 1
    covered = np.zeros(n, bool)
    for k in range(size):
        covered[k : k + windows] |= repeated
    return int(covered.sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    words = text.encode().split()  # bytes split at the six ASCII blanks
    seen: set[str] = set()
    lines = 0
    if "\n" in text:
        for line in text.split("\n"):
            if line in seen:
                lines += 1
            elif line.strip(BLANKS):
                seen.add(line)
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        lines,
        repeated_words(words),
    )


@lru_cache(1)
def meter(ranks: str, pieces: str) -> Callable[[str], tuple[int, float, float, float, str]]:
    with open(ranks, "rb") as lines:
        table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("fertility", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table_, special_tokens={})
    model = sentencepiece.SentencePieceProcessor(model_file=pieces)
    # A character is spelled as bytes when it is no piece of its own; a blank is written as U+2581.
    single = {p for p in map(model.id_to_piece, range(model.get_piece_size())) if len(p) == 1} | {" "}

    def measure(text: str) -> tuple[int, float, float, float, str]:
        ids = np.array(encoding.encode_ordinary(text), np.int32)
        if not len(ids):
            return 0, 0.0, 0.0, 0.0, "none"
        share = np.sort(ids)
        share = np.diff(np.flatnonzero(np.concatenate(([True], share[1:] != share[:-1], [True])))) / len(ids)
        as_bytes = sum(text.count(c) for c in set(text) - single if c != "\n")
        return len(ids), len(text) / len(ids), float(-(share * np.log2(share)).sum()), as_bytes / len(text), script_of(text)

    return measure


def measured(docs: DataFrame, text: str = "text", lang: str = "lang", ranks: str = RANKS, pieces: str = PIECES) -> DataFrame:
    """Documents in ``row``, with ``lang``, the base counts and the tokenisers' measures."""
    rows = docs.select(
        packed(docs), named(lang).cast("string").alias("lang"), F.coalesce(named(text), F.lit("")).alias("text")
    )

    def count(batches):
        measure = meter(ranks, pieces)
        for batch in batches:
            found = [base_counts(t) + measure(t) for t in map(pa.StringScalar.as_py, batch.column("text"))]
            columns = [pa.array(c) for c in zip(*found)] if found else []
            if columns:
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("lang"), *columns], out_names)

    out_names = ["row", "lang", *[c.split()[0] for c in f"{COUNTS}, {MEASURES}".split(", ")]]
    return rows.mapInArrow(count, output(rows, ["row", "lang"], f"{COUNTS}, {MEASURES}"))


def quartiles(rows: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, n, chars_per_token, entropy): texts and quartiles of each group."""
    two = [F.percentile_approx(c, [0.25, 0.75], 10_000).alias(c) for c in ("chars_per_token", "entropy")]
    return rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), *two)


def _drawn(own: str, wider: str, measure: str, at: int) -> Column:
    """A quartile of the group, drawn towards the wider one's; the wider one's where the group has no texts."""
    n, mine, theirs = F.coalesce(F.col(f"{own}.n"), F.lit(0)), F.col(f"{own}.{measure}")[at], F.col(f"{wider}.{measure}")[at]
    return F.coalesce((mine * n + theirs * F.lit(PRIOR)) / (n + F.lit(PRIOR)), theirs)


def judge(rows: DataFrame) -> DataFrame:
    """Adds ``base_failed`` and ``kept``. Bands come from all texts that pass the base rules; one row per language and script."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    fair = rows.where(~failed)
    # Written, so that Spark knows their sizes and need not deal the texts by language.
    everything = quartiles(fair, []).select(F.struct("n", "chars_per_token", "entropy")).scalar()
    scripts = quartiles(fair, ["script"]).withColumn("a", everything)
    measures = ("chars_per_token", "entropy")
    scripts = scripts.alias("s").select("script", "n", *[F.array(*[_drawn("s", "a", m, k) for k in (0, 1)]).alias(m) for m in measures])
    scripts = stage(scripts, "script-bands")
    bands = stage(quartiles(fair, ["lang"]), "bands")
    met = rows.alias("r").join(bands.alias("b"), F.col("r.lang").eqNullSafe(F.col("b.lang")), "left")
    # A script in which no text passes has the bands of all texts.
    both = met.join(scripts.alias("s"), F.col("r.script") == F.col("s.script"), "left").withColumn("a", everything)
    wider = F.lit(WIDTH) * (1 + F.sqrt(F.lit(SHORT) / F.greatest(F.col("n_tokens"), F.lit(1))))

    def inside(measure: str, upper: bool):
        script = F.struct(F.array(*[F.coalesce(F.col(f"s.{measure}")[k], F.col(f"a.{measure}")[k]) for k in (0, 1)]).alias(measure))
        n = F.coalesce(F.col("b.n"), F.lit(0))
        low, high = [
            F.coalesce((F.col(f"b.{measure}")[k] * n + script[measure][k] * F.lit(PRIOR)) / (n + F.lit(PRIOR)), script[measure][k]) for k in (0, 1)
        ]
        at, reach = F.col(f"r.{measure}"), wider * (high - low)
        good = at >= low - reach
        return F.coalesce(good & (at <= high + reach) if upper else good, F.lit(True))

    good = inside("chars_per_token", True) & inside("entropy", False) & (F.col("byte_share") <= MAX_BYTES)
    return both.select("r.*", (~F.col("base_failed") & good).alias("kept"))


def op4_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    narrow = measured(docs).withColumn("row", F.struct("row.doc_id"))
    judged = judge(stage(narrow, "fertility"))
    return judged.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "n_tokens", "chars_per_token", "entropy", "byte_share", "script",
    )


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: the documents that the rules keep."""
    kept = judge(stage(measured(docs), "fertility")).where("kept")
    return kept.select(*unpacked(kept, docs.columns))
