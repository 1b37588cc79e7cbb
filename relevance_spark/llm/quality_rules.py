"""Quality rules: a threshold table compiled into one projection of built-in functions.

Every rule is a row (name, lowest, highest) over a metric of the text. ``apply_rules`` keeps the columns of its input
and adds the metrics, ``base_failed`` and ``kept``; a null or empty text has no words, fails the base rules and is not
kept. Nothing is shuffled: the repeated three-word windows of a text are found inside its row.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relevance_spark.llm.shared import SPACES, let, text_or_empty

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"

#: Frequent function words of the languages that the rules know: English, French, German, Spanish.
STOP_WORDS = (
    "the of and to in is that for on with as it by an at from this are was be "
    "le la les des et en un une dans que qui pour par sur est au "
    "der die das und ist von mit den ein eine auf sich nicht zu "
    "el los las de y del con una por se lo su como"
).split()

#: metric, lowest and highest value that passes; None: no bound.
RULES: list[tuple[str, float | None, float | None]] = [
    ("n_words", 50, None),
    ("mean_word_chars", 2, 14),
    ("symbols_per_word", None, 0.2),
    ("n_stop_words", 2, None),
    ("exclamations_per_word", None, 0.3),
    ("duplicate_line_share", None, 0.4),
    ("repeat_word_share", None, 0.5),
]


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur at least twice in the array of words."""

    def marked(hashes: Column) -> Column:
        # Windows in order of their hash: equal ones stand side by side. Their places, in order, cover three words each.
        in_order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            last = F.size(s) - 1
            twin = lambda x, i: ((i > 0) & (s[F.greatest(i - 1, F.lit(0))]["h"] == x["h"])) | ((i < last) & (s[F.least(i + 1, last)]["h"] == x["h"]))
            return F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))

        covered = F.aggregate(
            let(in_order, places),
            F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at")),
            lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["at"])).alias("n"), i.alias("at")),
        )
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered["n"])

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(windows, marked)).cast("long")


def _occurrences(text: Column, characters: str) -> Column:
    """How often single-byte characters occur; replacing them is a search of bytes, much faster than a translation."""
    return reduce(add, [F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in characters]).cast("long")


def _line_metrics(lines: Column) -> Column:
    full = F.filter(lines, lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    return let(full, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))


def metrics(text: Column) -> Column:
    """Struct of the counts of one text; text must not be null."""
    trimmed = F.btrim(text, F.lit(SPACES))
    words = F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))

    def of(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            _repeat_words(w).alias("n_repeat_words"),
            F.size(F.array_intersect(w, F.array(*map(F.lit, STOP_WORDS)))).cast("long").alias("n_stop_words"),
        )

    return let(words, of)


def rule_verdict(rules=None) -> Column:
    """The threshold table as one boolean expression over the metric columns."""
    passed = F.lit(True)
    for name, low, high in rules or RULES:
        if low is not None:
            passed = passed & (F.col(name) >= F.lit(float(low)))
        if high is not None:
            passed = passed & (F.col(name) <= F.lit(float(high)))
    return passed


def measured(docs: DataFrame) -> DataFrame:
    """docs with ``_m``, a struct of all counts, shares and verdicts, so that no name of docs can clash."""
    text = text_or_empty()
    lines = _line_metrics(F.split(text, "\n"))
    share = lambda a, b: F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))
    counts = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        metrics(text).alias("w"),
        lines.alias("l"),
        (F.length(text) - _occurrences(text, SPACES)).alias("word_chars"),
        _occurrences(text, SYMBOLS).alias("n_symbols"),
        _occurrences(text, "!").alias("n_exclamations"),
    )
    named = counts.select(
        "row", "word_chars", "n_symbols", "w.n_words", "w.n_repeat_words", "w.n_stop_words", F.col("l.n_dup_lines").cast("long").alias("n_dup_lines"),
        share(F.col("word_chars"), F.col("w.n_words")).alias("mean_word_chars"),
        share(F.col("n_symbols"), F.col("w.n_words")).alias("symbols_per_word"),
        share(F.col("n_exclamations"), F.col("w.n_words")).alias("exclamations_per_word"),
        share(F.col("l.n_dup_lines"), F.col("l.n_lines")).alias("duplicate_line_share"),
        share(F.col("w.n_repeat_words"), F.col("w.n_words")).alias("repeat_word_share"),
    )
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    keep = F.when(base, F.lit(False)).otherwise(rule_verdict())
    return named.withColumns({"base_failed": base, "kept": keep})


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass, with the columns of docs."""
    return measured(docs).where("kept").select("row.*")


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return measured(docs).select("row.doc_id", *COUNTS, "base_failed", "kept")


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, i, words[i] || ' ' || words[i+1] || ' ' || words[i+2] AS win
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM win),
cov AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, (VALUES (0), (1), (2)) t(o) WHERE c > 1 GROUP BY doc_id),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
      (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
      (length(text) - length(replace(text, '!', '')))::BIGINT AS n_exclamations, len(lines) AS n_lines,
      (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
      len(list_filter(list_distinct(words), lambda x: x IN ({_STOP_SQL}))) AS n_stop
      FROM w LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 2 AND 14 AND n_symbols / n_words <= 0.2 AND n_stop >= 2
  AND n_exclamations / n_words <= 0.3 AND n_dup_lines / n_lines <= 0.4 AND n_repeat_words / n_words <= 0.5 AS kept
FROM b
"""
