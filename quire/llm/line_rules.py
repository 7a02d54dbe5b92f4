"""Quality rules: measures of each document, and cross-document line frequency per host.

Lines are normalised (lower case, all but letters dropped) and hashed with their host. A line is boilerplate when
more than `max_documents` distinct documents of the host have it; documents of equal text count once, so copies of
a page don't make its own prose boilerplate. Boilerplate stays in the host's first document that has
it and goes from all others; a document that lost so much that less than `min_share` of its words, or fewer than
MIN_WORDS, are left is depleted and rejected.

DataFrame functions only. Measures are taken row by row without a shuffle. Lines are hashed once, into a checkpoint;
their counts are combined before each of two shuffles, the first by (line, text), so a line that a third of all
documents have is spread out, and its rows stay where they are when the lines above the limit are joined back
(`common.spread_join`). Only hashes travel, and the texts only where `clean` takes lines out.

Defined results: a null text counts as empty; a null host is a host of its own; null ids come last
in order; repeated rows get the same verdict; a line without letters is never boilerplate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import checkpointed, spread_join

MIN_WORDS = 10
#: Distinct documents of a host with a line, beyond which it is boilerplate.
MAX_DOCUMENTS = 10
#: Of a document's words, the least that must remain.
MIN_SHARE = 0.3
#: More of a document's words than this in repeated five-word windows, in per cent, fails it.
MAX_REPEATED = 20
WINDOW = 5
SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[\x00-\x60\x7B-\x7F]+", " "))


def _windows(hashes: str) -> Column:
    """A hash of each window of WINDOW words, from the array of the words' hashes."""
    n = F.size(hashes)
    windows = F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))
    return F.when(n > WINDOW, windows).otherwise(F.array().cast("array<bigint>"))


def _covered(hashes: str) -> Column:
    sorted_ = F.sort_array(F.transform(F.col(hashes), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # with the list at hand as an argument: places whose hash equals that of the place before or after
    places = F.flatten(
        F.transform(
            F.array(sorted_),
            lambda s: F.sort_array(
                F.transform(
                    F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]).eqNullSafe(True) | (F.get(s, k + 1)["h"] == x["h"]).eqNullSafe(True)),
                    lambda x: x["i"],
                )
            ),
        )
    )
    covered = F.flatten(F.transform(F.array(places), lambda p: F.transform(p, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - i, F.lit(WINDOW))))))
    total = F.aggregate(covered, F.lit(0), lambda a, x: a + x)
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), total).otherwise(0)


def measure(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    worded = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumns({"_w": words(text), "_l": worded}).withColumn("_x", F.transform("_w", lambda w: F.xxhash64(w))).withColumn("_h", _windows("_x"))
    measures = F.struct(
        F.size("_w").cast("bigint").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, f"[{SYMBOLS}]", ""))).cast("bigint").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"),
        _covered("_h").cast("bigint").alias("n_repeat_words"),
    )
    # from an explode of one element, so that a filter on a measure isn't pushed down with all that makes it, lambdas and all
    out = out.withColumn("_m", F.explode(F.array(measures))).select(*docs.columns, "_m.*")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))


def _line_key(line: Column, host: Column) -> Column:
    """The hash of a normalised line at its host; null for a line without letters."""
    normal = normal_line(line)
    return F.when(normal != "", F.xxhash64(F.coalesce(host, F.lit("\x00")), normal))


def line_rows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source") -> DataFrame:
    """(id, content, place, line, n): the hash of each line with letters and its number of words; of a document, its id and the hash of its text."""
    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("content"), F.col(host_column).cast("string").alias("host"), F.posexplode(F.split(text_column, "\n")).alias("place", "text"))
    return rows.select("id", "content", "place", _line_key(F.col("text"), F.col("host")).alias("line"), F.size(words(F.col("text"))).alias("n")).where("line IS NOT NULL")


def boilerplate(rows: DataFrame, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """(line, first, n_rows): lines of line_rows() found in more than max_documents distinct texts of their host, the first document with each, and how many rows have it."""
    by_text = rows.groupBy("line", "content").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("rows"))
    by_line = by_text.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first"), F.sum("rows").alias("n_rows"))
    return by_line.where(F.col("n") > max_documents).select("line", "first", "n_rows")


def removals(rows: DataFrame, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """(id, content, removed): for documents that lose lines, the lines' place, hash and number of words."""
    hit = spread_join(rows, checkpointed(boilerplate(rows, max_documents)), ["line"], "n_rows").where(~F.col("id").eqNullSafe(F.col("first")))
    return hit.groupBy("id", "content").agg(F.collect_set(F.struct("place", "n")).alias("removed"))


def _judged(docs: DataFrame, max_documents: int, id_column: str, text_column: str, host_column: str) -> DataFrame:
    """docs with their measures, the places of lines to remove, n_lines_removed, n_words_left and kept."""
    rows = checkpointed(line_rows(docs, id_column, text_column, host_column))
    gone = removals(rows, max_documents).select(F.col("id").alias("_id"), F.col("content").alias("_content"), "removed")
    out = measure(docs.withColumn("_c", F.xxhash64(text_column)), text_column)
    out = out.join(gone, F.col(id_column).eqNullSafe(F.col("_id")) & (F.col("_c") == F.col("_content")), "left").drop("_id", "_content", "_c")
    lost = F.coalesce(F.aggregate("removed", F.lit(0), lambda a, x: a + x["n"]), F.lit(0))
    out = out.withColumns({"n_lines_removed": F.coalesce(F.size("removed"), F.lit(0)).cast("bigint"), "n_words_left": F.col("n_words") - lost})
    depleted = F.col("removed").isNotNull() & ((F.col("n_words_left") < MIN_WORDS) | (F.col("n_words_left") < MIN_SHARE * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted)


def judge(docs: DataFrame, max_documents: int = MAX_DOCUMENTS, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source") -> DataFrame:
    """A row for each of docs: (doc_id, measures, n_lines_removed, n_words_left, base_failed, kept)."""
    docs = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.col(host_column).alias("host"))
    out = _judged(docs, max_documents, "doc_id", "text", "host")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines_removed", "n_words_left", "base_failed", "kept")


def clean(docs: DataFrame, max_documents: int = MAX_DOCUMENTS, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source") -> DataFrame:
    """The documents that are kept, without their boilerplate lines; their columns, of whatever names, as before, with n_chars, if there, counted anew."""
    rows = docs.select(F.struct(*docs.columns).alias("of"), F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.col(host_column).alias("host"))
    out = _judged(rows, max_documents, "doc_id", "text", "host").where("kept")
    places = F.transform("removed", lambda x: x["place"])
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(places, i)), "\n")
    out = out.select("of", F.when(F.col("removed").isNull(), F.col("text")).otherwise(left).alias("text"))
    given = {text_column: F.col("text")}
    if "n_chars" in docs.columns and text_column != "n_chars":
        given["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*(given.get(c, F.col("of").getField(c)).alias(c) for c in docs.columns))


_SPACE = "[\\x20\\x09-\\x0D]"
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '{_SPACE}+'), lambda x: x <> '') AS w FROM d),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n
  FROM (SELECT doc_id, i, list_slice(w, i, i + 4) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w))),
repeated AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM windows WHERE n > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d),
normal AS (
  SELECT *, len(list_filter(string_split_regex(line, '{_SPACE}+'), lambda x: x <> '')) AS n,
    trim(regexp_replace(lower(line), '[\x00-\x60\x7B-\x7F]+', ' ', 'g')) AS norm
  FROM lines),
frequent AS (
  SELECT host, norm, min(doc_id) AS first FROM normal WHERE norm <> ''
  GROUP BY host, norm HAVING count(DISTINCT text) > {MAX_DOCUMENTS}),
lost AS (
  SELECT doc_id, count(*) AS n_lines, sum(n) AS n FROM normal JOIN frequent USING (host, norm)
  WHERE doc_id <> first GROUP BY doc_id),
dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(w.w)::bigint AS n_words,
    length(regexp_replace(w.text, '{_SPACE}', '', 'g'))::bigint AS word_chars,
    (length(w.text) - length(regexp_replace(w.text, '[#*$%&|<>]', '', 'g')))::bigint AS n_symbols,
    coalesce(dup.n, 0)::bigint AS n_dup_lines, coalesce(repeated.n, 0)::bigint AS n_repeat_words,
    coalesce(lost.n_lines, 0)::bigint AS n_lines_removed, (len(w.w) - coalesce(lost.n, 0))::bigint AS n_words_left, lost.n IS NOT NULL AS changed
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN repeated USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines_removed, n_words_left,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words)
    AND NOT (changed AND (n_words_left < {MIN_WORDS} OR n_words_left < {MIN_SHARE} * n_words)) AS kept
FROM m
"""
