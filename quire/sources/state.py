"""Reading states as sections of a text file: [BOOK:<id>] and key=value lines."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire import config as C
from quire.functions import text as X

KEYS = ("last_page", "theme", "column_width", "full_justify", "paragraph_style", "bookmarks")


def default_path() -> str:
    home = os.environ.get("XDG_CONFIG_HOME") or os.path.join(os.environ.get("HOME", "."), ".config")
    return os.path.join(home, "quire", "state")


def parse_states(lines: DataFrame) -> DataFrame:
    """States of lines(file, line_no, value): of equal sections of a file the first counts, of equal books in several files the first file's.

    Lines are trimmed; one that begins with [ and ends with ] is a header, and a line belongs to the last header above it. Of equal keys the last counts, but
    bookmarks add up, the first 256 positive numbers; a number is read as far as it has digits, and too large a one is the largest; what is
    missing, or zero where it mustn't be, gets its default.
    """
    file = W.partitionBy("file").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    lines = lines.withColumn("value", X.str_trim("value"))
    header = F.when(F.col("value").rlike(r"^\[(?s:.*)\]$"), F.struct(F.regexp_extract("value", r"^\[BOOK:(.*)\]$", 1).alias("id"), F.col("line_no").alias("at")))
    rows = lines.withColumn("own", header).withColumn("h", F.last("own", ignorenulls=True).over(file)).where("h.id <> ''").select("file", F.col("h.id").alias("book_id"), F.col("h.at").alias("at"), "line_no", F.when(F.col("own").isNull(), F.col("value")).otherwise("").alias("value"))
    first = rows.groupBy("file", "book_id").agg(F.min("at").alias("at"))
    rows = rows.join(first, ["file", "book_id", "at"], "left_semi").withColumns({"key": X.str_trim(F.substring_index("value", "=", 1)), "v": X.str_trim(F.expr("substr(value, instr(value, '=') + 1)")), "has": F.contains("value", F.lit("="))})
    marks = F.array_sort(F.collect_list(F.when(F.col("has") & (F.col("key") == "bookmarks"), F.struct("line_no", "v"))))
    wide = rows.groupBy("file", "book_id").agg(*(F.max_by("v", F.when(F.col("has") & (F.col("key") == k), F.col("line_no"))).alias(k) for k in KEYS if k != "bookmarks"), marks.alias("marks"))

    def number(text: Column, kind: str, largest: int) -> Column:
        digits = F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1)
        return F.coalesce(digits.try_cast(kind), F.when(digits.rlike("^-"), F.lit(-largest - 1)).when(digits != "", F.lit(largest)).cast(kind))

    long_, int_ = (lambda t: number(t, "bigint", (1 << 63) - 1)), (lambda t: number(t, "int", (1 << 31) - 1))
    pages = F.flatten(F.transform("marks", lambda m: F.transform(F.split(m["v"], ","), long_)))
    states = wide.select(
        "file",
        "book_id",
        F.greatest(F.coalesce(long_("last_page"), F.lit(1)), F.lit(1)).alias("last_page"),
        F.coalesce(int_("theme"), F.lit(0)).alias("theme"),
        F.coalesce(int_("column_width"), F.lit(0)).alias("column_width"),
        F.when(F.col("full_justify").isNull(), True).otherwise(F.coalesce(int_("full_justify"), F.lit(0)) != 0).alias("full_justify"),
        F.coalesce(int_("paragraph_style"), F.lit(0)).alias("paragraph_style"),
        F.slice(F.filter(pages, lambda m: m > 0), 1, C.MAX_BOOKMARKS).alias("bookmarks"),
    )
    return states.groupBy("book_id").agg(F.min_by(F.struct(*KEYS), "file").alias("s")).select("book_id", "s.*")


def load_states(spark: SparkSession, path: str) -> DataFrame:
    """The states in files under path, each file read whole as it stands in order."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "value"))
    return parse_states(files)


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with the books of new replaced, which come last."""
    return old.join(new.select("book_id").distinct(), "book_id", "left_anti").unionByName(new)


def state_text(states: DataFrame) -> DataFrame:
    """(book_id, value): each state as the lines of its section."""
    line = lambda k, v: F.concat(F.lit(f"{k}="), v)
    values = [line(k, F.col(k).cast("int").cast("string") if k != "bookmarks" else F.array_join(F.transform("bookmarks", lambda b: b.cast("string")), ",")) for k in KEYS if k != "last_page"]
    return states.select("book_id", F.concat_ws("\n", F.concat(F.lit("[BOOK:"), "book_id", F.lit("]")), line("last_page", F.col("last_page").cast("string")), *values).alias("value"))


def save_states(states: DataFrame, path: str) -> None:
    """Writes sections to a new folder of text files; an existing one isn't overwritten."""
    state_text(states).select("value").write.text(path)
