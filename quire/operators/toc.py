"""Package joins and tables of contents: resolving, fallback, coverage, synthesis from headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.config import Options
from quire.functions import text as X
from quire.operators.navigate import numbered


def spine_of(itemrefs: DataFrame, manifest: DataFrame) -> DataFrame:
    """itemrefs(book_id, pos, idref, ...) that name a manifest item, the first of equal ids; spine_index counts those from 0."""
    first = manifest.groupBy("book_id", F.col("id").alias("idref")).agg(F.min_by(F.struct("pos", "full_path", "media_type"), "pos").alias("m"))
    met = itemrefs.join(first, ["book_id", "idref"]).withColumns({"manifest_pos": F.col("m.pos"), "full_path": F.col("m.full_path"), "media_type": F.col("m.media_type")}).drop("m")
    return met.withColumn("spine_index", F.row_number().over(W.partitionBy("book_id").orderBy("pos")) - 1)


def targets(toc: DataFrame, spine: DataFrame) -> DataFrame:
    """toc(book_id, full_path, ...) with spine_index: the first chapter of that path, -1 for none."""
    first = spine.groupBy("book_id", "full_path").agg(F.min("spine_index").alias("spine_index"))
    return toc.drop("spine_index").join(first, ["book_id", "full_path"], "left").withColumn("spine_index", F.coalesce("spine_index", F.lit(-1)))


def entries(links: DataFrame, opf_dir: Column) -> DataFrame:
    """links(book_id, toc_index, title, href, level, play_order) as entries: titles trimmed, hrefs decoded, joined to opf_dir and split from their anchors."""
    title = X.str_trim("title")
    path = X.path_join(opf_dir, X.url_decode(X.url_path("href")))
    return links.withColumns({"title": title, "full_path": path, "anchor": X.url_fragment("href")}).where(F.coalesce("title", F.lit("")) != "")


def fallback(spine: DataFrame, toc: DataFrame) -> DataFrame:
    """For books without any entry: one per chapter, 'Chapter n'."""
    missing = spine.join(toc.select("book_id").distinct(), "book_id", "left_anti")
    return missing.select("book_id", F.col("spine_index").alias("toc_index"), X.fallback_title(F.col("spine_index")).alias("title"), "full_path", F.lit(None).cast("string").alias("anchor"), F.lit(0).alias("level"), "spine_index", F.lit(0).alias("play_order"), F.lit("fallback").alias("origin"))


def coverage(toc: DataFrame, spine: DataFrame) -> DataFrame:
    """(book_id, spine_count, covered): chapters, and those that some entry names."""
    n = spine.groupBy("book_id").agg(F.count(F.lit(1)).alias("spine_count"))
    met = toc.join(n, "book_id").groupBy("book_id").agg(F.count_distinct(F.when((F.col("spine_index") >= 0) & (F.col("spine_index") < F.col("spine_count")), F.col("spine_index"))).alias("covered"))
    return n.join(met, "book_id", "left").withColumn("covered", F.coalesce("covered", F.lit(0)))


def synthesize(toc: DataFrame, spine: DataFrame, blocks: DataFrame, options: Options = Options()) -> DataFrame:
    """Where entries name half of the chapters or less, headings become the entries, and those old ones follow that no heading's chapter and title repeats."""
    counted = coverage(toc, spine).join(toc.groupBy("book_id").agg(F.bool_and(F.col("origin") == "fallback").alias("only_fallback")), "book_id", "left")
    covered = F.when(F.coalesce("only_fallback", F.lit(True)) & F.lit(options.replaces_fallback), F.lit(0)).otherwise(F.col("covered"))
    thin = counted.where((F.col("spine_count") >= 2) & (2 * covered <= F.col("spine_count"))).select("book_id")
    headings = blocks.where((F.col("type") == "HEADING") & (F.coalesce("section_title", F.lit("")) != "")).join(thin, "book_id", "left_semi")
    level = F.when(F.col("heading_level") == 0, 2).otherwise(F.col("heading_level")) - 1
    path = spine.select("book_id", "spine_index", "full_path")
    new = numbered(headings, "n", "spine_index", "block_index").join(path, ["book_id", "spine_index"], "left").select("book_id", (F.col("n") - 1).alias("toc_index"), F.col("section_title").alias("title"), "full_path", F.col("anchor_id").alias("anchor"), level.alias("level"), "spine_index", F.col("n").alias("play_order"), F.lit("heading").alias("origin"))
    # the fallback says nothing that headings don't, so it goes where it is replaced
    old = toc.where(F.lit(not options.replaces_fallback) | (F.col("origin") != "fallback") | F.col("book_id").isNull()).unionByName(toc.where((F.lit(options.replaces_fallback)) & (F.col("origin") == "fallback")).join(new.select("book_id").distinct(), "book_id", "left_anti"))
    kept = old.join(new.select("book_id", "spine_index", "title").distinct(), ["book_id", "spine_index", "title"], "left_anti")
    return merged(new, kept, options.order_by_spine)


def merged(new: DataFrame, kept: DataFrame, by_spine: bool = False) -> DataFrame:
    """New entries, then those kept, numbered anew."""
    both = new.withColumn("_part", F.lit(0)).unionByName(kept.withColumn("_part", F.lit(1)))
    order = ["spine_index", "_part", "toc_index"] if by_spine else ["_part", "toc_index"]
    return both.withColumn("toc_index", F.row_number().over(W.partitionBy("book_id").orderBy(*order)) - 1).drop("_part")


def first_title(toc: DataFrame) -> DataFrame:
    """(book_id, spine_index, title): of a chapter's entries, the first without an anchor, else the first."""
    return toc.where("spine_index >= 0").groupBy("book_id", "spine_index").agg(F.min_by("title", F.struct(F.col("anchor").isNotNull(), "toc_index")).alias("title"))


def layout_titles(chapters: DataFrame, toc: DataFrame, blocks: DataFrame, books: DataFrame) -> DataFrame:
    """chapters with chapter_title: as first_title, but of entries that aren't junk and whose anchor occurs; then the chapter's own, then the book's title."""
    anchors = blocks.where("anchor_id IS NOT NULL").select("book_id", "spine_index", F.col("anchor_id").alias("anchor")).distinct()
    there = toc.where(F.col("anchor").isNotNull()).join(anchors, ["book_id", "spine_index", "anchor"], "left_semi")
    usable = toc.where(F.col("anchor").isNull()).unionByName(there).where(~X.is_junk_title("title"))
    own = F.when((F.col("title") != "") & (F.col("title") != "Chapter") & ~X.is_junk_title("title"), F.col("title"))
    of_book = books.select("book_id", F.nullif(F.col("title"), F.lit("")).alias("_book"))
    return chapters.join(first_title(usable).withColumnRenamed("title", "_toc"), ["book_id", "spine_index"], "left").join(of_book, "book_id", "left").withColumn("chapter_title", F.coalesce("_toc", own, "_book", "title", F.lit("Chapter"))).drop("_toc", "_book")


def block_entries(blocks: DataFrame, toc: DataFrame) -> DataFrame:
    """blocks with toc_title: the first entry of their chapter that names their anchor."""
    named = toc.where(F.col("anchor").isNotNull()).groupBy("book_id", "spine_index", F.col("anchor").alias("anchor_id")).agg(F.min_by("title", "toc_index").alias("toc_title"))
    return blocks.join(named, ["book_id", "spine_index", "anchor_id"], "left")
