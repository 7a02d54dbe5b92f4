"""The plan from files to pages: each table of a library as a DataFrame, derived from the ones before."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.config import Options
from quire.operators import cascade, clean, layout, navigate, render, toc
from quire.sources import css, html
from quire.sources.epub import read_books

WORD = pa.struct([("text", pa.string()), ("visual_width", pa.int32()), ("style", pa.int32()), ("space_after", pa.bool_())])
BLOCKS = (
    "book_id string, spine_index int, block_index int, type string, heading_level int, anchor_id string, section_title string, "
    "css_heading boolean, css_page_break boolean, css_centered boolean, css_font_ratio float, words array<struct<text:string,visual_width:int,style:int,space_after:boolean>>"
)
FIELDS = ("type", "heading_level", "anchor_id", "section_title", "css_heading", "css_page_break", "css_centered", "css_font_ratio")
TYPES = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.float32()]


def parse_chapters(chapters: DataFrame, strict: bool = False) -> DataFrame:
    """Blocks of chapters(book_id, spine_index, content, rules): rules an array of struct(kind, key, flags..., font_ratio), or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in ("book_id", "spine_index", "content", "rules")}
                rules = {(r["kind"], r["key"]): ({f for f in cascade.FLAGS if r[f]}, r["font_ratio"]) for r in row["rules"] or ()}
                blocks = html.parse(row["content"] or "", rules, lambda s: css.effect(s, strict), strict)
                n = len(blocks)
                words = [[{"text": t, "visual_width": w, "style": s, "space_after": a} for t, w, s, a in b.words] for b in blocks]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["book_id"]] * n, pa.string()), pa.array([row["spine_index"]] * n, pa.int32()), pa.array(range(n), pa.int32()), *(pa.array([getattr(b, f) for b in blocks], t) for f, t in zip(FIELDS, TYPES)), pa.array(words, pa.list_(WORD))],
                    ["book_id", "spine_index", "block_index", *FIELDS, "words"],
                )

    return chapters.select("book_id", F.col("spine_index").cast("int").alias("spine_index"), "content", "rules").mapInArrow(run, BLOCKS)


class Library:
    """Books under a path. Tables are lazy; `save` writes those that are dear to derive, and `Library.load` goes on from there."""

    def __init__(self, parsed: DataFrame, options: Options = Options()) -> None:
        self.parsed, self.options = parsed, options

    @classmethod
    def read(cls, spark: SparkSession, path: str, options: Options = Options(), glob: str = "*.epub") -> Library:
        return cls(read_books(spark, path, glob, options.strict), options)

    #: What `save` writes, each derived from those before.
    TABLES = ("parsed", "spine", "css_rules", "raw_blocks", "blocks", "first_toc", "toc", "chapters", "laid")

    def save(self, folder: str) -> Library:
        """Writes the tables that others build on, each from the written ones before it, and returns the library that reads them."""
        spark = self.parsed.sparkSession
        held = Library(self.parsed, self.options)
        for name in self.TABLES:
            getattr(held, name).write.mode("overwrite").parquet(f"{folder}/{name}")
            setattr(held, name, spark.read.parquet(f"{folder}/{name}"))
        return held

    @classmethod
    def load(cls, spark: SparkSession, folder: str, options: Options = Options(), new_layout: bool = False) -> Library:
        """A saved library; with a new layout, lines and pages follow the options given and not those it was saved with."""
        held = cls(spark.read.parquet(f"{folder}/parsed"), options)
        for name in cls.TABLES[1 : -1 if new_layout else None]:
            setattr(held, name, spark.read.parquet(f"{folder}/{name}"))
        return held

    @cached_property
    def books(self) -> DataFrame:
        return self.parsed.select("book_id", "filepath", "title", "author", "language", "opf_path", "opf_dir", "spine_toc", "error")

    @cached_property
    def manifest(self) -> DataFrame:
        return self.parsed.select("book_id", F.explode("manifest").alias("m")).select("book_id", "m.*")

    @cached_property
    def spine(self) -> DataFrame:
        refs = self.parsed.where("error IS NULL").select("book_id", F.explode("itemrefs").alias("r")).select("book_id", "r.*")
        return toc.spine_of(refs, self.manifest)

    @cached_property
    def css_rules(self) -> DataFrame:
        rows = self.parsed.select("book_id", F.explode("declarations").alias("d")).select("book_id", "d.*")
        return cascade.rules(rows, self.options.strict)

    @cached_property
    def raw_blocks(self) -> DataFrame:
        contents = self.parsed.select("book_id", F.explode("contents").alias("c")).select("book_id", "c.full_path", "c.content")
        rules = self.css_rules.groupBy("book_id").agg(F.collect_list(F.struct("kind", "key", *cascade.FLAGS, "font_ratio")).alias("rules"))
        chapters = self.spine.select("book_id", "spine_index", "full_path").join(contents, ["book_id", "full_path"], "left").join(rules, "book_id", "left")
        return parse_chapters(chapters, self.options.strict)

    @cached_property
    def blocks(self) -> DataFrame:
        return clean.promote(clean.prune(self.raw_blocks, self.options))

    @cached_property
    def first_toc(self) -> DataFrame:
        links = self.parsed.where("error IS NULL").select("book_id", "opf_dir", F.explode("links").alias("k")).select("book_id", "opf_dir", "k.*")
        found = toc.targets(toc.entries(links, F.col("opf_dir")), self.spine)
        columns = ["book_id", "toc_index", "title", "full_path", "anchor", "level", "spine_index", "play_order", "origin"]
        return found.select(*columns).unionByName(toc.fallback(self.spine, found).select(*columns))

    @cached_property
    def toc(self) -> DataFrame:
        thin = toc.synthesize(self.first_toc, self.spine, self.blocks, self.options)
        return thin

    @cached_property
    def chapters(self) -> DataFrame:
        """(book_id, spine_index, href, title): named by their first heading, else by the contents, else 'Chapter'."""
        named = toc.first_title(self.first_toc)
        first = self.spine.select("book_id", "spine_index", F.col("full_path").alias("href")).join(named, ["book_id", "spine_index"], "left").withColumn("title", F.coalesce("title", F.lit("Chapter")))
        return clean.chapter_titles(first, self.blocks)

    @cached_property
    def laid(self) -> DataFrame:
        titled = toc.layout_titles(self.chapters, self.toc, self.blocks, self.books)
        return layout.typeset(titled, toc.block_entries(self.blocks, self.toc), self.options)

    @cached_property
    def lines(self) -> DataFrame:
        return layout.lines_table(self.laid, self.options)

    @cached_property
    def pages(self) -> DataFrame:
        return layout.pages_table(self.laid)

    @cached_property
    def toc_pages(self) -> DataFrame:
        return navigate.toc_pages(self.toc, self.pages, self.lines)

    def info(self) -> DataFrame:
        """(book_id, line_no, line): each book's header and contents."""
        n = self.spine.groupBy("book_id").agg(F.count(F.lit(1)).alias("chapters"))
        return navigate.info_lines(self.books.where("error IS NULL").join(n, "book_id", "left"), self.toc)

    def words(self) -> DataFrame:
        """(book_id, global_page, line_index, word_index, word) of all lines on pages."""
        on = self.pages.select("book_id", "spine_index", "global_page", "start_line", "line_count").where("line_count > 0")
        lines = self.lines.select("book_id", "spine_index", "line_index", "texts")
        met = lines.join(on, ["book_id", "spine_index"]).where("line_index >= start_line AND line_index < start_line + line_count")
        return met.select("book_id", "global_page", "line_index", F.posexplode("texts").alias("word_index", "word"))

    def search(self, query: str) -> DataFrame:
        return navigate.search(self.words(), query)

    @cached_property
    def entries(self) -> DataFrame:
        """(book_id, full_path, content): the chapters' files as they stand in the archive."""
        return self.parsed.select("book_id", F.explode("contents").alias("c")).select("book_id", "c.full_path", "c.content")

    def contents(self, book_id: str, current_page: int = 1) -> DataFrame:
        """The contents of a book with their pages, and the entry to begin at."""
        paged = self.toc_pages.where(F.col("book_id") == book_id)
        return navigate.contents_list(paged, paged.select("book_id").distinct().withColumn("current_page", F.lit(current_page))).orderBy("toc_index")

    def chapter_page(self, book_id: str, chapter: int) -> int:
        """The first page of a chapter, counted from 1."""
        firsts = navigate.chapter_first_pages(self.pages.where((F.col("book_id") == book_id) & (F.col("spine_index") == chapter - 1)))
        return next((r["first_page"] for r in firsts.collect()), 1)

    def page(self, book_id: str, number: int, state: dict | None = None, query: str = "", clock: str = "", terminal: tuple[int, int] | None = None) -> DataFrame:
        """One page as rows of a screen: (row, text). state: has bookmarks; query: what is searched for; terminal: its columns and rows."""
        spark, column = self.parsed.sparkSession, self.options.column_width
        wide, high = terminal or (column + 4, self.options.page_height + 4)
        margin = max(0, (wide - column) // 2)
        pages = self.pages.where(F.col("book_id") == book_id)
        total, here = pages.count(), pages.where(F.col("global_page") == number).select("spine_index", "start_line", "line_count", "section_title", "is_title_page").collect()
        title = self.books.where(F.col("book_id") == book_id).select("title").collect()
        if not here or not title:
            return spark.createDataFrame([], "row int, text string")
        one, match = here[0], None
        if query:
            found = self.search(query).where(F.col("book_id") == book_id)
            first = navigate.first_match(found, F.lit(number)).collect()
            match = (first[0]["match"] + 1, found.count()) if first else None
        marked = number in (state or {}).get("bookmarks", ())
        rows = [(0, render.header(title[0]["title"] or "", one["section_title"] or "", column, margin, one["is_title_page"])), (high - 1, render.footer(number, total, marked, match, clock, column, margin, wide))]
        if one["is_title_page"]:
            rows += render.title_page(one["section_title"] or "", column, margin, high)
        around = spark.createDataFrame(rows, "row int, text string")
        lines = self.lines.where((F.col("book_id") == book_id) & (F.col("spine_index") == one["spine_index"]) & F.col("line_index").between(one["start_line"], one["start_line"] + one["line_count"] - 1))
        centred = F.greatest(F.floor((F.lit(column) - F.col("total_width")) / 2).cast("int"), F.lit(0))
        ornament = F.lit(" " * ((column - render.ORNAMENT_WIDTH) // 2) + render.ORNAMENT)
        text = F.when(F.col("kind") == "hr", ornament).otherwise(layout.line_text(F.col("texts"), F.col("spaces_after"), F.when(F.col("is_centered"), centred).otherwise(F.col("indent_spaces"))))
        body = lines.select((F.col("line_index") - one["start_line"] + 2).cast("int").alias("row"), F.rtrim(F.concat(F.lit(" " * margin), text)).alias("text"))
        return around.unionByName(body.where(F.col("row") < high - 2)).orderBy("row")
