"""python -m quire: prints a page of a book, or what it is and its contents."""

from __future__ import annotations

import argparse
import sys
import tempfile
from datetime import datetime

VERSION = "0.2.0"


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="quire", description="Reads EPUB books.")
    out.add_argument("book", nargs="?", help="an EPUB file")
    out.add_argument("--info", action="store_true", help="print the book's metadata and contents")
    out.add_argument("-p", "--page", type=int, help="the page to print")
    out.add_argument("-c", "--chapter", type=int, help="the chapter whose first page to print")
    out.add_argument("-v", "--version", action="version", version=f"quire {VERSION}")
    return out


def main(arguments: list[str] | None = None) -> int:
    given = parser().parse_args(arguments)
    if not given.book:
        print("ERROR: Please include the EPUB file", file=sys.stderr)
        return 1
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from quire.operators import navigate, render
    from quire.plans.library import Library

    spark = SparkSession.getActiveSession() or SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").getOrCreate()
    folder, _, name = given.book.rpartition("/")
    # each table is derived once, in a folder of this machine's, as all runs on it
    held = Library.read(spark, folder or ".", glob=name).save(tempfile.mkdtemp(prefix="quire-"))
    books = held.books.select("book_id", "error").collect()
    if not books or books[0]["error"]:
        print(f"ERROR: {books[0]['error'] if books else 'no such file'}", file=sys.stderr)
        return 1
    book = books[0]["book_id"]
    if given.info:
        for r in held.info().where(F.col("book_id") == book).orderBy("line_no").collect():
            print(r["line"])
        return 0
    total = held.pages.where(F.col("book_id") == book).count()
    wanted = given.page if given.page is not None else held.chapter_page(book, given.chapter) if given.chapter else 1
    rows = held.page(book, max(1, min(wanted, total)), clock=render.clock_text(datetime.now())).collect()
    texts = {r["row"]: r["text"] for r in rows}
    print("\n".join(texts.get(i, "") for i in range(max(texts, default=-1) + 1)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
