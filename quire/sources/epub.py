"""EPUB files to tables: `binaryFile` rows through one Python pass, a row for each book, from which the tables are exploded."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import paths
from quire.sources import css, html

ITEM = "struct<pos:int,id:string,href:string,media_type:string,full_path:string,properties:string>"
REF = "struct<pos:int,idref:string,linear:boolean>"
LINK = "struct<toc_index:int,title:string,href:string,level:int,play_order:int,origin:string>"
DECLARATION = "struct<pos:int,selectors:array<string>,prop:string,value:string>"
CHAPTER = "struct<full_path:string,content:string>"
BOOK = f"book_id string, filepath string, title string, author string, language string, opf_path string, opf_dir string, spine_toc string, error string, manifest array<{ITEM}>, itemrefs array<{REF}>, links array<{LINK}>, declarations array<{DECLARATION}>, contents array<{CHAPTER}>"
ARROW = pa.schema(
    [(n, pa.string()) for n in ("book_id", "filepath", "title", "author", "language", "opf_path", "opf_dir", "spine_toc", "error")]
    + [
        ("manifest", pa.list_(pa.struct([("pos", pa.int32()), *((n, pa.string()) for n in ("id", "href", "media_type", "full_path", "properties"))]))),
        ("itemrefs", pa.list_(pa.struct([("pos", pa.int32()), ("idref", pa.string()), ("linear", pa.bool_())]))),
        ("links", pa.list_(pa.struct([("toc_index", pa.int32()), ("title", pa.string()), ("href", pa.string()), ("level", pa.int32()), ("play_order", pa.int32()), ("origin", pa.string())]))),
        ("declarations", pa.list_(pa.struct([("pos", pa.int32()), ("selectors", pa.list_(pa.string())), ("prop", pa.string()), ("value", pa.string())]))),
        ("contents", pa.list_(pa.struct([("full_path", pa.string()), ("content", pa.string())]))),
    ]
)
BLANK = " \t\n\r\v\f"


class Node:
    __slots__ = ("tag", "attrs", "children", "text")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children, self.text = tag, attrs, [], ""

    def all(self, tag: str) -> Iterator[Node]:
        for c in self.children:
            if c.tag == tag:
                yield c
            yield from c.all(tag)


class _Tolerant(HTMLParser):
    """A tree of whatever tags there are; ends that match nothing are passed over."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(html.local_name(tag), {html.local_name(k): v or "" for k, v in attrs})
        self.stack[-1].children.append(node)
        self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.stack.pop()

    def handle_endtag(self, tag):
        names = [n.tag for n in self.stack]
        if (name := html.local_name(tag)) in names[1:]:
            while self.stack.pop().tag != name:
                pass

    def handle_data(self, data):
        for n in self.stack:
            n.text += data


def xml_tree(data: bytes) -> Node:
    """Local names in lower case; text is that of the whole subtree. What isn't well-formed is read as far as it goes."""

    def convert(e) -> Node:
        name = lambda s: html.local_name(s.rpartition("}")[2])
        node = Node(name(e.tag) if isinstance(e.tag, str) else "", {name(k): v for k, v in e.attrib.items()})
        node.children = [convert(c) for c in e]
        node.text = "".join(e.itertext())
        return node

    try:
        root = Node("", {})
        root.children = [convert(ET.fromstring(data))]
        return root
    except ET.ParseError:
        parser = _Tolerant()
        parser.feed(data.decode("utf-8", "replace"))
        parser.close()
        return parser.root


def _number(text: str) -> int:
    digits = "".join(c for i, c in enumerate(text.strip()) if c.isdecimal() or (i == 0 and c in "+-"))
    try:
        return int(digits)
    except ValueError:
        return 0


def ncx_links(data: bytes, strict: bool = False) -> list[tuple[str, str, int, int]]:
    """(title, href, level, play_order). strict: nested points come as often as older readers gave them, the j-th of a list j times."""
    found: list[tuple[str, str, int, int]] = []

    def one(point: Node, level: int) -> None:
        labels = [t.text.strip(BLANK) for c in point.children if c.tag == "navlabel" for t in c.children if t.tag == "text"]
        sources = [c.attrs.get("src", "") for c in point.children if c.tag == "content"]
        if labels and labels[-1] and sources and sources[-1]:
            found.append((labels[-1], sources[-1], level, _number(point.attrs.get("playorder", "0"))))
        inner = [c for c in point.children if c.tag == "navpoint"]
        for i in range(len(inner)):
            for p in inner[i:] if strict else inner[i : i + 1]:
                one(p, level + 1)

    for nav_map in list(xml_tree(data).all("navmap"))[:1]:
        for p in nav_map.children:
            if p.tag == "navpoint":
                one(p, 0)
    return found


def parse_package(data: bytes, opf_dir: str, strict: bool = False) -> dict:
    out = {"title": None, "author": None, "language": None, "spine_toc": None, "manifest": [], "itemrefs": []}
    package = next(xml_tree(data).all("package"), None)
    if package is None:
        raise ValueError("no package in the OPF")
    known: set[str] = set()
    for part in package.children:
        if part.tag == "metadata":
            for name, tag in (("title", "title"), ("author", "creator"), ("language", "language")):
                for node in part.all(tag):
                    out[name] = out[name] or node.text.strip(BLANK) or None
        elif part.tag == "manifest":
            for item in part.children:
                if item.tag == "item" and item.attrs.get("id") and item.attrs.get("href"):
                    known.add(item.attrs["id"])
                    out["manifest"].append({"pos": len(out["manifest"]), "id": item.attrs["id"], "href": item.attrs["href"], "media_type": item.attrs.get("media-type", ""), "full_path": paths.join(opf_dir, paths.decode(item.attrs["href"])), "properties": item.attrs.get("properties")})
        elif part.tag == "spine":
            out["spine_toc"] = part.attrs.get("toc")
            for ref in part.children:
                if ref.tag == "itemref" and ref.attrs.get("idref") and (not strict or ref.attrs["idref"] in known):
                    out["itemrefs"].append({"pos": len(out["itemrefs"]), "idref": ref.attrs["idref"], "linear": ref.attrs.get("linear", "yes").lower() != "no"})
    return out


def parse_book(content: bytes, strict: bool = False) -> dict:
    """All of a book that later steps need; `error` says what was wrong, and never raises."""
    out: dict = {"error": None, "manifest": [], "itemrefs": [], "links": [], "declarations": [], "contents": []}
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except Exception:
        return out | {"error": "not a ZIP archive"}

    def entry(path: str) -> bytes | None:
        try:
            return archive.read(path)
        except Exception:
            return None

    container = entry("META-INF/container.xml")
    if container is None:
        return out | {"error": "no META-INF/container.xml"}
    rootfiles = [r for files in xml_tree(container).all("rootfiles") for r in files.children if r.tag == "rootfile" and r.attrs.get("full-path")]
    if not rootfiles:
        return out | {"error": "no root file in the container"}
    opf_path = paths.normalize(rootfiles[0].attrs["full-path"])
    out |= {"opf_path": opf_path, "opf_dir": paths.dirname(opf_path)}
    package = entry(opf_path)
    if package is None:
        return out | {"error": f"no package document {opf_path}"}
    try:
        out |= parse_package(package, out["opf_dir"], strict)
    except ValueError as e:
        return out | {"error": str(e)}
    first = {}
    for item in out["manifest"]:
        first.setdefault(item["id"], item)
    read = [first[r["idref"]]["full_path"] for r in out["itemrefs"] if r["idref"] in first]
    if not read:
        return out | {"error": "empty spine"}
    ncx = first.get(out["spine_toc"]) or next((i for i in out["manifest"] if i["media_type"] == "application/x-dtbncx+xml"), None)
    links = [(*link, "ncx") for link in ncx_links(entry(ncx["full_path"]) or b"", strict)] if ncx else []
    if not links and (nav := next((i for i in out["manifest"] if "nav" in (i["properties"] or "")), None)):
        links = [(t, h, n, 0, "nav") for t, h, n in html.nav_links((entry(nav["full_path"]) or b"").decode("utf-8", "replace"))]
    out["links"] = [{"toc_index": i, "title": t, "href": h, "level": n, "play_order": p, "origin": o} for i, (t, h, n, p, o) in enumerate(links)]
    for item in out["manifest"]:
        if item["media_type"] == "text/css" and (sheet := entry(item["full_path"])) is not None:
            for selectors, prop, value in css.rows(sheet.decode("utf-8", "replace"), strict):
                out["declarations"].append({"pos": len(out["declarations"]), "selectors": selectors, "prop": prop, "value": value})
    out["contents"] = [{"full_path": p, "content": (entry(p) or b"").decode("utf-8", "replace")} for p in dict.fromkeys(read)]
    return out


def read_books(spark: SparkSession, path: str, glob: str = "*.epub", strict: bool = False, streaming: bool = False) -> DataFrame:
    """A row for each file under path. book_id is path:size:modification second. Files that can't be read have an error and defaults."""
    reader = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary") if streaming else spark.read
    files = reader.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    local = F.regexp_replace("path", "^file:/*", "/")
    files = files.select(F.concat_ws(":", local, F.col("length").cast("string"), F.unix_timestamp("modificationTime").cast("string")).alias("book_id"), local.alias("filepath"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a book at a time, so that no more than one is held
                row = {n: batch.column(n)[i].as_py() for n in ("book_id", "filepath")}
                yield pa.RecordBatch.from_pylist([row | parse_book(batch.column("content")[i].as_py(), strict)], ARROW)

    books = files.mapInArrow(run, BOOK)
    return books.withColumns({"title": F.coalesce("title", F.lit("Untitled")), "author": F.coalesce("author", F.lit("Unknown Author")), "language": F.coalesce("language", F.lit("en"))})
