"""Readers by file suffix: Markdown, HTML, e-book archives and link files become chapters; JSON lines and ledgers rows."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.units import slug
from tidemark.operators.documents import markdown_sections, text_lines

#: Sections of fewer words are no chapters.
LEAST_WORDS = 30
CHAPTER = "path string, section int, title string, text string"
# Page furniture, and elements that part lines.
_CHROME = frozenset("script style nav header footer aside form noscript iframe svg button".split())
_BLOCKS = frozenset("p div section article main li ul ol table tr blockquote pre figure h3 h4 h5 h6 br hr dd dt".split())

_READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(*suffixes: str) -> Callable:
    """Register a reader for file suffixes; the last one registered wins."""

    def add(reader: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        _READERS.update({s.lower(): reader for s in suffixes})
        return reader

    return add


def suffixes() -> list[str]:
    return sorted(_READERS)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, section, title, text) of all files under a folder that a reader is registered for; an error if there is none."""
    known = [_files(spark, path, f"*{s}").select("path").limit(1) for s in suffixes()]
    if reduce(DataFrame.unionByName, known).isEmpty():
        raise FileNotFoundError(f"no file with one of {', '.join(suffixes())} under {path}")
    parts = [reader(spark, path) for reader in dict.fromkeys(_READERS.values())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)


@register(".md", ".markdown")
def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Sections by headings outside code fences; the words before the first heading are a section named for the file."""
    files = _files(spark, path, "*.{md,markdown}").select("path", F.decode("content", "UTF-8").alias("text"))
    sections = markdown_sections(text_lines(files, ["path"]), ["path"], LEAST_WORDS)
    stem = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    named = F.coalesce("title", F.initcap(F.regexp_replace(stem, "[_-]+", " ")))
    return sections.select("path", F.col("section").cast("int").alias("section"), named.alias("title"), "text")


class _Page(HTMLParser):
    """The lines of a page without its furniture, first- and second-level headings apart."""

    def __init__(self, whole: str) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.lines, self.skip, self.in_title = "", [["", ""]], 0, False
        self.inside = 0
        self.root = next((t for t in ("article", "main") if re.search(rf"<{t}\b", whole, re.I)), None)
        self.feed(whole)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _CHROME:
            self.skip += 1
        elif tag == "title":
            self.in_title = True
        elif tag == self.root:
            self.inside += 1
        elif tag in ("h1", "h2"):
            self.lines.append(["h", ""])
        elif tag in _BLOCKS:
            self.lines.append(["", ""])

    def handle_endtag(self, tag: str) -> None:
        if tag in _CHROME:
            self.skip = max(0, self.skip - 1)
        elif tag == "title":
            self.in_title = False
        elif tag == self.root:
            self.inside = max(0, self.inside - 1)
        elif tag in ("h1", "h2") or tag in _BLOCKS:
            self.lines.append(["", ""])

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        elif not self.skip and (self.root is None or self.inside):
            self.lines[-1][1] += data


def page_sections(html: str) -> tuple[str, list[tuple[str, str]]]:
    """Title of a page and its (heading, text) sections; of article and main the first that is there is read."""
    page = _Page(html)
    out: list[tuple[str, list[str]]] = [("", [])]
    for kind, line in page.lines:
        plain = " ".join(line.split())
        if plain and kind == "h":
            out.append((plain, []))
        elif plain:
            out[-1][1].append(plain)
    return " ".join(page.title.split()), [(h, "\n".join(ls)) for h, ls in out if ls]


def _html_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for path, content in zip(b["path"], b["content"], strict=True):
            title, found = page_sections(bytes(content).decode("utf-8", "replace"))
            kept = [(h or title, t) for h, t in found if len(t.split()) >= LEAST_WORDS] or ([(title, "\n".join(t for _, t in found))] if found else [])
            rows += [(path, i, h, t) for i, (h, t) in enumerate(kept)]
        yield pd.DataFrame(rows, columns=["path", "section", "title", "text"])


@register(".html", ".htm")
def read_html(spark: SparkSession, path: str) -> DataFrame:
    """Sections of pages by first- and second-level headings, page furniture left out."""
    return _files(spark, path, "*.{html,htm}").select("path", "content").mapInPandas(_html_rows, CHAPTER)


def _local(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


class Archive:
    """An e-book archive: its package, spine, table of contents and metadata."""

    def __init__(self, content: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        container = ElementTree.fromstring(self.zip.read("META-INF/container.xml"))
        opf = next(e.get("full-path") for e in container.iter() if _local(e) == "rootfile")
        self.base = opf.rsplit("/", 1)[0] + "/" if "/" in opf else ""
        self.package = ElementTree.fromstring(self.zip.read(opf))
        self.items = {e.get("id"): e for e in self.package.iter() if _local(e) == "item"}

    def read(self, href: str) -> bytes:
        return self.zip.read(posixpath.normpath(self.base + unquote(href.split("#")[0])))

    def _entries(self) -> Iterator[tuple[str, str]]:
        """(href, title) of the table of contents, of the older format and of the navigation document."""
        for item in self.items.values():
            href, kind = item.get("href") or "", item.get("media-type") or ""
            if kind.endswith("dtbncx+xml"):
                for point in (e for e in ElementTree.fromstring(self.read(href)).iter() if _local(e) == "navPoint"):
                    src = next((e.get("src") for e in point if _local(e) == "content"), "")
                    yield src or "", next((e.text for e in point.iter() if _local(e) == "text" and e.text), "")
            elif "nav" in (item.get("properties") or "").split():
                folder = posixpath.dirname(unquote(href))
                for link in (e for e in ElementTree.fromstring(self.read(href)).iter() if _local(e) == "a" and e.get("href")):
                    yield posixpath.join(folder, link.get("href")), "".join(link.itertext())

    def titles(self) -> dict[str, str]:
        """Title of each document by its path and by its bare name; the first entry counts."""
        out: dict[str, str] = {}
        for href, title in self._entries():
            key, plain = posixpath.normpath(unquote(href.split("#")[0])).lstrip("/"), " ".join(title.split())
            if plain and key not in ("", "."):
                out.setdefault(key, plain)
                out.setdefault(posixpath.basename(key), plain)
        return out

    def sections(self) -> list[tuple[str, str]]:
        titles, out = self.titles(), []
        for ref in (e.get("idref") for e in self.package.iter() if _local(e) == "itemref"):
            if ref not in self.items:
                continue
            href = posixpath.normpath(unquote(self.items[ref].get("href") or ""))
            title, found = page_sections(self.read(self.items[ref].get("href") or "").decode("utf-8", "replace"))
            text = "\n".join(t for _, t in found)
            if len(text.split()) >= LEAST_WORDS:
                out.append((titles.get(href) or titles.get(posixpath.basename(href)) or title or posixpath.splitext(posixpath.basename(href))[0], text))
        return out

    def metadata(self) -> tuple[str, str, str, bytes | None]:
        """(title, author, language, cover): a cover by its property or reference, else an image with cover in its name."""
        said = lambda tag, other: next((e.text.strip() for e in self.package.iter() if _local(e) == tag and e.text and e.text.strip()), other)
        named = next((e.get("content") for e in self.package.iter() if _local(e) == "meta" and e.get("name") == "cover"), None)
        images = [e for e in self.items.values() if (e.get("media-type") or "").startswith("image/")]
        marked = [e for e in images if "cover-image" in (e.get("properties") or "").split() or e.get("id") == named]
        cover = next((e.get("href") for e in [*marked, *(e for e in images if "cover" in (e.get("href") or "").lower())]), None)
        return said("title", "Unknown Title"), said("creator", "Unknown Author"), said("language", "en"), self.read(cover) if cover else None


def book_sections(archive: bytes) -> list[tuple[str, str]]:
    """(title, text) of the spine documents of an e-book archive, titles from its table of contents."""
    return Archive(archive).sections()


_BROKEN = (zipfile.BadZipFile, ElementTree.ParseError, KeyError, StopIteration, EOFError, ValueError)


def _book_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows: list[tuple] = []
        for path, content in zip(b["path"], b["content"], strict=True):
            try:
                rows += [(path, i, t, x, None) for i, (t, x) in enumerate(book_sections(bytes(content)))]
            except _BROKEN as e:
                rows.append((path, None, None, None, f"{type(e).__name__}: {e}"))
        yield pd.DataFrame(rows, columns=["path", "section", "title", "text", "error"]).astype({"section": "Int32"})


def read_books_with_errors(spark: SparkSession, path: str) -> DataFrame:
    """Sections of e-book archives in spine order; an archive that cannot be read is one row with its error."""
    return _files(spark, path, "*.epub").select("path", "content").mapInPandas(_book_rows, f"{CHAPTER}, error string")


@register(".epub")
def read_books(spark: SparkSession, path: str) -> DataFrame:
    """Sections of the e-book archives that can be read, in spine order."""
    return read_books_with_errors(spark, path).where("error IS NULL").drop("error")


METADATA = "path string, title string, author string, language string, slug string, cover binary"


def _metadata(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for path, content in zip(b["path"], b["content"], strict=True):
            stem, suffix = posixpath.splitext(posixpath.basename(unquote(path)))
            named = re.sub(r"[\s_-]+", " ", stem).strip().title() or "Untitled"
            title, author, language, cover = named, "Unknown Author", "en", None
            text = "" if suffix.lower() == ".epub" else bytes(content).decode("utf-8", "replace")
            if suffix.lower() == ".epub":
                try:
                    title, author, language, cover = Archive(bytes(content)).metadata()
                except _BROKEN:
                    pass
            elif suffix.lower() in (".html", ".htm"):
                page, found = page_sections(text)
                title = page or next((h for h, _ in found if h), named)
            else:
                fenced = False
                for line in text.splitlines():
                    fenced ^= line.strip().startswith("```")
                    if not fenced and line.startswith("# ") and line[2:].strip(" #"):
                        title = line[2:].strip(" #")
                        break
            rows.append((path, title, author, language, cover))
        yield pd.DataFrame(rows, columns=["path", "title", "author", "language", "cover"]).assign(slug=None)[["path", "title", "author", "language", "slug", "cover"]]


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, author, language, slug, cover) of all documents: what the file says, else its name and defaults."""
    rows = _files(spark, path, "*.{md,markdown,html,htm,epub}").select("path", "content").mapInPandas(_metadata, METADATA)
    return rows.withColumn("slug", slug(F.col("title")))


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """(path, url, title, cache_key) of link files: the first line that is neither blank nor a comment, and the second."""
    files = _files(spark, path, "*.url").select("path", F.decode("content", "UTF-8").alias("text"))
    lines = F.filter(F.transform(F.split("text", r"\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
    url = F.try_element_at(lines, F.lit(1))
    return files.select("path", url.alias("url"), F.try_element_at(lines, F.lit(2)).alias("title"), F.substring(F.sha2(url.cast("binary"), 256), 1, 24).alias("cache_key"))


@register(".url")
def read_cached_pages(spark: SparkSession, path: str) -> DataFrame:
    """Sections of the pages that link files point to, as far as they lie fetched beside them under their cache key."""
    pages = _files(spark, path, "*.page").select(F.regexp_extract("path", r"([0-9a-f]{24})[.]page$", 1).alias("cache_key"), "content")
    linked = read_links(spark, path).select("path", "cache_key", "title").join(pages, "cache_key")
    sections = linked.select("path", "content").mapInPandas(_html_rows, CHAPTER)
    named = linked.select(F.col("path").alias("_path"), F.col("title").alias("_title"))
    return sections.join(named, F.col("path") == F.col("_path")).select("path", "section", F.coalesce(F.nullif("title", F.lit("")), "_title").alias("title"), "text")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; blank and malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def bad_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The side output of ``read_json_lines``: (line) of what is neither blank nor fits the schema."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    parsed = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.where(parsed["_bad"].isNotNull() | parsed.isNull()).select(F.col("value").alias("line"))


def append_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)
