"""Splitting oversized items at natural boundaries (problem 3) by agglomerative merging.

Atomic segments are sentences, lines and paragraphs, and words or characters where one of
those alone is over the limit.  Adjacent segments are merged, weakest boundary first, for as
long as the merged piece and its overlap fit; what stays apart is parted at the strongest
boundaries the limit allows.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.tables import small

#: Strength of the boundary at the end of a segment.
PARAGRAPH, LINE, SENTENCE, CLAUSE, SPACE, FORCED = 5, 4, 3, 2, 1, 0
_ATOM = re.compile(r"(\s*\n\s*\n\s*)|(\s*\n\s*)|((?<=[.!?…])[\"'”’»)\]]*\s+|(?<=[。！？]))|((?<=[,;:])\s+)|(\s+)")
_LEVEL = (PARAGRAPH, LINE, SENTENCE, CLAUSE, SPACE)


def _atoms(text: str, room: int, least: int = SENTENCE) -> list[tuple[int, int, int]]:
    """(start, end, strength of the boundary at the end); white space belongs to the segment before it."""
    out, at = [], 0

    def add(start: int, end: int, strength: int) -> None:
        if end - start <= room:
            out.append((start, end, strength))
            return
        inner, s = [], start  # too long by itself: its words, and cuts within a word as the last resort
        for m in _ATOM.finditer(text, start, end):
            if m.end() > s and m.end() < end:
                inner.append((s, m.end(), _LEVEL[m.lastindex - 1]))
                s = m.end()
        inner.append((s, end, strength))
        for a, b, k in inner:
            while b - a > room:
                cut = a + room  # within a run without white space, or within white space
                out.append((a, cut, SPACE if text[cut - 1].isspace() or text[cut].isspace() else FORCED))
                a = cut
            out.append((a, b, k))

    for m in _ATOM.finditer(text):
        strength = _LEVEL[m.lastindex - 1]
        if strength >= least and m.end() > at:
            add(at, m.end(), strength)
            at = m.end()
    if at < len(text):
        add(at, len(text), PARAGRAPH)
    return out


def longest_run(text: str, atoms: list[tuple[int, int, int]]) -> int:
    """Code points of the longest run without white space that was cut, by the chains of atoms with forced cuts between them."""
    most, begin = 0, None
    for start, end, strength in atoms:
        begin = start if begin is None else begin
        if strength != FORCED:
            if start > begin:
                most = max(most, len(text[begin:end].rstrip()))
            begin = None
    return most


def room_for(limit: int, overlap: int) -> int:
    """Code points of an atom at most, so that it fits behind the overlap."""
    return max(1, limit - max(0, min(overlap, limit // 2)))


def cut_kind(text: str, limit: int, atoms: list[tuple[int, int, int]]) -> str:
    """``forced`` when the text holds a run without white space longer than the limit, else ``natural``."""
    return "forced" if longest_run(text, atoms) > limit else "natural"


def split_text(text: str, limit: int, overlap: int, atoms: list[tuple[int, int, int]] | None = None) -> list[tuple[int, int, bool]]:
    """(start, end, forced) of the pieces of a text over the limit.

    A piece begins ``overlap`` code points before the end of the one before it (or at 0),
    none is longer than ``limit``, together they cover the text.  ``forced`` tells that the
    piece ends inside a run without white space.  An overlap of at least the limit is cut
    to half of it.
    """
    overlap = max(0, min(overlap, limit // 2))
    if len(text) <= limit:
        return [(0, len(text), False)]
    atoms = _atoms(text, room_for(limit, overlap)) if atoms is None else atoms
    n = len(atoms)
    start, end = [a[0] for a in atoms], [a[1] for a in atoms]
    strength = [a[2] for a in atoms]
    left, right, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap = [(strength[i], end[i + 1] - start[i], i) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        k, size, i = heapq.heappop(heap)
        if not alive[i] or right[i] >= n:
            continue
        j = right[i]
        if k != strength[i] or size != end[j] - start[i]:
            continue  # another entry has the pair as it is now
        if size + (overlap if start[i] else 0) > limit:
            continue
        end[i], strength[i], alive[j] = end[j], strength[j], False
        right[i] = right[j]
        if right[j] < n:
            left[right[j]] = i
            heapq.heappush(heap, (strength[i], end[right[i]] - start[i], i))
        if left[i] >= 0:
            p = left[i]
            heapq.heappush(heap, (strength[p], end[i] - start[p], p))
    return [(max(0, start[i] - overlap) if start[i] else 0, end[i], strength[i] == FORCED) for i in range(n) if alive[i]]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys = ("item_kind", "book_id", "chapter_index", "chunk_index")
    names = [*keys, "piece", "n_pieces", "start", "end", "forced", "cut", "text"]
    for b in batches:
        d = b.to_pydict()
        rows: list[tuple] = []
        for i, text in enumerate(d["text"]):
            key, limit = tuple(d[k][i] for k in keys), d["max_chars"][i]
            overlap = d["overlap_chars"][i] or 0
            atoms = _atoms(text, room_for(limit, overlap))
            parts, cut = split_text(text, limit, overlap, atoms), cut_kind(text, limit, atoms)
            rows += [(*key, n, len(parts), s, e, forced, cut, text[s:e]) for n, (s, e, forced) in enumerate(parts)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)] if rows else [pa.array([], f.type) for f in _SCHEMA], names)


_SCHEMA = pa.schema([("item_kind", pa.string()), ("book_id", pa.int64()), ("chapter_index", pa.int32()), ("chunk_index", pa.int32()), ("piece", pa.int32()), ("n_pieces", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("forced", pa.bool_()), ("cut", pa.string()), ("text", pa.string())])
_DDL = "item_kind string, book_id bigint, chapter_index int, chunk_index int, piece int, n_pieces int, start int, end int, forced boolean, cut string, text string"


def _kind(source_kind: str) -> Column:
    return F.coalesce(F.lower(F.trim(source_kind)), F.lit("ebook"))


def oversized(chapters: DataFrame, chunks: DataFrame, books: DataFrame, size_limits: DataFrame) -> DataFrame:
    """The items over the limit of their kind, with text and limit.

    Texts at or under the least limit of all never meet a join, NULL texts are no items,
    exact copies of a chunk count once.  A kind of source without a limit has none.
    """
    limits = size_limits.groupBy("item_kind", _kind("source_kind").alias("source_kind")).agg(F.min("max_chars").alias("max_chars"), F.min("overlap_chars").alias("overlap_chars"))
    least = size_limits.agg(F.min("max_chars")).first()[0]  # a table of fixed length
    book_kind = books.groupBy("book_id").agg(F.min(_kind("source_kind")).alias("source_kind"))
    n = F.length("text").alias("n")
    long = lambda df: df.select("*", n).where(F.col("n") > F.lit(least))
    chapter = long(chapters.select(F.lit("chapter").alias("item_kind"), "book_id", "chapter_index", F.lit(-1).alias("chunk_index"), "text"))
    chapter = chapter.join(small(book_kind), "book_id", "left").withColumn("source_kind", _kind("source_kind"))
    chunk = long(chunks.select(F.lit("chunk").alias("item_kind"), "book_id", "chapter_index", "chunk_index", "text", _kind("source_kind").alias("source_kind")))
    items = chapter.unionByName(chunk).join(small(limits), ["item_kind", "source_kind"]).where("n > max_chars")
    keys = ["item_kind", "book_id", "chapter_index", "chunk_index"]
    return items.groupBy(*keys).agg(F.max(F.struct("n", "max_chars", "overlap_chars", "text")).alias("v")).select(*keys, "v.*")


def split_items(chapters: DataFrame, chunks: DataFrame, books: DataFrame, size_limits: DataFrame) -> DataFrame:
    """The pieces of every oversized item, in order: item key, piece, n_pieces, start, end (code
    points in the item's text), forced (this piece ends inside a run without white space),
    cut (of the item: ``forced`` when such a run is longer than the limit), text."""
    items = oversized(chapters, chunks, books, size_limits)
    return items.select("item_kind", "book_id", "chapter_index", "chunk_index", "max_chars", "overlap_chars", "text").mapInArrow(_pieces, _DDL)


def oversized_items(chapters: DataFrame, chunks: DataFrame, books: DataFrame, size_limits: DataFrame) -> DataFrame:
    """One row for each split item with its kind of cut (query p3_found)."""
    pieces = split_items(chapters, chunks, books, size_limits)
    return pieces.where("piece = 0").select("item_kind", "book_id", "chapter_index", "chunk_index", "cut")
