"""Outlines of paged documents: choosing a depth, merging groups, sections of pages; marks of audio chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.documents import page_ranges
from tidemark.tables import small

CHAPTER_LIKE, INDEX_LETTER = r"(?i)^\s*(?:chapter|part|book)\b|^\s*\d+[.:)\s]", r"^\s*[A-Z]\s*$"


def best_depth(outline: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, depth): depth 1 if it has two chapter-like titles, else the depth with most of them, then with fewest
    single letters, then the least; only depths 0 to 3 with titled entries count."""
    counted = outline.where("depth BETWEEN 0 AND 3 AND trim(title) <> ''").groupBy(doc, "depth").agg(F.count_if(F.col("title").rlike(CHAPTER_LIKE)).alias("c"), F.count_if(F.col("title").rlike(INDEX_LETTER)).alias("l"))
    rank = F.struct(((F.col("depth") == 1) & (F.col("c") >= 2)).alias("one"), F.col("c"), -F.col("l"), -F.col("depth"))
    return counted.groupBy(doc).agg(F.max_by("depth", rank).alias("depth"))


def merge_outlines(entries: DataFrame, doc: str, page: str, order: list[str]) -> DataFrame:
    """One entry for each page of a document: the first in order."""
    n = F.row_number().over(Window.partitionBy(doc, page).orderBy(*order))
    return entries.withColumn("n", n).where("n = 1").drop("n")


def outline_sections(outline: DataFrame, pages: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, title, page, text): the pages of each entry put together; a page is joined by its entry's interval,
    found by a running maximum and not by a range join."""
    marks = pages.select(doc, "page", F.lit(None).cast("string").alias("title"), "text", F.lit(1).alias("o")).unionByName(outline.select(doc, "page", "title", F.lit(None).cast("string").alias("text"), F.lit(0).alias("o")))
    w = Window.partitionBy(doc).orderBy("page", "o").rowsBetween(Window.unboundedPreceding, 0)
    held = marks.withColumn("start", F.last(F.when(F.col("o") == 0, F.struct("title", "page")), ignorenulls=True).over(w)).where("o = 1 AND start IS NOT NULL AND text <> ''")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x.text), "\n\n")
    return held.groupBy(doc, "start").agg(text.alias("text")).select(doc, "start.title", "start.page", "text")


def heading_sections(pages: DataFrame, heading: Column, doc: str = "doc") -> DataFrame:
    """(doc, section, title, text): pages from one with a heading to the next, what comes before it left out."""
    w = Window.partitionBy(doc).orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    marked = pages.withColumn("heading", heading).withColumn("section", F.count("heading").over(w)).where("section > 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x.text), "\n\n")
    return marked.groupBy(doc, "section").agg(F.max("heading").alias("title"), text.alias("text"))


def enough_text(pages: DataFrame, doc: str = "doc", least: int = 200) -> DataFrame:
    """Documents with the words a scan without text would lack: one page, or ``least`` words."""
    from tidemark.functions.text import word_count

    sums = pages.groupBy(doc).agg(F.count("*").alias("pages"), F.sum(word_count(F.col("text"))).alias("words"))
    return sums.where((F.col("pages") <= 1) | (F.col("words") >= least))


def chapter_marks(parts: DataFrame, book: str, order: str, duration: str, gap: int = 0) -> DataFrame:
    """Running start and end of chapters; a gap after each but the last."""
    w = Window.partitionBy(book).orderBy(order)
    last = F.lead(order).over(w).isNull()
    length = F.col(duration) + F.when(last, 0).otherwise(gap)
    end = F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return parts.withColumn("length", length).withColumn("end", end).withColumn("start", F.col("end") - F.col("length")).drop("length")


def progress(rows: DataFrame, by: str, order: str, done: Column) -> DataFrame:
    """Completed rows so far and of all in a group."""
    w = Window.partitionBy(by).orderBy(order)
    return rows.withColumn("done", F.count_if(done).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("of", F.count("*").over(Window.partitionBy(by)))


def assign_without_repeat(rows: DataFrame, order: str, pool: DataFrame, name: str, seed: int, by: str = "group") -> DataFrame:
    """Each row of a group one member of a small pool, no member twice before all were used; by a seeded order."""
    shuffled = pool.select(name, (F.row_number().over(Window.orderBy(F.xxhash64(name, F.lit(seed)), name)) - 1).alias("k"))
    size = pool.count()
    turn = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1  # the pool is a short list
    return rows.withColumn("turn", turn).withColumn("k", F.col("turn") % F.lit(max(size, 1))).join(small(shuffled), "k").drop("k", "turn")


__all__ = ["assign_without_repeat", "best_depth", "chapter_marks", "enough_text", "heading_sections", "merge_outlines", "outline_sections", "page_ranges", "progress"]
