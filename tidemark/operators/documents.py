"""Documents as relations: catalog, sections, intervals, chunks, batches, runs."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import citations as C
from tidemark.functions import text as T


def catalog(chapters: DataFrame, preview_words: int = 40) -> DataFrame:
    """(book_id, chapter_index, word_count, preview, is_contents) of every chapter."""
    return chapters.select("book_id", "chapter_index", T.word_count(F.col("text")).alias("word_count"), T.first_words(F.coalesce("text", F.lit("")), preview_words).alias("preview"), T.is_contents(F.coalesce("chapter_title", F.lit("")), F.coalesce("text", F.lit(""))).alias("is_contents"))


def apply_decisions(chapters: DataFrame, decisions: DataFrame, limit: int | None = None) -> DataFrame:
    """Chapters whose decision keeps them (none: dropped), the first ``limit`` of each book."""
    kept = chapters.join(decisions, ["book_id", "chapter_index"], "left").where(F.coalesce("keep", F.lit(False)))
    if limit is None:
        return kept
    return kept.withColumn("n", F.row_number().over(Window.partitionBy("book_id").orderBy("chapter_index"))).where(F.col("n") <= limit).drop("n")


def renumber(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """Dense numbers from 0 within a group, in order."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def cap(rows: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """The first rows of each group."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("n") <= most).drop("n")


def page_ranges(outline: DataFrame, key: str, page: str, pages: str) -> DataFrame:
    """Outline entries as intervals: each ends the page before the next begins, the last with the document."""
    following = F.lead(page).over(Window.partitionBy(key).orderBy(page))
    return outline.withColumn("end_page", F.greatest(F.col(page), F.coalesce(following, F.col(pages)) - 1))


def merge_text(rows: DataFrame, by: list[str], order: str, text: str, joint: str = "\n\n") -> DataFrame:
    """Texts of a group put together in order."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return rows.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda x: x.t), joint).alias(text))


def unique_slugs(rows: DataFrame, by: str, order: str, title: str) -> DataFrame:
    """A slug for each title, _2, _3 ... for repeats; a number that meets another title's own slug moves on
    behind every number in use."""
    base = rows.withColumn("base", _slug(F.col(title)))
    n = F.row_number().over(Window.partitionBy(by, "base").orderBy(order))
    numbered = base.withColumn("n", n).withColumn("slug", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("_", "base", "n")))
    clash = F.row_number().over(Window.partitionBy(by, "slug").orderBy("n", order))
    again = numbered.withColumn("clash", clash).withColumn("most", F.max("n").over(Window.partitionBy(by, "base")))
    return again.withColumn("slug", F.when(F.col("clash") == 1, F.col("slug")).otherwise(F.concat_ws("_", "base", F.col("most") + F.col("n")))).drop("base", "n", "clash", "most")


def _slug(title: Column) -> Column:
    from tidemark.functions.units import slug

    return slug(title)


def drop_references(lines: DataFrame, by: list[str], order: str, text: str) -> DataFrame:
    """Lines without those from a references heading up to a heading that resumes the book."""
    mark = F.when(C.opens_references_column(F.col(text)), 1).when(C.resumes_column(F.col(text)), 0)
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("skip", F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit(0))).where("skip = 0").drop("skip")


def text_lines(docs: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, pos, line) of every line."""
    return docs.select(*key, F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("pos", "line"))


def markdown_sections(lines: DataFrame, key: list[str], least_words: int = 30) -> DataFrame:
    """Sections of Markdown lines: (key, section, title, text); headings in code fences are text, short
    sections drop out; what precedes the first heading has title NULL, and so has the whole text, section 0, of a
    document all of whose sections are short."""
    w = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.trim("line").startswith("```").cast("int")
    fenced = lines.withColumn("open", F.sum(fence).over(w) % 2)
    heading = F.when((F.col("open") == 0) & (fence == 0), F.nullif(F.regexp_extract("line", r"^#{1,6}\s+(.+?)(?:\s+#+)?\s*$", 1), F.lit("")))
    marked = fenced.withColumn("heading", heading).withColumn("section", F.count("heading").over(w))
    groups = marked.groupBy(*key, "section").agg(F.max("heading").alias("title"), F.array_sort(F.collect_list(F.struct("pos", "line", F.col("heading").isNull().alias("body")))).alias("l"))
    plain = lambda rows: T.markdown_to_text(F.array_join(F.transform(rows, lambda x: x.line), "\n"))
    each = groups.select(*key, "section", "title", plain(F.filter("l", lambda x: x.body)).alias("text"), "l")
    long = F.when(T.word_count(F.col("text")) >= least_words, F.struct("section", "title", "text"))
    lines_of = F.when(F.max(long.isNotNull()).over(Window.partitionBy(*key)), F.array().cast("array<struct<pos:int,line:string,body:boolean>>")).otherwise(F.col("l"))
    docs = each.select(*key, long.alias("s"), lines_of.alias("l")).groupBy(*key).agg(F.array_sort(F.collect_list("s")).alias("s"), F.array_sort(F.flatten(F.collect_list("l"))).alias("l"))
    whole = F.struct(F.lit(0).cast("long").alias("section"), F.lit(None).cast("string").alias("title"), plain("l").alias("text"))
    found = docs.select(*key, F.explode(F.when(F.size("s") > 0, F.col("s")).otherwise(F.array(whole))).alias("s"))
    return found.select(*key, "s.section", "s.title", "s.text").where(T.word_count(F.col("text")) >= least_words)


_HEADER = r"^\s*(.+?)\s+\|?\s*\d{1,4}\s*$"


def running_headers(lines: DataFrame, doc: str, least: int = 2) -> DataFrame:
    """(doc, stem): short lines of three words and more that end in a page number on several pages."""
    body = F.trim(F.regexp_extract("line", _HEADER, 1))
    stems = lines.select(doc, F.lower(body).alias("stem")).where("stem <> '' AND NOT contains(stem, '.') AND length(stem) <= 80").where(T.word_count(F.col("stem")) >= 3)
    return stems.groupBy(doc, "stem").agg(F.count("*").alias("times")).where(F.col("times") >= least)


def without_reference_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks without those from a heading of references on, up to a heading that resumes the chapter."""
    mark = F.when(F.col("kind") == "heading", F.when(C.opens_references_column(F.col("text")), 1).when(C.resumes_column(F.col("text")), 0))
    w = Window.partitionBy("book_id", "chapter_index").orderBy("block_pos").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("_skip", F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit(0))).where("_skip = 0").drop("_skip")


def number_sections(blocks: DataFrame, clean: bool = True) -> DataFrame:
    """Clean sections of the blocks, numbered in each chapter: reference sections are skipped, tables count as
    paragraphs, blank ones drop out, copies of a block count once.  Without ``clean`` texts stay as they are."""
    once = without_reference_blocks(blocks.where("text IS NOT NULL").dropDuplicates(["book_id", "chapter_index", "block_pos"]))
    tidy = once.withColumn("text", T.clean_text(F.col("text"))) if clean else once
    kind = F.when(F.col("kind") == "footnote", "footnote").otherwise("body")
    rows = tidy.where("trim(text) <> ''").select("book_id", "chapter_index", "block_pos", kind.alias("kind"), "text", "note_number", "block_id", "parent_id")
    hashed = rows.withColumn("text_hash", F.sha2(F.col("text").cast("binary"), 256))
    return renumber(hashed, ["book_id", "chapter_index"], ["block_pos"], "section_index")


def render_blocks(blocks: DataFrame) -> DataFrame:
    """(book_id, chapter_index, text): blocks as text to look at, the notes in a section of their own behind the rest."""
    once = blocks.where("text IS NOT NULL").dropDuplicates(["book_id", "chapter_index", "block_pos"])
    note = F.coalesce(F.col("kind") == "footnote", F.lit(False))
    said = F.when(note & (F.coalesce("note_number", F.lit("")) != ""), F.concat("note_number", F.lit("\n. "), "text")).otherwise(F.trim("text"))
    rows = once.select("book_id", "chapter_index", "block_pos", note.alias("note"), said.alias("said")).where("said <> ''")
    ordered = F.array_sort(F.collect_list(F.struct("block_pos", "note", "said")))
    part = lambda keep, joint: F.array_join(F.transform(F.filter("b", keep), lambda x: x.said), joint)
    each = rows.groupBy("book_id", "chapter_index").agg(ordered.alias("b"))
    body, notes = part(lambda x: ~x.note, "\n\n"), part(lambda x: x.note, "\n")
    return each.select("book_id", "chapter_index", F.concat_ws("\n\n", F.nullif(body, F.lit("")), F.when(notes != "", F.concat(F.lit("Notes\n"), notes))).alias("text"))


def drop_running_headers(lines: DataFrame, doc: str, least: int = 2) -> DataFrame:
    """Lines without the running headers that ``running_headers`` finds; their list is short, a row for each header of a document."""
    found = running_headers(lines, doc, least).select(doc, "stem")
    stem = F.lower(F.trim(F.regexp_extract("line", _HEADER, 1)))
    marked = lines.withColumn("stem", F.nullif(stem, F.lit("")))
    kept = marked.where("stem IS NOT NULL").join(found, [doc, "stem"], "left_anti").select(*lines.columns)
    return kept.unionByName(marked.where("stem IS NULL").select(*lines.columns))


def section_counts(sections: DataFrame) -> DataFrame:
    """(book_id, chapters, sections, words) of every book."""
    return sections.groupBy("book_id").agg(F.countDistinct("chapter_index").alias("chapters"), F.count("*").alias("sections"), F.sum(T.word_count(F.col("text"))).alias("words"))


def select_chapters(chapters: DataFrame, keep: DataFrame | None, cached: DataFrame | None, analyses: DataFrame, decisions: DataFrame, most: int = 60, limit: int | None = None) -> DataFrame:
    """The chapters of each book that are kept, by the first source of decisions that has any for the book.

    Sources in order: chapters named by hand (``keep``), cached decisions, decisions of a model,
    and in books of more than ``most`` sections the opening analyses instead of those.  What
    is plainly a table of contents is dropped unless named by hand; a chapter without a
    decision is dropped.
    """
    key = ["book_id", "chapter_index"]
    sizes = chapters.groupBy("book_id").agg(F.count("*").alias("_n"))
    ranked = lambda df, rank, verdict: df.select(*key, F.lit(rank).alias("_rank"), verdict.alias("keep"))
    sources = [ranked(df.join(sizes, "book_id").where(when), rank, F.col(verdict)) for df, rank, verdict, when in ((decisions, 2, "keep", f"_n <= {most}"), (analyses, 3, "narratively_important", f"_n > {most}"))]
    if cached is not None:
        sources.append(ranked(cached, 1, F.col("keep")))
    if keep is not None:
        sources.append(ranked(keep, 0, F.lit(True)))
    every = reduce(DataFrame.unionByName, sources)
    best = every.withColumn("_best", F.min("_rank").over(Window.partitionBy("book_id"))).where("_rank = _best")
    contents = catalog(chapters).select(*key, "is_contents")
    verdict = best.groupBy(*key).agg(F.max(F.coalesce("keep", F.lit(False))).alias("keep"), F.min("_rank").alias("_rank")).join(contents, key)
    return apply_decisions(chapters, verdict.select(*key, (F.col("keep") & (~F.col("is_contents") | (F.col("_rank") == 0))).alias("keep")), limit)


def further_split(units: DataFrame, text: str, over: int, target: int, by: list[str], order: list[str]) -> DataFrame:
    """Units over the limit as their pieces, which inherit all other columns; numbered anew in each group, never merged."""
    rest = [c for c in units.columns if c not in (text, "chunk_index")]
    rows = split_rows(units.withColumn("_at", F.struct(*order)), text, over, target, [*rest, "_at"])
    return renumber(rows, by, ["_at", "part"], "chunk_index").drop("_at", "part")


def speak_units(units: DataFrame, text: str, over: int, target: int, by: list[str], order: list[str]) -> DataFrame:
    """``further_split`` with white space as single spaces and blank units dropped before they are numbered."""
    return further_split(units.withColumn(text, T.speak(F.col(text))).where(f"{text} <> ''"), text, over, target, by, order)


def linked_windows(blocks: DataFrame) -> DataFrame:
    """One window for each block that is no linked note: its text and, in order, the texts of the notes whose
    parent it is; a note without a parent in its chapter is a window of its own."""
    once = blocks.where("text IS NOT NULL").dropDuplicates(["book_id", "chapter_index", "block_pos"])
    key = ["book_id", "chapter_index"]
    heads = once.where("kind <> 'footnote' OR kind IS NULL").select(*key, "block_pos", "block_id", "text")
    notes = once.where("kind = 'footnote'").select(*key, F.col("block_pos").alias("note_pos"), "parent_id", F.col("text").alias("note"))
    parents = heads.groupBy(*key, "block_id").agg(F.min("block_pos").alias("block_pos"))
    placed = notes.join(parents, [notes.book_id == parents.book_id, notes.chapter_index == parents.chapter_index, notes.parent_id == parents.block_id], "left").select(notes.book_id, notes.chapter_index, "note_pos", "note", parents.block_pos)
    own = placed.where("block_pos IS NOT NULL").groupBy(*key, "block_pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("note_pos", "note"))), lambda x: x.note).alias("notes"))
    linked = heads.join(own, [*key, "block_pos"], "left").select(*key, "block_pos", "text", F.coalesce("notes", F.array().cast("array<string>")).alias("notes"))
    orphans = placed.where("block_pos IS NULL").select(*key, F.col("note_pos").alias("block_pos"), F.col("note").alias("text"), F.array().cast("array<string>").alias("notes"))
    return linked.unionByName(orphans)


_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+(?=[\"'“‘«(\[]*[^\W\da-z_])")


def sentences(text: str) -> list[str]:
    """Sentences by a rule: an end mark, white space, and a beginning that is no lower-case letter or digit."""
    out, at = [], 0
    for m in _SENTENCE.finditer(text):
        out.append(text[at : m.end()].strip())
        at = m.end()
    return [s for s in [*out, text[at:].strip()] if s]


def pack_words(text: str, limit: int) -> list[str]:
    """Whole sentences up to ``limit`` words; a longer one is cut and its rest begins the next piece."""
    pieces: list[list[str]] = [[]]
    for sentence in sentences(text):
        tokens = sentence.split()
        if len(tokens) > limit or len(pieces[-1]) + len(tokens) > limit:
            pieces.append([])
        while len(tokens) > limit:
            pieces[-1] = tokens[:limit]
            tokens = tokens[limit:]
            pieces.append([])
        pieces[-1] += tokens
    return [" ".join(p) for p in pieces if p]


def cut_long(sentence: str, most: int) -> list[str]:
    """A sentence over ``most`` characters at ; : and dashes, else at commas, else between words; a word never."""
    if len(sentence) <= most:
        return [sentence]
    for pattern in (r"(?<=[;:—])\s+", r"(?<=,)\s+", r"\s+"):
        parts = [p for p in re.split(pattern, sentence) if p.strip()]
        if len(parts) > 1:
            break
    else:
        return [sentence]
    out: list[str] = []
    for part in parts:
        if out and len(out[-1]) + 1 + len(part) <= most:
            out[-1] += " " + part
        else:
            out.append(part)
    return [q for p in out for q in (cut_long(p, most) if len(p) > most and p != sentence else [p])]


def pack_chars(text: str, target: int = 400, most: int = 800) -> list[str]:
    """Sentences toward ``target`` characters, never over ``most``; one may pass the target if it fits."""
    target = min(target, most) if target > 0 else most
    out: list[str] = []
    closed = True
    for piece in (p for s in sentences(text) for p in cut_long(s, most)):
        joined = len(out[-1]) + 1 + len(piece) if out and not closed else None
        if joined is not None and joined <= target:
            out[-1] += " " + piece
        elif joined is not None and joined <= most and len(out[-1]) < target:
            out[-1] += " " + piece
            closed = True
            continue
        else:
            out.append(piece)
        closed = len(out[-1]) >= target
    return out


def split_rows(rows: DataFrame, text: str, over: int, target: int, keep: list[str]) -> DataFrame:
    """Rows over ``over`` characters as their pieces, others as they are; only long texts reach Python."""

    @F.pandas_udf("array<string>")
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: pack_chars(t, target, over) if t else [])

    long = rows.where(F.length(text) > over).select(*keep, F.posexplode(pieces(text)).alias("part", text))
    short = rows.where(F.coalesce(F.length(text) <= over, F.lit(False))).select(*keep, F.lit(0).alias("part"), text)
    return short.unionByName(long).where(F.trim(text) != "")


def batches(units: DataFrame, by: list[str], order: str, size: Column, max_chars: int = 0, max_items: int = 0, budget: int = 0, overhead: int = 0) -> DataFrame:
    """(…, batch): units of a group sorted by size, longest first, in greedy batches within all limits; 0 is no limit.

    A batch of one always fits.  The state resets at every cut, so it is a fold over the
    sorted array of a group; groups are books, not the corpus.
    """
    start = F.struct(F.lit(-1).alias("batch"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("longest"), F.array().cast("array<int>").alias("out"))
    ordered = F.array_sort(F.collect_list(F.struct((-size.cast("long")).alias("neg"), F.col(order).alias("o"), F.struct(*[F.col(c) for c in units.columns]).alias("row"))))

    def step(a: Column, x: Column) -> Column:
        length = -x.neg
        n, total = a.n + 1, a.total + length
        fits = (a.n > 0) & ((F.lit(max_chars) <= 0) | (total <= max_chars)) & ((F.lit(max_items) <= 0) | (n <= max_items)) & ((F.lit(budget) <= 0) | (n * (a.longest + overhead) <= budget))
        batch = F.when(fits, a.batch).otherwise(a.batch + 1)
        return F.struct(batch.alias("batch"), F.when(fits, n).otherwise(F.lit(1)).alias("n"), F.when(fits, total).otherwise(length).alias("total"), F.when(fits, a.longest).otherwise(length).alias("longest"), F.concat(a.out, F.array(batch)).alias("out"))

    grouped = units.groupBy(*by).agg(ordered.alias("units"))
    folded = grouped.select("units", F.aggregate("units", start, step).out.alias("batch"))
    return folded.select(F.explode(F.arrays_zip(F.col("units.row").alias("row"), F.col("batch").alias("batch"))).alias("z")).select("z.row.*", "z.batch")


def fit_capacity(points: DataFrame, safety: float = 0.9) -> DataFrame:
    """(budget, overhead) of a capacity model n * (length + overhead) over measured (length, n): the overhead of
    0, 25 ... 800 with the least relative spread, the smaller on ties; (2800, 0) without points over one."""
    grid = points.where("n > 1").select("length", "n", F.explode(F.sequence(F.lit(0), F.lit(800), F.lit(25))).alias("overhead"))
    scored = grid.withColumn("score", F.col("n") * (F.col("length") + F.col("overhead"))).groupBy("overhead").agg((F.stddev_pop("score") / F.avg("score")).alias("spread"), F.floor(F.min("score") * safety).alias("budget"))
    best = scored.agg(F.min_by(F.struct("budget", "overhead"), F.struct(F.round("spread", 12), F.col("overhead"))).alias("b"))
    return best.select(F.coalesce("b.budget", F.lit(2800)).alias("budget"), F.coalesce("b.overhead", F.lit(0)).alias("overhead"))


def run_summary(book_runs: DataFrame) -> DataFrame:
    """(run_id, ok, skipped, failed, running, total_seconds): last lines of each book of a run, by status."""
    from tidemark.operators.incremental import canonical_path, status_word

    last = book_runs.groupBy("run_id", canonical_path(F.col("source_path")).alias("path")).agg(F.max(F.struct("logged_at", "started_at", status_word(F.col("status")).alias("status"), "total_seconds")).alias("l"))
    counts = [F.count_if(F.col("l.status") == s).alias(s) for s in ("ok", "skipped", "failed", "running")]
    return last.groupBy("run_id").agg(*counts, F.round(F.sum("l.total_seconds"), 4).alias("total_seconds"))


def stage_seconds(book_runs: DataFrame) -> DataFrame:
    """(source_path, stage, seconds) summed over the distinct lines of the ledger, paths in one spelling."""
    from tidemark.operators.incremental import canonical_path

    lines = book_runs.select("run_id", canonical_path(F.col("source_path")).alias("source_path"), "logged_at", F.explode("durations").alias("stage", "seconds")).distinct()
    return lines.groupBy("source_path", "stage").agg(F.round(F.sum("seconds"), 4).alias("seconds"))


def stale(rows: DataFrame, cache: DataFrame, key: list[str], text: str) -> DataFrame:
    """Rows whose cached entry is missing or was made from another text: the work to do."""
    hashed = rows.withColumn("hash", F.sha2(F.col(text).cast("binary"), 256))
    return hashed.join(cache.select(*key, F.col("hash")), [*key, "hash"], "left_anti")


def prefer_notes(notes: DataFrame, key: list[str], body: str, order: str) -> DataFrame:
    """Of notes under one key the best body: prose before mere citation, then the longer, then the earlier."""
    rank = F.struct((~C.citation_only_column(F.col(body))).alias("prose"), F.length(body).alias("n"), (-F.col(order)).alias("o"))
    return notes.groupBy(*key).agg(F.max_by(body, rank).alias(body))


def document_hash(sections: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """One fingerprint of the ordered section hashes of a document."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("h"))))
    return sections.groupBy(*by).agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x.h), ""), 256).alias("fingerprint"))
