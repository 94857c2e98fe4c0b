"""Queries of the document operators, with their SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions import records, units
from tidemark.operators import activities as A
from tidemark.operators import documents as D
from tidemark.operators import notes as N
from tidemark.operators import outline as O
from tidemark.tables import read


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts, previews, contents pages."""
    return D.catalog(read(spark, sf_dir, "chapters"))


def kept_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five chapters of each book that are no contents."""
    chapters = read(spark, sf_dir, "chapters")
    decisions = D.catalog(chapters).select("book_id", "chapter_index", (~F.col("is_contents") & (F.col("word_count") > 0)).alias("keep"))
    return D.apply_decisions(chapters.select("book_id", "chapter_index"), decisions, 5).select("book_id", "chapter_index")


def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs of titles, unique in their book."""
    rows = D.unique_slugs(read(spark, sf_dir, "chapters").select("book_id", "chapter_index", "chapter_title"), "book_id", "chapter_index", "chapter_title")
    return rows.select("book_id", "chapter_index", "slug")


def chapter_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page intervals of chapters, a page for every 300 words."""
    words = D.catalog(read(spark, sf_dir, "chapters")).select("book_id", "chapter_index", F.ceil(F.col("word_count") / 300).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("book_id").orderBy("chapter_index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    outline = words.select("book_id", "chapter_index", (before + 1).alias("page"), F.sum("n").over(Window.partitionBy("book_id")).alias("pages"))
    ranges = D.page_ranges(outline, "book_id", "page", "pages")
    return ranges.groupBy("book_id").agg(F.max("end_page").alias("last_page"), F.count("*").alias("chapters"), F.max("pages").alias("pages"))


def chapter_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of chapters put together from their blocks."""
    blocks = read(spark, sf_dir, "blocks").where("text IS NOT NULL").dropDuplicates(["book_id", "chapter_index", "block_pos"])
    merged = D.merge_text(blocks, ["book_id", "chapter_index"], "block_pos", "text")
    return merged.select("book_id", "chapter_index", F.length("text").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("hash"))


def narration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean-up chains of block texts."""
    rows = read(spark, sf_dir, "blocks").where("text IS NOT NULL").select("book_id", "chapter_index", "block_pos", "text").distinct()
    return rows.select("book_id", "chapter_index", "block_pos", T.narration_text(F.col("text")).alias("text"))


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, abbreviations, sections and symbols of chunks, white space collapsed."""
    rows = read(spark, sf_dir, "chunks").select("book_id", "chapter_index", "chunk_index", "text").distinct()
    return rows.select("book_id", "chapter_index", "chunk_index", T.speak(T.expand_symbols(T.expand_sections(T.expand_abbreviations(T.strip_urls(F.col("text")))))).alias("text"))


def clean_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered clean sections with their hashes."""
    return D.number_sections(read(spark, sf_dir, "blocks")).select("book_id", "chapter_index", "section_index", "kind", "text_hash")


def note_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with the notes linked to them."""
    return D.linked_windows(read(spark, sf_dir, "blocks")).select("book_id", "chapter_index", "block_pos", F.size("notes").alias("n_notes"), F.length("text").alias("n_chars"))


def format_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long sections split toward 400 and up to 800 characters, numbered."""
    blocks = read(spark, sf_dir, "blocks").where("text IS NOT NULL").dropDuplicates(["book_id", "chapter_index", "block_pos"])
    rows = D.split_rows(blocks, "text", 800, 400, ["book_id", "chapter_index", "block_pos"])
    return D.renumber(rows, ["book_id", "chapter_index"], ["block_pos", "part"], "chunk_index").select("book_id", "chapter_index", "chunk_index", "text")


def speak_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy batches of the chunks of a chapter, longest first; a chapter is bounded, a book may not be."""
    rows = read(spark, sf_dir, "chunks").where("text IS NOT NULL").select("book_id", "chapter_index", "chunk_index", F.length("text").alias("n_chars")).distinct()
    return D.batches(rows, ["book_id", "chapter_index"], "chunk_index", F.col("n_chars"), max_chars=3000, max_items=10).select("book_id", "chapter_index", "chunk_index", "batch")


def capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capacity model of measured points."""
    points = read(spark, sf_dir, "part").groupBy((F.col("p_size") * 20).alias("length")).agg(F.count("*").alias("n"))
    return D.fit_capacity(points)


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status counts of runs."""
    return D.run_summary(read(spark, sf_dir, "book_runs"))


def stage_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds of each stage from the map column."""
    return D.stage_seconds(read(spark, sf_dir, "book_runs"))


def stale_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks without a cleaned answer made from their text."""
    key = ["book_id", "chapter_index", "chunk_index"]
    chunks = read(spark, sf_dir, "chunks").where("text IS NOT NULL").select(*key, "text").distinct()
    cache = read(spark, sf_dir, "cleaned_chunks").select(*key, F.sha2(F.col("raw_text").cast("binary"), 256).alias("hash")).distinct()
    return D.stale(chunks, cache, key, "text").select(*key)


def running_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short lines that end in a page number and recur in a book."""
    lines = D.text_lines(read(spark, sf_dir, "blocks").where("text IS NOT NULL").select("book_id", "chapter_index", "block_pos", "text").distinct(), ["book_id", "chapter_index", "block_pos"])
    return D.running_headers(lines, "book_id")


def without_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of chapters left without reference sections."""
    lines = D.text_lines(read(spark, sf_dir, "chapters").where("text IS NOT NULL"), ["book_id", "chapter_index"])
    return D.drop_references(lines, ["book_id", "chapter_index"], "pos", "line").groupBy("book_id", "chapter_index").agg(F.count("*").alias("lines"))


def markdown_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of texts by Markdown headings outside fences."""
    lines = D.text_lines(read(spark, sf_dir, "chapters").where("text IS NOT NULL"), ["book_id", "chapter_index"])
    return D.markdown_sections(lines, ["book_id", "chapter_index"]).select("book_id", "chapter_index", "section", "title", F.length("text").alias("n_chars"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the notes of a number the one with prose, then the longer."""
    rows = read(spark, sf_dir, "blocks").where("kind = 'footnote' AND text IS NOT NULL AND note_number IS NOT NULL")
    return D.prefer_notes(rows, ["book_id", "chapter_index", "note_number"], "text", "block_pos")


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every chapter from its ordered blocks."""
    blocks = read(spark, sf_dir, "blocks").dropDuplicates(["book_id", "chapter_index", "block_pos"])
    return D.document_hash(blocks, ["book_id", "chapter_index"], ["block_pos"])


def book_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind of source from the path's suffix."""
    return read(spark, sf_dir, "books").select("book_id", units.source_kind(F.col("source_path")).alias("kind"))


def plain_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks and notes recovered from the flat text of chapters."""
    return N.document_blocks(read(spark, sf_dir, "chapters")).select("book_id", "chapter_index", "block_pos", "kind", "text", "note_number", "parent_id")


def placed_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X11: chapters with notes put where they are called."""
    rows = read(spark, sf_dir, "chapters").where("text IS NOT NULL")
    return rows.select("book_id", "chapter_index", N.place_notes_udf("text").alias("text"))


def chapter_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running start and end of chapters from their words, a gap after each but the last."""
    rows = D.catalog(read(spark, sf_dir, "chapters")).select("book_id", "chapter_index", (F.col("word_count") * 400).alias("ms"))
    return O.chapter_marks(rows, "book_id", "chapter_index", "ms", 1500).select("book_id", "chapter_index", "start", "end")


def run_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished lines of a run so far, in order of the ledger."""
    rows = read(spark, sf_dir, "book_runs").select("run_id", "source_path", "logged_at", "status").distinct().withColumn("pos", F.struct("logged_at", "source_path", "status"))
    done = F.lower(F.trim("status")) == "ok"
    return O.progress(rows, "run_id", "pos", done).groupBy("run_id").agg(F.max("done").alias("done"), F.sum("done").alias("sum_done"), F.max("of").alias("of"))


def guarded_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """answers kept or replaced by their passage, hints kept or dropped."""
    rows = read(spark, sf_dir, "cleaned_chunks").select("book_id", "chapter_index", "chunk_index", "raw_text", "cleaned_text", "instruct").distinct()
    answer, hint = records.guarded_answer(F.col("raw_text"), F.col("cleaned_text")), records.guarded_hint(F.col("instruct"), F.col("raw_text"))
    return rows.select("book_id", "chapter_index", "chunk_index", F.md5(answer.cast("binary")).alias("answer"), hint.alias("hint"))


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters as text to look at, notes behind."""
    return D.render_blocks(read(spark, sf_dir, "blocks")).select("book_id", "chapter_index", F.md5(F.col("text").cast("binary")).alias("text"))


def section_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11: blocks as numbered sections, reference sections skipped."""
    return D.number_sections(read(spark, sf_dir, "blocks"), clean=False).select("book_id", "chapter_index", "block_pos", "section_index", "kind", "text_hash")


def section_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters, sections and words of books."""
    return D.section_counts(D.number_sections(read(spark, sf_dir, "blocks"), clean=False))


def lines_without_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of books left without running headers."""
    lines = D.text_lines(read(spark, sf_dir, "blocks").where("text IS NOT NULL").select("book_id", "chapter_index", "block_pos", "text").distinct(), ["book_id", "chapter_index", "block_pos"])
    return D.drop_running_headers(lines, "book_id").groupBy("book_id").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("n_chars"))


def note_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Note references of a chapter as one list, in order of its blocks."""
    once = read(spark, sf_dir, "blocks").dropDuplicates(["book_id", "chapter_index", "block_pos"])
    return A.joined_lists(once, ["book_id", "chapter_index"], "block_pos", "note_refs").select("book_id", "chapter_index", F.array_join("note_refs", " ").alias("refs"), F.size("note_refs").alias("n"))


QUERIES = {
    f"ref_{f.__name__}": f
    for f in (catalog, kept_chapters, slugs, chapter_pages, chapter_texts, narration, spoken, clean_sections, note_windows, format_chunks, speak_batches, capacity, run_summary, stage_seconds, stale_chunks, running_headers, without_references, markdown_chapters, notes, fingerprints, book_kinds, plain_blocks, placed_notes, chapter_marks, run_progress, guarded_answers, rendered, section_numbers, section_counts, lines_without_headers, note_lists)
}

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\s\x0b\x{85}\p{Z}]+'), lambda x: x <> '')"
_CATALOG = rf"""WITH w AS (SELECT book_id, chapter_index, coalesce(chapter_title, '') AS t, coalesce(text, '') AS text, {_WORDS} AS ws FROM chapters),
s AS (SELECT *, len(ws) AS n, len(list_filter(ws, lambda x: regexp_matches(x, '\d'))) / greatest(len(ws), 1) AS share, length(text) - length(replace(text, ':', '')) AS colons FROM w),
c AS (SELECT book_id, chapter_index, CAST(n AS INT) AS word_count, array_to_string(ws[1:40], ' ') || CASE WHEN n > 40 THEN '…' ELSE '' END AS preview,
  n <= 500 AND ((regexp_matches(lower(trim(t)), '\b(?:table\s+of\s+)?contents?\b|\btoc\b') AND n < 300) OR (n < 100 AND (share > 0.3 OR (colons >= 3 AND share > 0.2)))) AS is_contents FROM s)
"""
_PATH = r"url_decode(replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(source_path, '^file://', ''), '%20', ' '), '/[^/]+/\.\./', '/', 'g'), '/\./', '/', 'g'), '/+', '/', 'g'), '+', '%2B'))"

_REFS = """('reference', 'references', 'bibliography', 'works cited', 'works consulted', 'literature cited', 'notes and references', 'notes and bibliography', 'citations', 'further reading', 'sources')"""
_ENDS = """('acknowledgment', 'acknowledgments', 'acknowledgement', 'acknowledgements', 'about the author', 'conclusion', 'afterword', 'epilogue', 'glossary', 'index', 'appendix', 'appendices')"""
_HEADING = r"""lower(regexp_replace(trim(trim({0}), E' \t*_"\':.#'), '\s+', ' ', 'g'))"""
_SECTIONS = rf"""WITH b AS (SELECT DISTINCT book_id, chapter_index, block_pos, kind, text, {_HEADING.format("text")} AS h FROM blocks WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY book_id, chapter_index, block_pos ORDER BY text) = 1),
m AS (SELECT *, CASE WHEN kind = 'heading' AND h IN {_REFS} THEN 1 WHEN kind = 'heading' AND (h IN {_ENDS} OR regexp_matches(h, '^(appendix|appendices) [a-z0-9]+$')) THEN 0 END AS k FROM b),
t AS (SELECT *, coalesce(last_value(k IGNORE NULLS) OVER (PARTITION BY book_id, chapter_index ORDER BY block_pos), 0) AS skip FROM m),
s AS (SELECT book_id, chapter_index, block_pos, CASE WHEN kind = 'footnote' THEN 'footnote' ELSE 'body' END AS kind, text FROM t WHERE skip = 0 AND trim(text, ' ') <> '')
"""
_HEADS = r"""WITH b AS (SELECT DISTINCT book_id, chapter_index, block_pos, text FROM blocks WHERE text IS NOT NULL), l AS (SELECT book_id, unnest(string_split_regex(text, '\r\n|\r|\n')) AS line FROM b),
s AS (SELECT book_id, line, lower(trim(regexp_extract(line, '^\s*(.+?)\s+\|?\s*\d{1,4}\s*$', 1))) AS stem FROM l),
r AS (SELECT book_id, stem, count(*) AS times FROM s WHERE stem <> '' AND NOT contains(stem, '.') AND length(stem) <= 80 AND len(list_filter(string_split_regex(stem, '[\s\x0b\x{85}\p{Z}]+'), lambda x: x <> '')) >= 3 GROUP BY ALL HAVING count(*) >= 2)
"""
_MARKS = [("(?s)```.*?```", ""), ("`([^`]+)`", r"\1"), (r"!\[([^\]]*)\]\([^)]+\)", r"\1"), (r"\[([^\]]+)\]\([^)]+\)", r"\1"), (r"(?m)^#{1,6}\s+", ""), (r"\*\*([^*]+)\*\*", r"\1"), (r"\*([^*]+)\*", r"\1"), ("__([^_]+)__", r"\1"), ("_([^_]+)_", r"\1"), (r"(?m)^[-*_]{3,}\s*$", "")]


def _unmarked(text: str) -> str:
    """Markdown marks removed one kind after another, blank lines dropped, in SQL."""
    for pattern, out in _MARKS:
        text = f"regexp_replace({text}, '{pattern}', '{out}', 'g')"
    return rf"array_to_string(list_filter(list_transform(string_split_regex({text}, '\r\n|\r|\n'), lambda x: trim(x, ' ')), lambda x: x <> ''), chr(10))"


ORACLE = {
    "ref_rendered": r"""WITH b AS (SELECT * FROM blocks WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY book_id, chapter_index, block_pos ORDER BY text) = 1),
r AS (SELECT book_id, chapter_index, block_pos, coalesce(kind = 'footnote', false) AS note, CASE WHEN kind = 'footnote' AND coalesce(note_number, '') <> '' THEN note_number || E'\n. ' || text ELSE trim(text, ' ') END AS said FROM b),
t AS (SELECT book_id, chapter_index, string_agg(said, E'\n\n' ORDER BY block_pos) FILTER (NOT note) AS body, string_agg(said, E'\n' ORDER BY block_pos) FILTER (note) AS notes FROM r WHERE said <> '' GROUP BY ALL)
SELECT book_id, chapter_index, md5(concat_ws(E'\n\n', body, E'Notes\n' || notes)) AS text FROM t""",
    "ref_section_numbers": _SECTIONS + "SELECT book_id, chapter_index, block_pos, CAST(row_number() OVER (PARTITION BY book_id, chapter_index ORDER BY block_pos) - 1 AS INT) AS section_index, kind, sha256(text) AS text_hash FROM s",
    "ref_section_counts": _SECTIONS + f"SELECT book_id, count(DISTINCT chapter_index) AS chapters, count(*) AS sections, CAST(sum(len({_WORDS})) AS BIGINT) AS words FROM s GROUP BY book_id",
    "ref_lines_without_headers": _HEADS + "SELECT book_id, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM s LEFT JOIN r USING (book_id, stem) WHERE times IS NULL GROUP BY book_id",
    "ref_note_lists": """WITH b AS (SELECT * FROM blocks QUALIFY row_number() OVER (PARTITION BY book_id, chapter_index, block_pos ORDER BY text) = 1),
f AS (SELECT book_id, chapter_index, flatten(list(coalesce(note_refs, []) ORDER BY block_pos)) AS x FROM b GROUP BY ALL) SELECT book_id, chapter_index, coalesce(array_to_string(x, ' '), '') AS refs, CAST(len(x) AS INT) AS n FROM f""",
    "ref_slugs": r"""WITH b AS (SELECT book_id, chapter_index, coalesce(nullif(regexp_replace(substr(regexp_replace(regexp_replace(lower(trim(chapter_title, ' ')), '[^\p{L}\p{M}\p{Nd}_\s\x0b\x{85}\p{Z}-]', '', 'g'), '[\s\x0b\x{85}\p{Z}_-]+', '_', 'g'), 1, 80), '^_+|_+$', '', 'g'), ''), 'untitled') AS base FROM chapters),
n AS (SELECT *, row_number() OVER (PARTITION BY book_id, base ORDER BY chapter_index) AS n, count(*) OVER (PARTITION BY book_id, base) AS most FROM b),
s AS (SELECT *, CASE WHEN n = 1 THEN base ELSE base || '_' || n END AS slug FROM n),
c AS (SELECT *, row_number() OVER (PARTITION BY book_id, slug ORDER BY n, chapter_index) AS clash FROM s)
SELECT book_id, chapter_index, CASE WHEN clash = 1 THEN slug ELSE base || '_' || (most + n) END AS slug FROM c""",
    "ref_markdown_chapters": rf"""WITH l AS (SELECT book_id, chapter_index, i AS pos, ls[i] AS line FROM (SELECT book_id, chapter_index, string_split_regex(text, '\r\n|\r|\n') AS ls FROM chapters WHERE text IS NOT NULL), unnest(range(1, len(ls) + 1)) AS t(i)),
f AS (SELECT *, starts_with(trim(line, ' '), '```') AS fence FROM l),
o AS (SELECT *, sum(CAST(fence AS INT)) OVER w % 2 AS open FROM f WINDOW w AS (PARTITION BY book_id, chapter_index ORDER BY pos)),
h AS (SELECT *, CASE WHEN open = 0 AND NOT fence THEN nullif(regexp_extract(line, '^#{{1,6}}\s+(.+?)(?:\s+#+)?\s*$', 1), '') END AS heading FROM o),
g AS (SELECT *, count(heading) OVER (PARTITION BY book_id, chapter_index ORDER BY pos) AS section FROM h),
p AS (SELECT book_id, chapter_index, section, max(heading) AS title, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (heading IS NULL), '') AS body FROM g GROUP BY ALL),
q AS (SELECT book_id, chapter_index, section, title, {_unmarked("body")} AS text FROM p),
k AS (SELECT *, len({_WORDS}) AS n FROM q),
w AS (SELECT book_id, chapter_index, 0 AS section, NULL AS title, string_agg(line, chr(10) ORDER BY pos) AS body FROM g GROUP BY ALL),
v AS (SELECT book_id, chapter_index, section, title, {_unmarked("body")} AS text FROM w ANTI JOIN (SELECT * FROM k WHERE n >= 30) USING (book_id, chapter_index))
SELECT book_id, chapter_index, section, title, CAST(length(text) AS INT) AS n_chars FROM k WHERE n >= 30
UNION ALL SELECT book_id, chapter_index, section, title, CAST(length(text) AS INT) FROM v WHERE len({_WORDS}) >= 30""",
    "ref_notes": rf"""WITH b AS (SELECT book_id, chapter_index, note_number, text AS body, block_pos, len({_WORDS}) AS n,
  CAST(regexp_matches(text, '(?im)(,\s*\d+[a-z]?(\s*[-–—]\s*\d+[a-z]?)?[ .]*$|\bpp?\.\s*\d)') AS INT) AS pages, CAST(regexp_matches(text, '(?i)\([^()]*(press|university|verlag|macmillan|urbanomic|publisher|editionen|madra|tuttle)[^()]*\)') AS INT) AS house,
  CAST(regexp_matches(text, '(?i)https?://|www\.') AS INT) AS url, CAST(regexp_matches(text, '(?m)^See\s+\p{{Lu}}') AS INT) AS see,
  CAST(regexp_matches(trim(text), '^((\p{{Lu}}\.\s*)+\p{{Lu}}[\pL''’.-]+|\p{{Lu}}[\pL''’.-]+(\s+\p{{Lu}}[\pL''’.-]+)?,)') AS INT) AS author
  FROM blocks WHERE kind = 'footnote' AND text IS NOT NULL AND note_number IS NOT NULL),
r AS (SELECT *, n = 0 OR (n <= 80 AND (pages + house + url + see + author >= 2 OR (n <= 25 AND pages + house + url >= 1))) AS cites FROM b)
SELECT book_id, chapter_index, note_number, arg_max(body, (NOT cites, length(body), -block_pos)) AS text FROM r GROUP BY ALL""",
    "ref_catalog": _CATALOG + "SELECT * FROM c",
    "ref_kept_chapters": _CATALOG + "SELECT book_id, chapter_index FROM c WHERE NOT is_contents AND word_count > 0 QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY chapter_index) <= 5",
    "ref_chapter_texts": r"""WITH b AS (SELECT DISTINCT book_id, chapter_index, block_pos, text FROM blocks WHERE text IS NOT NULL)
SELECT book_id, chapter_index, CAST(length(t) AS INT) AS n_chars, sha256(t) AS hash FROM (SELECT book_id, chapter_index, string_agg(text, E'\n\n' ORDER BY block_pos) AS t FROM b GROUP BY ALL)""",
    "ref_note_windows": """WITH b AS (SELECT DISTINCT book_id, chapter_index, block_pos, block_id, kind, text, parent_id FROM blocks WHERE text IS NOT NULL),
h AS (SELECT * FROM b WHERE kind <> 'footnote' OR kind IS NULL), p AS (SELECT book_id, chapter_index, block_id, min(block_pos) AS block_pos FROM h GROUP BY ALL),
n AS (SELECT b.book_id, b.chapter_index, b.block_pos AS note_pos, b.text AS note, p.block_pos FROM b LEFT JOIN p ON b.book_id = p.book_id AND b.chapter_index = p.chapter_index AND b.parent_id = p.block_id WHERE b.kind = 'footnote'),
o AS (SELECT book_id, chapter_index, block_pos, CAST(count(*) AS INT) AS k FROM n WHERE block_pos IS NOT NULL GROUP BY ALL)
SELECT h.book_id, h.chapter_index, h.block_pos, coalesce(k, 0) AS n_notes, CAST(length(text) AS INT) AS n_chars FROM h LEFT JOIN o USING (book_id, chapter_index, block_pos)
UNION ALL SELECT book_id, chapter_index, note_pos, 0, CAST(length(note) AS INT) FROM n WHERE block_pos IS NULL""",
    "ref_capacity": """WITH p AS (SELECT p_size * 20 AS length, count(*) AS n FROM part GROUP BY ALL), g AS (SELECT n, length, unnest(range(0, 801, 25)) AS overhead FROM p WHERE n > 1),
s AS (SELECT overhead, stddev_pop(n * (length + overhead)) / avg(n * (length + overhead)) AS spread, CAST(floor(min(n * (length + overhead)) * 0.9) AS BIGINT) AS budget FROM g GROUP BY overhead)
SELECT budget, CAST(overhead AS INT) AS overhead FROM s ORDER BY round(spread, 12), overhead LIMIT 1""",
    "ref_run_summary": f"""WITH l AS (SELECT run_id, {_PATH} AS path, arg_max(lower(trim(status)), logged_at) AS status, arg_max(coalesce(total_seconds, -1), logged_at) AS secs FROM book_runs GROUP BY ALL)
SELECT run_id, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'running') AS running, round(sum(nullif(secs, -1)), 4) AS total_seconds FROM l GROUP BY run_id""",
    "ref_stage_seconds": f"""WITH d AS (SELECT DISTINCT run_id, {_PATH} AS source_path, logged_at, unnest(map_entries(durations)) AS e FROM book_runs)
SELECT source_path, e.key AS stage, round(sum(e.value), 4) AS seconds FROM d GROUP BY ALL""",
    "ref_stale_chunks": """SELECT DISTINCT c.book_id, c.chapter_index, c.chunk_index FROM chunks c WHERE text IS NOT NULL AND NOT EXISTS
  (SELECT 1 FROM cleaned_chunks k WHERE k.book_id = c.book_id AND k.chapter_index = c.chapter_index AND k.chunk_index = c.chunk_index AND k.raw_text = c.text)""",
    "ref_fingerprints": """WITH b AS (SELECT DISTINCT book_id, chapter_index, block_pos, coalesce(text, '') AS text FROM blocks)
SELECT book_id, chapter_index, sha256(string_agg(sha256(text), '' ORDER BY block_pos)) AS fingerprint FROM b GROUP BY ALL""",
    "ref_chapter_pages": _CATALOG
    + """, p AS (SELECT book_id, chapter_index, ceil(word_count / 300) AS n FROM c),
o AS (SELECT book_id, 1 + coalesce(sum(n) OVER (PARTITION BY book_id ORDER BY chapter_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS page, sum(n) OVER (PARTITION BY book_id) AS pages FROM p),
e AS (SELECT book_id, pages, greatest(page, coalesce(lead(page) OVER (PARTITION BY book_id ORDER BY page), pages) - 1) AS end_page FROM o)
SELECT book_id, CAST(max(end_page) AS BIGINT) AS last_page, count(*) AS chapters, CAST(max(pages) AS BIGINT) AS pages FROM e GROUP BY book_id""",
    "ref_chapter_marks": _CATALOG
    + """, d AS (SELECT book_id, chapter_index, word_count * 400 + CASE WHEN lead(chapter_index) OVER w IS NULL THEN 0 ELSE 1500 END AS length FROM c WINDOW w AS (PARTITION BY book_id ORDER BY chapter_index))
SELECT book_id, chapter_index, CAST(sum(length) OVER w - length AS BIGINT) AS start, CAST(sum(length) OVER w AS BIGINT) AS "end" FROM d WINDOW w AS (PARTITION BY book_id ORDER BY chapter_index)""",
    "ref_run_progress": """WITH d AS (SELECT DISTINCT run_id, source_path, logged_at, status FROM book_runs),
p AS (SELECT run_id, count(*) FILTER (lower(trim(status)) = 'ok') OVER (PARTITION BY run_id ORDER BY logged_at, source_path, status ROWS UNBOUNDED PRECEDING) AS done, count(*) OVER (PARTITION BY run_id) AS n FROM d)
SELECT run_id, max(done) AS done, CAST(sum(done) AS BIGINT) AS sum_done, max(n) AS "of" FROM p GROUP BY run_id""",
    "ref_guarded_answers": rf"""WITH d AS (SELECT DISTINCT book_id, chapter_index, chunk_index, raw_text, cleaned_text, instruct, regexp_replace(regexp_replace(trim(instruct), '^["''`]+', ''), '["''`]+$', '') AS h FROM cleaned_chunks),
n AS (SELECT *, len({_WORDS.replace("text", "raw_text")}) AS rn, len({_WORDS.replace("text", "cleaned_text")}) AS cn, len({_WORDS.replace("text", "h")}) AS hn FROM d)
SELECT book_id, chapter_index, chunk_index, md5(CASE WHEN rn > 0 AND (cn = 0 OR cn > rn * 2.5) THEN raw_text ELSE cleaned_text END) AS answer,
  CASE WHEN NOT (h = '' OR length(h) > 400 OR hn > 60 OR regexp_matches(h, '\[[A-Za-z][^\]]*\]') OR coalesce(trim(raw_text) <> '' AND contains(trim(raw_text), h), false) OR coalesce(hn > 40 AND length(h) > 0.5 * length(trim(raw_text)), false)) THEN h END AS hint FROM n""",
    "ref_without_references": r"""WITH l AS (SELECT book_id, chapter_index, i AS pos, ls[i] AS line FROM (SELECT book_id, chapter_index, string_split_regex(text, '\r\n|\r|\n') AS ls FROM chapters WHERE text IS NOT NULL), unnest(range(1, len(ls) + 1)) AS t(i)),
h AS (SELECT *, lower(regexp_replace(trim(trim(line), E' \t*_"\':.#'), '\s+', ' ', 'g')) AS h FROM l),
m AS (SELECT *, CASE WHEN h IN ('reference', 'references', 'bibliography', 'works cited', 'works consulted', 'literature cited', 'notes and references', 'notes and bibliography', 'citations', 'further reading', 'sources') THEN 1
  WHEN h IN ('acknowledgment', 'acknowledgments', 'acknowledgement', 'acknowledgements', 'about the author', 'conclusion', 'afterword', 'epilogue', 'glossary', 'index', 'appendix', 'appendices') OR regexp_matches(h, '^(appendix|appendices) [a-z0-9]+$') THEN 0 END AS k FROM h),
s AS (SELECT *, coalesce(last_value(k IGNORE NULLS) OVER (PARTITION BY book_id, chapter_index ORDER BY pos), 0) AS skip FROM m)
SELECT book_id, chapter_index, count(*) AS lines FROM s WHERE skip = 0 GROUP BY ALL""",
    "ref_running_headers": r"""WITH b AS (SELECT DISTINCT book_id, chapter_index, block_pos, text FROM blocks WHERE text IS NOT NULL), l AS (SELECT book_id, unnest(string_split_regex(text, '\r\n|\r|\n')) AS line FROM b),
s AS (SELECT book_id, lower(trim(regexp_extract(line, '^\s*(.+?)\s+\|?\s*\d{1,4}\s*$', 1))) AS stem FROM l)
SELECT book_id, stem, count(*) AS times FROM s WHERE stem <> '' AND NOT contains(stem, '.') AND length(stem) <= 80 AND len(list_filter(string_split_regex(stem, '[\s\x0b\x{85}\p{Z}]+'), lambda x: x <> '')) >= 3 GROUP BY ALL HAVING count(*) >= 2""",
    "ref_speak_batches": """WITH RECURSIVE u AS (SELECT DISTINCT book_id, chapter_index, chunk_index, length(text) AS n FROM chunks WHERE text IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY book_id, chapter_index ORDER BY n DESC, chunk_index) AS i FROM u),
r AS (SELECT book_id, chapter_index, chunk_index, i, 0 AS batch, n AS total, 1 AS k FROM o WHERE i = 1
  UNION ALL SELECT o.book_id, o.chapter_index, o.chunk_index, o.i, CASE WHEN r.total + o.n <= 3000 AND r.k < 10 THEN r.batch ELSE r.batch + 1 END,
    CASE WHEN r.total + o.n <= 3000 AND r.k < 10 THEN r.total + o.n ELSE o.n END, CASE WHEN r.total + o.n <= 3000 AND r.k < 10 THEN r.k + 1 ELSE 1 END
  FROM r JOIN o ON o.book_id = r.book_id AND o.chapter_index = r.chapter_index AND o.i = r.i + 1)
SELECT book_id, chapter_index, chunk_index, batch FROM r""",
    "ref_spoken": r"""WITH d AS (SELECT DISTINCT book_id, chapter_index, chunk_index, text FROM chunks),
a AS (SELECT *, regexp_replace(text, '(?i)<\s*https?://[^>\s]+>|https?://[^\s<>\]]+|www\.[^\s<>\]]+', '', 'g') AS t FROM d),
b AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?i)\b(?:e\.i|i\.e)\.(\s|,|:|;|\)|$)', 'in other words\1', 'g'), '(?i)\be\.g\.(\s|,|:|;|\)|$)', 'for example\1', 'g'), '(?i)\betc\.(\s|,|:|;|\)|$)', 'et cetera\1', 'g'), '(?i)\bcf\.(\s|,|:|;|\)|$)', 'compare\1', 'g'), '§\s*([0-9]+(?:\.[0-9]+)*)', 'section \1', 'g') AS t2 FROM a),
c AS (SELECT *, regexp_replace(regexp_replace(t2, '(^|[^A-Za-z])pp\.\s*(\d)', '\1pages \2', 'g'), '(^|[^A-Za-z])p\.\s*(\d)', '\1page \2', 'g') AS t3 FROM b)
SELECT book_id, chapter_index, chunk_index, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t3, '#([A-Za-z][\w-]*)', '\1', 'g'), '\s&\s', ' and ', 'g'), '(\d+)\s*%', '\1 percent', 'g'), '[\s\x0b\x{85}\p{Z}]+', ' ', 'g')) AS text FROM c""",
    "ref_book_kinds": r"SELECT book_id, CASE WHEN regexp_matches(lower(source_path), '\.(html|htm|url)$') THEN 'page' ELSE 'ebook' END AS kind FROM books",
}
