"""Queries of the text problems and, where SQL can say them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import encode, markup, mix, pairs, quality, repetition, scan_noise, split
from tidemark.tables import read


def _tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [read(spark, sf_dir, n) for n in names]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.markup_found(*_tables(spark, sf_dir, "blocks", "chapters"))


def p2_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.clean_markup(*_tables(spark, sf_dir, "blocks", "chapters"))


def p2_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.induce_wrappers(*_tables(spark, sf_dir, "blocks", "chapters"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.oversized_items(*_tables(spark, sf_dir, "chapters", "chunks", "books", "size_limits"))


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_items(*_tables(spark, sf_dir, "chapters", "chunks", "books", "size_limits"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.not_prose(*_tables(spark, sf_dir, "chapters", "common_words"))


def p4_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.with_catalog(*_tables(spark, sf_dir, "chapters", "common_words"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.defective_pairs(*_tables(spark, sf_dir, "cleaned_chunks", "common_words"))


def p6_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.pair_defects(*_tables(spark, sf_dir, "cleaned_chunks", "common_words"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_noise.noise_found(*_tables(spark, sf_dir, "blocks", "chapters", "books", "common_words"))


def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_noise.clean_scans(*_tables(spark, sf_dir, "blocks", "chapters", "books", "common_words"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode(read(spark, sf_dir, "documents"))


def p8_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return encode.round_trip(encode.encode(documents), documents)


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix(*_tables(spark, sf_dir, "documents", "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, targets = _tables(spark, sf_dir, "documents", "mix_targets")
    return mix.shares(mix.mix(documents, targets), targets)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetitive(read(spark, sf_dir, "documents"))


def p10_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repeated_words(read(spark, sf_dir, "documents"))


def p10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.depleted(read(spark, sf_dir, "documents"))


def p10_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.drop_frequent_lines(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_clean, p2_wrappers, p3_found, p3_pieces, p4_found, p4_statistics, p6_found, p6_pairs, p7_found, p7_clean, p8_ids, p8_round_trip, p9_mix, p9_shares, p10_found, p10_share, p10_lines, p10_clean)}

_SHARES = r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS ws FROM documents),
p AS (SELECT doc_id, i, list_aggregate(ws[i : i + 4], 'string_agg', ' ') AS g FROM w, unnest(range(1, len(ws) - 3)) AS t(i)),
a AS (SELECT doc_id, i FROM p QUALIFY i > min(i) OVER (PARTITION BY doc_id, g)),
c AS (SELECT doc_id, count(DISTINCT i + k) AS r FROM a, unnest(range(0, 5)) AS t(k) GROUP BY doc_id)
"""

# Lines by their plain words: what is no letter and no symbol becomes a space.
_LINES = r"""WITH h AS (SELECT doc_id, coalesce(lower(trim(source, ' ')), '') AS host, text FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, host, unnest(string_split_regex(text, '\r\n|\r|\n')) AS line FROM h),
p AS (SELECT doc_id, host, line, trim(regexp_replace(lower(line), '[\s\x0b\x{85}\p{Z}\p{P}\p{Nd}]+', ' ', 'g'), ' ') AS plain FROM l),
f AS (SELECT host, plain, count(DISTINCT doc_id) AS n FROM p WHERE plain <> '' GROUP BY ALL),
e AS (SELECT host, count(DISTINCT doc_id) AS docs FROM h GROUP BY host),
o AS (SELECT host, plain, true AS often FROM f JOIN e USING (host) WHERE n > 3 AND n > 0.01 * docs)
"""

ORACLE = {
    "p10_lines": _LINES + "SELECT doc_id, CAST(sum(length(line)) AS BIGINT) AS n_chars, CAST(coalesce(sum(length(line)) FILTER (often IS NULL), 0) AS BIGINT) AS kept_chars, coalesce(sum(length(line)) FILTER (often IS NULL), 0) < 0.5 * sum(length(line)) AS rejected FROM p LEFT JOIN o USING (host, plain) WHERE plain <> '' GROUP BY doc_id",
    "p10_found": _SHARES + "SELECT doc_id FROM w JOIN c USING (doc_id) WHERE r >= 0.3 * len(ws)",
    "p10_share": _SHARES + "SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(r, 0) AS repeated_words, coalesce(r, 0) / greatest(len(ws), 1) AS repeated_share FROM w LEFT JOIN c USING (doc_id)",
    "p3_found": r"""WITH limits AS (SELECT item_kind, source_kind, max_chars FROM size_limits),
kinds AS (SELECT book_id, min(coalesce(lower(trim(source_kind)), 'ebook')) AS source_kind FROM books GROUP BY book_id),
items AS (SELECT 'chapter' AS item_kind, book_id, chapter_index, -1 AS chunk_index, text, coalesce(kinds.source_kind, 'ebook') AS source_kind FROM chapters LEFT JOIN kinds USING (book_id)
  UNION ALL SELECT DISTINCT 'chunk', book_id, chapter_index, chunk_index, text, coalesce(lower(trim(source_kind)), 'ebook') FROM chunks)
SELECT item_kind, book_id, chapter_index, chunk_index,
  CASE WHEN list_max(list_transform(regexp_split_to_array(text, '\s+'), lambda w: length(w))) > max_chars THEN 'forced' ELSE 'natural' END AS cut
FROM items JOIN limits USING (item_kind, source_kind) WHERE length(text) > max_chars""",
}
