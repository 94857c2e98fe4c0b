"""Repetition inside a document (problem 10), and lines that repeat across documents.

``line_frequency`` and ``drop_frequent_lines`` are the method named: hash normalised lines,
count the distinct documents of a host that hold each, remove lines above a limit, reject
documents of which too little is left.  It cannot tell how much of one document repeats
itself (a phrase repeated within a line, or a line repeated in one document only, has a
document count of one), so ``repeated_words`` keeps the idea, hashed units and counts, with
the document as the host and every run of five words as the unit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import tables
from tidemark.tables import estimated_bytes, scratch, small

#: Words of a passage.
WINDOW = 5
_WORD = re.compile(r"\w+")
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], np.uint64)


def _word_hashes(text: str) -> np.ndarray:
    plain = text.replace("İ", "i").lower()
    if len(plain) < 1 << 22:
        words = _WORD.findall(plain)
        return np.fromiter(map(hash, words), np.int64, len(words))
    return np.fromiter((hash(m.group()) for m in _WORD.finditer(plain)), np.int64)


def count_repeated(texts: list[str | None], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(words, words inside a passage of ``window`` words that began earlier) of each text.

    All texts of a batch are worked on at once: their words lie in one array, a window is a
    weighted sum of word hashes modulo 2**64, and the document takes part in the key.
    """
    hashes = [_word_hashes(t) if t else np.empty(0, np.int64) for t in texts]
    counts = np.array([len(h) for h in hashes], np.int64)
    repeated = np.zeros(len(texts), np.int64)
    total = int(counts.sum())
    if total < window or not len(texts):
        return counts, repeated
    words = np.concatenate(hashes).view(np.uint64)
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), counts)
    with np.errstate(over="ignore"):
        words = (words ^ (words >> np.uint64(31))) * _ODD[0]
        key = np.zeros(total - window + 1, np.uint64)
        weight = np.uint64(1)
        for j in range(window):
            weight = weight * _ODD[1] + np.uint64(2)
            key += words[j : total - window + 1 + j] * weight
        key ^= key >> np.uint64(29)
        key += doc[: len(key)].astype(np.uint64) * _ODD[2]
    inside = np.flatnonzero(doc[: len(key)] == doc[window - 1 :])
    if not len(inside):
        return counts, repeated
    _, first, group = np.unique(key[inside], return_index=True, return_inverse=True)
    again = inside[first[group] != np.arange(len(inside))]
    edge = np.zeros(total + 1, np.int32)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + window, -1)
    covered = np.cumsum(edge[:-1]) > 0
    np.add.at(repeated, doc[covered], 1)
    return counts, repeated


def repeated_words(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, repeated_words, repeated_share) of every document.

    Words are runs of letters, digits and underscores in lower case.  A text without words,
    NULL included, has share 0.  No shuffle: a document is measured where it is scanned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                n, r = count_repeated(part.column("text").to_pylist(), window)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(r), pa.array(r / np.maximum(n, 1))], ["doc_id", "n_words", "repeated_words", "repeated_share"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_words bigint, repeated_words bigint, repeated_share double")


def repetitive(documents: DataFrame, share: float = 0.3) -> DataFrame:
    """doc_id of the documents with at least ``share`` of their words repeated (query p10_found)."""
    return repeated_words(documents).where((F.col("n_words") > 0) & (F.col("repeated_share") >= share - 1e-12)).select("doc_id")


def _plain(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"(?U)[\s\p{Punct}\d]+", " "))


def _host(host: str) -> Column:
    return F.coalesce(F.lower(F.trim(host)), F.lit(""))


_ENDS = r"\r\n|\r|\n"


def _lines(documents: DataFrame, host: str):
    rows = documents.where("text IS NOT NULL").select("doc_id", _host(host).alias("host"), F.explode(F.split("text", _ENDS)).alias("line"))
    plain = _plain(F.col("line"))
    return rows.select("doc_id", "host", F.length("line").alias("n_chars"), F.xxhash64(plain).alias("line_hash")).where(plain != "")


def line_frequency(documents: DataFrame, host: str = "source") -> DataFrame:
    """(host, line_hash, documents): distinct documents of a host that hold a normalised line."""
    return _frequency(_lines(documents, host))


def _frequency(lines: DataFrame) -> DataFrame:
    """Two partial aggregations and no group larger than the distinct documents of a line; a
    line of a third of all documents is counted map-side before it travels."""
    once = lines.groupBy("host", "line_hash", "doc_id").count()
    return once.groupBy("host", "line_hash").agg(F.count("*").alias("documents"))


def _kept_lines(documents: DataFrame, host: str) -> DataFrame:
    """The hashed lines, worked out once and kept in the shared folder: counting and marking both read them."""
    place = f"{scratch(documents.sparkSession, 'lines')}/rows"
    _lines(documents, host).write.parquet(place)
    return documents.sparkSession.read.parquet(place)


#: Parts that the rows of one line are spread over where frequent lines are too many to be broadcast.
SALT = 32


def _meet(lines: DataFrame, often: DataFrame, how: str) -> DataFrame:
    """Lines with the counts of the frequent ones, which are few rows, though each may stand in a third of all
    documents: broadcast below the size limit, else joined with each line's rows spread over SALT parts."""
    place = f"{scratch(lines.sparkSession, 'frequent')}/rows"
    often.write.parquet(place)
    few = lines.sparkSession.read.parquet(place)
    if estimated_bytes(few) <= tables.BROADCAST_BYTES:
        return lines.join(F.broadcast(few), ["host", "line_hash"], how)
    spread = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)))
    copies = few.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    return spread.join(copies, ["host", "line_hash", "salt"], how).drop("salt")


#: A line is frequent if more than this share of its host's documents hold it, and more than ``limit`` of them.
FREQUENT_SHARE = 0.01


def _frequent(lines: DataFrame, documents: DataFrame, host: str, limit: int, share: float) -> DataFrame:
    """(host, line_hash, documents) of the lines above the limit of their host, which grows with its documents."""
    often = _frequency(lines).where(F.col("documents") > limit)
    each = documents.where("text IS NOT NULL").select(_host(host).alias("host"), "doc_id").distinct().groupBy("host").agg(F.count("*").alias("of"))
    return often.join(small(each), "host").where(F.col("documents") > share * F.col("of")).drop("of")


def drop_frequent_lines(documents: DataFrame, host: str = "source", limit: int = 3, keep: float = 0.5, share: float = FREQUENT_SHARE) -> DataFrame:
    """(doc_id, text, dropped): the documents without the lines that ``depleted`` counts as lost,
    and how many those were; rejected documents are left out (query p10_clean).

    Only hashes of frequent lines travel and come back to the texts.  A text without such
    lines stays as it is, line ends included; NULL texts stay."""
    kept = _kept_lines(documents, host)
    own = _meet(kept.select("doc_id", "host", "line_hash").distinct(), _frequent(kept, documents, host, limit, share), "inner")
    found = own.groupBy(F.col("doc_id").alias("_doc"), F.col("host").alias("_host")).agg(F.collect_set("line_hash").alias("often"))
    rows = documents.select("doc_id", _host(host).alias("host"), "text")
    both = rows.join(found, rows.doc_id.eqNullSafe(found["_doc"]) & (rows.host == found["_host"]), "left")
    lines, plain = F.split("text", _ENDS), _plain
    frequent = lambda x: (plain(x) != "") & F.array_contains("often", F.xxhash64(plain(x)))
    marked = F.transform(lines, lambda x: F.struct(x.alias("line"), frequent(x).alias("out"), (plain(x) != "").alias("said")))
    size = lambda test: F.aggregate(F.filter("lines", test), F.lit(0), lambda n, x: n + F.length(x.line))
    parted = both.select("doc_id", "text", F.when(F.col("often").isNotNull(), marked).alias("lines"))
    rest = F.array_join(F.transform(F.filter("lines", lambda x: ~x.out), lambda x: x.line), "\n")
    rejected = F.coalesce(size(lambda x: x.said & ~x.out) < size(lambda x: x.said) * keep, F.lit(False))
    dropped = F.when(F.col("lines").isNull(), 0).otherwise(F.size(F.filter("lines", lambda x: x.out))).alias("dropped")
    return parted.where(~rejected).select("doc_id", F.when(F.col("lines").isNull(), F.col("text")).otherwise(rest).alias("text"), dropped)


def depleted(documents: DataFrame, host: str = "source", limit: int = 3, keep: float = 0.5, share: float = FREQUENT_SHARE) -> DataFrame:
    """(doc_id, n_chars, kept_chars, rejected): characters left without lines that more than
    ``limit`` documents of the host and ``share`` of them hold; a document that keeps less than ``keep`` is rejected.
    Texts that are NULL or hold no line with a letter are not listed."""
    lines = _kept_lines(documents, host)
    marked = _meet(lines, _frequent(lines, documents, host, limit, share), "left")
    sums = marked.groupBy("doc_id").agg(F.sum("n_chars").alias("n_chars"), F.coalesce(F.sum(F.when(F.col("documents").isNull(), F.col("n_chars"))), F.lit(0)).alias("kept_chars"))
    return sums.withColumn("rejected", F.col("kept_chars") < F.col("n_chars") * keep)
