"""Encoding a corpus with a public byte-level BPE (problem 8).

Overlapping chunk encoding.  A text longer than ``PIECE`` code points is cut into windows
that overlap by ``OVERLAP`` on either side of a nominal seam.  Every window is pre-tokenised in
a task of its own, from wherever it begins, and trusts its boundaries from the place on where
it has resynchronised: no alternative of the pattern crosses from a character to white space
behind it, so every tokenisation has a boundary there, and what follows a boundary depends
on nothing before it.  Two neighbours are stitched at the first boundary in their overlap
that both trust.  The pieces between the stitches are encoded, again each in a task of its
own, and put together in order.  Windows that share no boundary, as in a run of letters
longer than the overlap, become one piece.
"""

from __future__ import annotations

import itertools
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.tables import scratch

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Code points of a nominal piece, and of the overlap on either side of a seam.
PIECE, OVERLAP = 1 << 16, 1 << 10
# White space as the tokenizer knows it; separators of files, which only Python counts as such, are none.
_SPACE = " \t\n\r\x0b\x0c\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_HARD = re.compile(rf"[^{_SPACE}](?=[{_SPACE}])")
_SEPARATORS = dict.fromkeys(range(0x1C, 0x20), "\x01")


@lru_cache(maxsize=2)
def encoder(path: str | None = None):
    """The encoder of one vocabulary file, loaded once in each worker."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _pattern():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


def windows(text: str, piece: int = PIECE, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """(begin, end, nominal begin, nominal end) of the windows of a text."""
    seams = [*range(0, len(text), piece), len(text)]
    return [(max(0, a - overlap), min(len(text), b + overlap), a, b) for a, b in itertools.pairwise(seams)]


def boundaries(text: str, begin: int, first: bool, last: bool) -> list[int]:
    """The pre-token boundaries of a window from ``begin`` on that it trusts, as positions in the whole text.

    A window that is not the first trusts none before white space follows another character;
    the last token of one that is not the last may go on behind it; and a place behind white
    space is none, as there the text before it depends on what follows.
    """
    plain = text.translate(_SEPARATORS)
    synced = 0 if first else m.end() if (m := _HARD.search(plain)) else len(plain) + 1
    ends = [m.end() for m in _pattern().finditer(plain)]
    return [begin + e for e in (ends if last else ends[:-1]) if e >= synced and not plain[e - 1].isspace()]


def stitch(left: list[int], right: list[int], begin: int, end: int) -> int | None:
    """The first boundary in the overlap that both windows trust; None if there is none."""
    return min((x for x in set(left) & set(right) if begin < x <= end), default=None)


def cut_pieces(text: str, piece: int = PIECE, overlap: int = OVERLAP) -> list[str]:
    """The pieces of a text, cut as ``encode`` cuts it over many tasks."""
    overlap = min(overlap, piece // 2)
    parts = windows(text, piece, overlap)
    found = [boundaries(text[a:b], a, i == 0, i == len(parts) - 1) for i, (a, b, *_) in enumerate(parts)]
    cuts = [stitch(x, y, high - overlap, high + overlap) for (x, y), (*_, high) in zip(itertools.pairwise(found), parts, strict=False)]
    places = [0, *(c for c in cuts if c is not None), len(text)]
    return [text[a:b] for a, b in itertools.pairwise(places)]


def encode_text(text: str | None, path: str | None = None) -> list[int]:
    """Ids of one text; NULL and empty texts have none."""
    return encoder(path).encode_ordinary(text) if text else []


def decode_ids(ids: list[int], path: str | None = None) -> str:
    """The text of ids: their raw bytes, concatenated and only then read as UTF-8."""
    return b"".join(encoder(path).decode_tokens_bytes(ids)).decode("utf-8", errors="replace")


def _lists(rows: list[list[int]]) -> pa.Array:
    flat, ends = array("i"), [0]
    for r in rows:
        flat.extend(r)
        ends.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if flat else [], pa.int32()))


def _encode(path: str | None, counts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):  # bounded memory for lists of ids
                part = b.slice(at, 512)
                ids = [encode_text(t, path) for t in part.column("text").to_pylist()]
                out = pa.array([len(x) for x in ids], pa.int64()) if counts else _lists(ids)
                kept = [i for i, n in enumerate(part.schema.names) if n != "text"]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in kept], out], [*[part.schema.names[i] for i in kept], "n_tokens" if counts else "ids"])

    return run


_WINDOWS = "doc_id bigint, part int, begin bigint, finish bigint, low bigint, high bigint, last boolean, text string"


def _windows(piece: int, overlap: int, keep: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (key, text) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True)):
                rows = windows(text, piece, overlap)
                for at in range(0, len(rows), 64):
                    part = rows[at : at + 64]
                    cols = list(zip(*part, strict=True))
                    n = len(part)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key] * n, pa.int64()), pa.array(range(at, at + n), pa.int32()), *[pa.array(c, pa.int64()) for c in cols], pa.array([at + k == len(rows) - 1 for k in range(n)]), pa.array([text[x:y] for x, y, *_ in part], pa.string()), *[b.column(c).take(pa.array([i] * n)) for c in keep]],
                        ["doc_id", "part", "begin", "finish", "low", "high", "last", "text", *keep],
                    )

    return run


def _pretokenised(overlap: int):
    """The windows with their boundaries near either seam."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = b.to_pydict()
            near: tuple[list, list] = ([], [])
            for i, text in enumerate(d["text"]):
                found = boundaries(text, d["begin"][i], d["part"][i] == 0, d["last"][i])
                near[0].append([x for x in found if x <= d["low"][i] + overlap])
                near[1].append([x for x in found if x >= d["high"][i] - overlap])
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(x, pa.list_(pa.int64())) for x in near]], [*b.schema.names, "left", "right"])

    return run


def _stitched(overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = b.to_pydict()
            cut = [stitch(r, n, h - overlap, h + overlap) for r, n, h in zip(d["right"], d["next_left"], d["high"], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), pa.array(cut, pa.int64())], ["doc_id", "part", "cut"])

    return run


def _ddl(df: DataFrame, names: tuple[str, ...]) -> str:
    return "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in names)


def _pieces(documents: DataFrame, piece: int, overlap: int, keep: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(doc_id, piece, text) of the long texts, cut where neighbouring windows were stitched, and (doc_id, keep...)."""
    spark, place, overlap = documents.sparkSession, f"{scratch(documents.sparkSession, 'windows')}/rows", min(overlap, piece // 2)
    ddl = _WINDOWS + _ddl(documents, keep)
    cut = documents.mapInArrow(_windows(piece, overlap, keep), ddl).repartition("doc_id", "part")
    cut.mapInArrow(_pretokenised(overlap), f"{ddl}, left array<bigint>, right array<bigint>").write.parquet(place)
    kept = spark.read.parquet(place)
    following = kept.where("part > 0").select("doc_id", (F.col("part") - 1).alias("part"), F.col("left").alias("next_left"))
    cuts = kept.select("doc_id", "part", "high", "right").join(following, ["doc_id", "part"]).mapInArrow(_stitched(overlap), "doc_id bigint, part int, cut bigint")
    before = cuts.select("doc_id", (F.col("part") + 1).alias("part"), F.col("cut").alias("cut_before"))
    own = kept.select("doc_id", "part", "begin", "low", "high", "text").join(cuts, ["doc_id", "part"], "left").join(before, ["doc_id", "part"], "left")
    start, stop = F.coalesce("cut_before", "low"), F.coalesce("cut", "high")
    # windows that were not stitched are one piece, named by the first of them
    named = own.select("doc_id", "part", F.when(F.col("cut_before").isNotNull() | (F.col("part") == 0), F.col("part")).alias("opens"))
    first = F.last("opens", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    of = named.select("doc_id", "part", first.alias("piece"))
    share = own.select("doc_id", "part", F.substring("text", (start - F.col("begin") + 1).cast("int"), (stop - start).cast("int")).alias("text"))
    ordered = F.array_sort(F.collect_list(F.struct("part", "text")))
    whole = share.join(of, ["doc_id", "part"]).groupBy("doc_id", "piece").agg(F.array_join(F.transform(ordered, lambda x: x.text), "").alias("text"))
    return whole, kept.where("part = 0").select("doc_id", *keep)


def encode(documents: DataFrame, vocabulary: str | None = None, piece: int = PIECE, overlap: int = OVERLAP, counts: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id BIGINT, keep..., ids ARRAY<INT>) or, with ``counts``, (doc_id, keep..., n_tokens BIGINT).

    One row per row of ``documents``; doc_id should be unique, as pieces of a long text
    come together by it.  NULL and empty texts give the empty list, blank ones are encoded
    as they are; strings of special tokens are ordinary text; columns that are not kept are
    ignored.  Short texts are encoded where they are scanned, without a shuffle; only the
    windows and pieces of long ones travel, each to a task of its own.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, "text")
    long = docs.where(F.length("text") > piece)
    value = "n_tokens bigint" if counts else "ids array<int>"
    short = docs.where(F.coalesce(F.length("text") <= piece, F.lit(True))).mapInArrow(_encode(vocabulary, counts), f"doc_id bigint{_ddl(docs, keep)}, {value}")
    parts, kept = _pieces(long, piece, overlap, keep)
    done = parts.mapInArrow(_encode(vocabulary, counts), f"doc_id bigint, piece int, {value}")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("piece", "ids"))), lambda x: x.ids) if not counts else None
    found = done.groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens") if counts else F.flatten(ordered).alias("ids"))
    return short.unionByName(kept.join(found, "doc_id"))


def round_trip(encoded: DataFrame, documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, same): whether the decoded ids give the text back (NULL as empty)."""
    both = encoded.join(documents.select("doc_id", "text"), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids").to_pylist()
            same = [decode_ids(i, vocabulary) == (t or "") for i, t in zip(ids, b.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(i) for i in ids], pa.int64()), pa.array(same)], ["doc_id", "n_tokens", "same"])

    return both.mapInArrow(run, "doc_id bigint, n_tokens bigint, same boolean")
