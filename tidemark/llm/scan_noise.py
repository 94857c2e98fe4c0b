"""Noise in text from scanned pages (problem 7): one lattice of readings over the de-lined stream.

The text of a page is de-lined: running headers and page numbers are taken out, and what is
left is one stream of characters.  Its tokens are the written path of a lattice; the other
edges are readings of one token (confused characters, a hyphen at a line end, two words run
together) and of two neighbouring ones (a word torn apart, confused characters included).
The corpus' own word counts are the language model.  An edge has the gain in log likelihood
of its reading over what is written, and the best path of a text takes the edges that do
not overlap and gain most.

Confusions are not enumerated.  ``skeleton`` writes a string out in characters nothing is
confused with any more (d and cl both as el, u and ii both as ii), so two strings turn into
each other by confusions, however many, exactly if their skeletons are equal, and a skeleton
cut in two is the skeletons of two strings.  Readings are equi-joins on it.

The lexicon is never collected or broadcast: distinct units, skeletons and counts meet in
joins, so a vocabulary of any size is decoded exactly.  No length, count or size changes the
rules; all of them are ratios of counts.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.markup import texts
from tidemark.tables import scratch, small

# What a reader of scans takes for what, and the hyphens it leaves at line ends.
CONFUSIONS = (("!", "i"), ("|", "l"), ("1", "l"), ("0", "o"), ("5", "s"), ("9", "g"), ("6", "b"), ("8", "b"), ("c", "e"), ("b", "h"), ("f", "t"), ("ii", "u"), ("cl", "d"), ("rn", "m"), ("vv", "w"), ("li", "h"))
HYPHENS = "-\u00ad\u00ac\u2010"

#: A reading of a word of letters with k confusions must be RATIO * STEP ** (k - 1) times as frequent as the word.
RATIO, STEP = 12, 3.4
#: One word in so many is torn, and at least one in so many run together with its neighbour.
TORN, GLUED = 200, 30
#: A hyphen at a line end parts a word so many times as often as it joins two.
BROKEN = 8

# One definition of a token for both engines: explicit classes, since Java and Python differ in \\s and \\d.
_SP = " \t\x0b\x0c\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
_BLANKS = " \t\x0b\x0c\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000\n"
_CHAR = r"[\p{L}0-9|!]"
_NOT_BEFORE = r"(?<![\p{L}0-9_/\\&=?%#@.:+|!\-])"
_NOT_AFTER = rf"(?![\p{{L}}0-9_/\\&=%#@+]|[:.|](?=[^{_SP}\n]))"
_BREAK = rf"[{HYPHENS}][{_SP}]*\n[{_SP}\n]*"
_TOKEN = rf"{_CHAR}++(?:{_BREAK}{_CHAR}++)?{_NOT_AFTER}"
#: A token, with the white space behind it if a token follows at once.
UNIT = rf"{_NOT_BEFORE}({_TOKEN}(?:(?:[{_SP}]+|[{_SP}]*\n[{_SP}]*)(?={_CHAR}++{_NOT_AFTER}))?)"
_ROMAN = r"(?=[ivxl])x{0,3}(?:ix|iv|v?i{0,3})"
_NUMBER = r"(?:\[\s*\d{1,4}\s*\]|\(\s*\d{1,4}\s*\)|[-–—]\s*\d{1,4}\s*[-–—]|(?:page|seite|página|pagina|pág\.?|pag\.?|blz\.?|p\.|s\.|pg\.?)\s*\d{1,4}|\d{1,4}\s*/\s*\d{1,4}|\d{1,3}|(?!1[0-9]{3}$|20[0-9]{2}$)\d{4})"
PAGE_LINE = rf"(?i)^\s*(?:{_NUMBER}|{_ROMAN})\s*$"
_PROSE = r"\p{L}{3,}[^\n\p{L}]+\p{L}{2,}[^\n\p{L}]+\p{L}{2,}"
_KEYS = ("book_id", "chapter_index", "block_pos")


def _letters(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}]+", "")


def titles(chapters: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, chapter_index, opening, headers): hashes of the letters of the chapter's title, and of every
    line that repeats a title; eight bytes each, whatever the titles' length."""
    book = books.groupBy("book_id").agg(F.max(_letters(F.col("title"))).alias("t"), F.max(_letters(F.col("author"))).alias("a"))
    chapter = chapters.groupBy("book_id", "chapter_index").agg(F.max(_letters(F.col("chapter_title"))).alias("c"))
    named = chapter.join(small(book), "book_id", "left")
    joined = [F.concat(x, y) for x, y in itertools.permutations(("t", "a", "c"), 2) if {x, y} & {"a"}]
    lines = F.filter(F.array("t", "c", *joined), lambda x: x.isNotNull() & (x != ""))
    ready = [F.when(F.col(k) == "", None).otherwise(F.col(k)).alias(k) for k in ("t", "a", "c")]
    hashed = F.transform(lines, lambda x: F.xxhash64(x))
    return named.select("book_id", "chapter_index", *ready).select("book_id", "chapter_index", F.when(F.col("c").isNotNull(), F.xxhash64("c")).alias("opening"), hashed.alias("headers"))


def delined(blocks: DataFrame, chapters: DataFrame, books: DataFrame) -> DataFrame:
    """Key, text, ``stream`` (the text without header and page number lines), ``kinds`` of its noise lines.

    A line is a header when its letters, or those of a part of it between bars or dots, are
    those of the title of book or chapter, with or without the author, whatever its case,
    spacing and numbers; not when the text is that line alone, nor when it opens a chapter.
    A number of four digits from 1000 to 2099 on a line of its own is a year.  Texts without
    a line of three words hold no page numbers.
    """
    rows = texts(blocks, chapters)
    named = rows.join(small(titles(chapters, books)), ["book_id", "chapter_index"], "left")
    many = F.col("text").contains("\n")
    lines = F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n")
    first = F.when((F.col("block_pos") == -1) & (F.xxhash64(_letters(F.element_at("lines", 1))) == F.col("opening")), F.element_at("lines", 1))
    prose = F.col("text").rlike(_PROSE)
    split = named.select(*_KEYS, "text", "headers", "opening", F.when(many, lines).alias("lines"))
    ready = split.select(*_KEYS, "text", "headers", "lines", F.coalesce(first, F.lit("")).alias("first"), F.when(F.col("lines").isNotNull(), prose).alias("prose"))
    known = lambda x: F.array_contains("headers", F.xxhash64(_letters(x)))
    repeats = lambda x: known(x) | (x.rlike("[·•|]") & F.exists(F.split(x, "[·•|]"), known))
    is_header = lambda x: (F.length(x) >= 3) & F.coalesce(repeats(x), F.lit(False)) & (x != F.col("first"))
    is_page = lambda x: (F.length(x) <= 40) & F.col("prose") & x.rlike(PAGE_LINE) & (F.trim(x) != "")
    kind = lambda x: F.when(is_page(x), "page_number").when(is_header(x), "header").otherwise("")
    parsed = ready.select(*_KEYS, "text", F.transform("lines", lambda x: F.struct(x.alias("line"), kind(x).alias("kind"))).alias("lines"))
    kept = F.array_join(F.transform(F.filter("lines", lambda x: x.kind == ""), lambda x: x.line), "\n")
    kinds = F.filter(F.array_distinct(F.transform("lines", lambda x: x.kind)), lambda k: k != "")
    return parsed.select(*_KEYS, "text", F.coalesce(kept, "text").alias("stream"), kinds.alias("kinds"))


def tokens(streams: DataFrame) -> DataFrame:
    """``streams`` with ``units``: the tokens of the stream in lower case, in order, a break in one written as hyphen and line feed."""
    low = F.lower("stream")
    broken = F.regexp_replace(low, rf"{_BREAK}(?={_CHAR})", "-\n")
    flat = F.regexp_replace(broken, rf"(?<![-\n{_SP}])[{_SP}]*+\n[{_SP}]*+(?!\n)", " ")
    return streams.withColumn("units", F.regexp_extract_all(F.when(F.col("stream").contains("\n"), flat).otherwise(low), F.lit(UNIT), 1))


def _token(c: str) -> Column:
    """A unit without the white space behind it."""
    return F.rtrim(c, F.lit(_BLANKS))


def skeleton(c: Column) -> Column:
    """A string in characters that nothing is confused with: equal for two strings if and only if confusions turn one into the other."""
    plain = F.translate(c, "c|1!059f68b", "elliosgthhh")
    for wide, narrow in (("d", "el"), ("m", "rn"), ("w", "vv"), ("u", "ii"), ("h", "li")):
        plain = F.replace(plain, F.lit(wide), F.lit(narrow))
    return plain


def _steps() -> dict[tuple[str, str], int]:
    """(seen, meant) to the confusions between them: those given, and chains of them (d seen as cl, its l as a bar)."""
    out = {pair: 1 for pair in CONFUSIONS}
    while True:
        more = {}
        for (seen, meant), n in out.items():
            for a, b in CONFUSIONS:
                for at in range(len(seen)):
                    if seen.startswith(b, at) and ((chain := (seen[:at] + a + seen[at + len(b) :], meant)) not in out or out[chain] > n + 1):
                        more[chain] = min(n + 1, more.get(chain, n + 1))
        if not more:
            return out
        out |= more


STEPS = _steps()


def confusions(seen: str, word: str) -> int:
    """The least number of confusions that make ``word`` be seen as ``seen``, -1 if only the other way round or not at all."""
    best = [[math.inf] * (len(word) + 1) for _ in range(len(seen) + 1)]
    best[0][0] = 0
    for i, row in enumerate(best):
        for j, cost in enumerate(row):
            if cost == math.inf:
                continue
            if i < len(seen) and j < len(word) and seen[i] == word[j]:
                best[i + 1][j + 1] = min(best[i + 1][j + 1], cost)
            for (a, b), n in STEPS.items():
                if seen.startswith(a, i) and word.startswith(b, j):
                    best[i + len(a)][j + len(b)] = min(best[i + len(a)][j + len(b)], cost + n)
    return -1 if best[-1][-1] == math.inf else int(best[-1][-1])


def _with_confusions(pairs: DataFrame) -> DataFrame:
    """Pairs (.., seen, word) with ``k``; -1 where only the other way round they are confused."""
    fields = [f for f in pairs.schema.fields]
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", k int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = [confusions(x, y) for x, y in zip(b.column("seen").to_pylist(), b.column("word").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(k, pa.int32())], [*b.schema.names, "k"])

    return pairs.mapInArrow(run, ddl).where("k >= 0")


_LETTERS = r"^\p{L}+$"
_EDGE = ("surface", "word", "hyphen", "k", "gain")


def _ratio(k: str = "k") -> Column:
    return F.when(F.col(k) == 0, 1.0).otherwise(RATIO * F.pow(F.lit(STEP), F.col(k) - 1))


def edges(counts: DataFrame, total: int) -> DataFrame:
    """(surface, word, hyphen, k, gain): the best reading of every surface that is not what is written.

    ``counts`` has (unit, n) of all distinct tokens, ``total`` is their sum.  A surface is a
    token or two of them with a space between; k counts confusions.  Gain is the log of how
    many times likelier the reading is than what is written:

    * a word of letters read as another one: n_word / (RATIO.. * n_written);
    * a token that is no word: n_word / n_written, or, with a mark at its end, against the
      word in front of the mark;
    * broken at a hyphen: n_word against the chance of the two parts meeting, n_a * n_b / total;
      a word seen nowhere else counts if neither part stands anywhere by itself;
    * torn in two: n_word / TORN against the same chance;
    * run together: both parts GLUED times as frequent, and likelier to meet than it is to occur.
    """
    base = counts.where(~F.col("unit").contains("\n"))
    shaped = base.select("unit", "n", skeleton(F.col("unit")).alias("skel"), F.col("unit").rlike(_LETTERS).alias("letters"))
    lexicon = shaped.where(F.col("letters") & (F.length("unit") > 1)).select(F.col("unit").alias("word"), F.col("n").alias("word_n"), "skel")
    log = lambda x: F.log(F.greatest(x.cast("double"), F.lit(1e-9)))
    chance = lambda a, b: F.greatest(F.coalesce(a, F.lit(0)), F.lit(0.5)) * F.greatest(F.coalesce(b, F.lit(0)), F.lit(0.5)) / F.lit(float(max(total, 1)))

    # one token, one word
    bare = base.where(F.col("unit").endswith("!")).select("unit", F.regexp_replace("unit", "!+$", "").alias("bare"))
    marked = bare.join(counts.select(F.col("unit").alias("bare"), F.col("n").alias("bare_n")), "bare", "left").where("bare <> ''")
    forms = shaped.select("unit", F.col("unit").alias("seen"), "skel", "n", "letters").join(marked.select("unit", "bare_n"), "unit", "left")
    forms = forms.select("unit", "seen", "skel", F.coalesce("bare_n", "n").alias("own"), (F.col("letters") | F.col("bare_n").isNotNull()).alias("is_word"))
    stripped = marked.where("bare_n IS NULL").select("unit", F.col("bare").alias("seen"), skeleton(F.col("bare")).alias("skel"), F.lit(1).cast("long").alias("own"), F.col("bare").rlike(_LETTERS).alias("is_word"))
    single = forms.unionByName(stripped).where(F.length("seen") > 2).join(lexicon, "skel").where("word <> seen AND word_n >= 2 AND word_n >= own").drop("skel")
    single = _with_confusions(single.where(~F.col("is_word") | (F.col("word_n") >= RATIO * F.col("own")))).withColumn("need", F.when(F.col("is_word"), _ratio()).otherwise(F.lit(1.0)))
    single = single.where("word_n >= need * own").select(F.col("unit").alias("surface"), "word", F.lit(False).alias("hyphen"), "k", (log(F.col("word_n") / F.col("need") / F.col("own")) + F.lit(0.1)).alias("gain"))

    # one token broken at a hyphen
    broken = counts.where(F.col("unit").contains("\n")).select("unit", F.col("n").alias("own"), F.substring_index("unit", "-\n", 1).alias("a"), F.substring_index("unit", "-\n", -1).alias("b"))
    part = lambda x: counts.select(F.col("unit").alias(x), F.col("n").alias(f"{x}_n"))
    parted = broken.join(part("a"), "a", "left").join(part("b"), "b", "left").withColumn("seen", F.regexp_replace(F.concat("a", "b"), "!+$", "")).withColumn("skel", skeleton(F.col("seen")))
    known = _with_confusions(parted.join(lexicon, "skel").where("word_n >= 1").drop("skel")).where("k = 0 OR word_n >= 3")
    known = known.select(F.col("unit").alias("surface"), "word", F.lit(True).alias("hyphen"), "k", (log(F.col("word_n") / _ratio() * BROKEN) - log(chance(F.col("a_n"), F.col("b_n")))).alias("gain"))
    unknown = parted.where("a_n IS NULL AND b_n IS NULL AND length(a) > 1 AND length(b) > 1").where(F.col("seen").rlike(_LETTERS))
    unknown = unknown.select(F.col("unit").alias("surface"), F.col("seen").alias("word"), F.lit(True).alias("hyphen"), F.lit(0).alias("k"), F.lit(0.5).alias("gain"))

    # two tokens, one word: cuts of the skeleton of a word meet the skeletons of tokens
    words = lexicon.where("word_n >= 2 AND length(word) > 3")
    cut = words.select("word", "word_n", "skel", F.explode(F.sequence(F.lit(1), F.length("skel") - 1)).alias("at")).selectExpr("word", "word_n", "substring(skel, 1, at) AS sa", "substring(skel, at + 1) AS sb")
    piece = lambda x: shaped.where(F.col("unit").rlike(r"\p{L}")).select(F.col("unit").alias(x), F.col("n").alias(f"{x}_n"), F.col("skel").alias(f"s{x}"))
    gain = log(F.col("word_n") / TORN) - log(chance(F.col("a_n"), F.col("b_n")))
    torn = cut.join(piece("a"), "sa").where("word_n >= a_n").join(piece("b"), "sb").where("word_n >= b_n").where(gain > 0)
    torn = _with_confusions(torn.select("a", "b", "a_n", "b_n", "word", "word_n", F.concat("a", "b").alias("seen")))
    torn = torn.select(F.concat_ws(" ", "a", "b").alias("surface"), "word", F.lit(False).alias("hyphen"), "k", (gain - F.log(_ratio())).alias("gain"))

    # one token, two words
    rare = shaped.where(F.col("letters") & (F.length("unit") > 4)).select("unit", F.col("n").alias("own"))
    halves = rare.select("unit", "own", F.explode(F.sequence(F.lit(2), F.length("unit") - 2)).alias("at")).selectExpr("unit", "own", "substring(unit, 1, at) AS a", "substring(unit, at + 1) AS b")
    often = lambda x: lexicon.where(F.col("word_n") >= GLUED).select(F.col("word").alias(x), F.col("word_n").alias(f"{x}_n"))
    glued = halves.join(often("a"), "a").where(F.col("a_n") >= GLUED * F.col("own")).join(often("b"), "b").where(F.col("b_n") >= GLUED * F.col("own"))
    meets = log(F.col("a_n").cast("double") * F.col("b_n") / F.lit(float(max(total, 1))) / F.col("own"))
    glued = glued.where(meets >= 0).select(F.col("unit").alias("surface"), F.concat_ws(" ", "a", "b").alias("word"), F.lit(False).alias("hyphen"), F.lit(0).alias("k"), (meets + 0.1).alias("gain"))

    every = single.unionByName(known).unionByName(unknown).unionByName(torn).unionByName(glued).where("gain > 0")
    best = F.max(F.struct("gain", (-F.col("k")).alias("k"), "word", "hyphen"))
    return every.groupBy("surface").agg(best.alias("e")).select("surface", "e.word", "e.hyphen", (-F.col("e.k")).alias("k"), "e.gain")


def _is_prose(common_words: DataFrame) -> Column:
    """Whether a stream holds two common words of any language; the words are a table of fixed length."""
    words = sorted({r.word.lower() for r in common_words.select("word").distinct().collect() if r.word and r.word.isalpha()})
    if not words:
        return F.lit(True)
    by_letter = itertools.groupby(words, key=lambda w: w[0])
    one = r"(?<![\p{L}\d])(?:" + "|".join(f"{c}(?:{'|'.join(w[1:] for w in ws)})" for c, ws in by_letter) + r")(?![\p{L}\d])"
    return F.col("stream").rlike(f"(?is){one}.*?{one}")


#: Edges are broadcast up to this number, some 100 bytes each; beyond it they meet the tokens in a shuffled join.
BROADCAST_EDGES = 400_000
#: In a text without common words one word counts as read from so many letters; shorter ones meet strings of no language by chance.
LEAST_LETTERS = 6
_PATH = ("book_id", "chapter_index", "block_pos", "text_hash")


def best_path(found: list[dict]) -> list[dict]:
    """The edges of one text that do not overlap and gain most together; on ties those that come first."""
    by_end: dict[int, list[dict]] = {}
    for e in found:
        by_end.setdefault(e["pos"] + 1 + (" " in e["surface"]), []).append(e)
    ends = [0, *sorted(by_end)]
    best: list[tuple[float, dict | None, int]] = [(0.0, None, 0)]  # gain up to here, edge that ends here, index before it
    for i in range(1, len(ends)):
        score = (best[i - 1][0], None, i - 1)
        for e in by_end[ends[i]]:
            before = next(j for j in range(i - 1, -1, -1) if ends[j] <= e["pos"])
            if best[before][0] + e["gain"] > score[0]:
                score = (best[before][0] + e["gain"], e, before)
        best.append(score)
    out, i = [], len(best) - 1
    while i:
        _, e, before = best[i]
        if e is not None:
            out.append(e)
        i = before
    return out[::-1]


def decode(streams: DataFrame, common_words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the streams with their text_hash and tokens, the decoded paths: key, text_hash, path).

    ``path`` is the array of (pos, surface, word, hyphen, k) of the edges taken, pos counting the
    tokens of the stream.  Texts that are read as they stand have no row.  The tokens of the
    streams are worked out once and kept in the shared folder, as counts and lattice both need them.
    """
    spark = streams.sparkSession
    place = scratch(spark, "tokens")
    prose = _is_prose(common_words).alias("prose")
    hashed = F.xxhash64("text").alias("text_hash")
    tokens(streams).select(*_KEYS, hashed, "kinds", prose, "units").write.parquet(f"{place}/streams")
    kept = spark.read.parquet(f"{place}/streams")
    kept.select(F.explode("units").alias("unit")).groupBy(_token("unit").alias("unit")).agg(F.count("*").alias("n")).write.parquet(f"{place}/counts")
    counts = spark.read.parquet(f"{place}/counts")
    edges(counts, counts.agg(F.sum("n")).first()[0] or 0).write.parquet(f"{place}/edges")
    lattice = spark.read.parquet(f"{place}/edges")
    pair = F.when(F.col("surface").contains(" "), F.split("surface", " "))
    headed = lattice.select(F.coalesce(pair[0], "surface").alias("head"), pair[1].alias("tail"), "surface", "word", "hyphen", "k", "gain")
    each = kept.select(*_PATH, "prose", F.posexplode(F.arrays_zip(F.col("units").alias("a"), F.slice("units", 2, 1 << 30).alias("b"))).alias("pos", "z")).select(*_PATH, "prose", "pos", _token("z.a").alias("head"), "z.a", "z.b")
    met = each.join(F.broadcast(headed) if lattice.count() <= BROADCAST_EDGES else headed, "head")
    hits = met.where(F.col("tail").isNull() | ((F.length("a") > F.length("head")) & (F.col("tail") == _token("b"))))
    sure = F.col("prose") | (F.col("tail").isNull() & ~F.col("word").contains(" ") & (F.length("word") >= LEAST_LETTERS))
    taken = hits.where(sure).groupBy(*_PATH).agg(F.collect_set(F.struct("pos", "surface", "word", "hyphen", "k", "gain")).alias("found"))
    return kept, taken.mapInArrow(_paths, "book_id bigint, chapter_index int, block_pos int, text_hash bigint, path array<struct<pos:int,surface:string,word:string,hyphen:boolean,k:int>>")


_STEP = pa.list_(pa.struct([("pos", pa.int32()), ("surface", pa.string()), ("word", pa.string()), ("hyphen", pa.bool_()), ("k", pa.int32())]))


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        paths = [best_path(f) if len(f) > 1 else f for f in b.column("found").to_pylist()]
        rows = [[{n: e[n] for n in ("pos", "surface", "word", "hyphen", "k")} for e in p] for p in paths]
        yield pa.RecordBatch.from_arrays([*[b.column(k) for k in _PATH], pa.array(rows, _STEP)], [*_PATH, "path"])


def noise_found(blocks: DataFrame, chapters: DataFrame, books: DataFrame, common_words: DataFrame) -> DataFrame:
    """(book_id, chapter_index, block_pos, noise), one row for each kind of a text (query p7_found)."""
    kept, paths = decode(delined(blocks, chapters, books), common_words)
    lines = kept.select(*_KEYS, F.explode("kinds").alias("noise"))
    kinds = F.array(F.when(F.exists("path", lambda e: e.hyphen), "hyphen"), F.when(F.exists("path", lambda e: e.k > 0), "misread"))
    words = paths.select(*_KEYS, F.explode(F.array_compact(kinds)).alias("noise"))
    return lines.unionByName(words).distinct()


# --- repair ----------------------------------------------------------------------------


_ITEM = re.compile(r"^(?:[-*+•]|\d{1,3}[.)]|[a-z]\))\s|(?:\.\s?){4,}\d+$|^\|.*\|$|\t")


def paragraphs(lines: list[str]) -> list[str]:
    """Lines put together to paragraphs by dynamic programming over the line ends.

    A paragraph costs a constant, and more when it is short; a line end costs when it parts a
    sentence and is a boundary, or when it is blank, or a short line that ends a sentence, and
    is none.  The cheapest set of boundaries wins, the one with fewer on ties.
    """
    rows: list[tuple[str, bool]] = []  # line, blank line behind it
    for line in lines:
        if line.strip():
            rows.append((line.strip(), False))
        elif rows:
            rows[-1] = (rows[-1][0], True)
    if not rows:
        return []
    width = max(len(r) for r, _ in rows)
    item = [bool(_ITEM.search(r)) for r, _ in rows]  # a line of a list or of contents stays its own

    def split_cost(i: int) -> float:
        if item[i] or item[i + 1]:
            return 0.0
        ends = rows[i][0][-1] in ".!?…:\"”»)"
        starts = not rows[i + 1][0][0].islower()
        return (0.0 if ends else 4.0) + (0.0 if starts else 3.0)

    def join_cost(i: int) -> float:
        ends = rows[i][0][-1] in ".!?…:\"”»"
        if item[i] or item[i + 1]:
            return 9.0
        return (3.0 if rows[i][1] and ends else 1.0 if rows[i][1] else 0.0) + (2.5 if ends and len(rows[i][0]) < 0.75 * width and not rows[i + 1][0][0].islower() else 0.0)

    n = len(rows)
    best: list[tuple[float, int, int]] = [(0.0, 0, 0)]
    for j in range(1, n + 1):
        options, least = [], float("inf")
        inner, size = 0.0, 0
        for i in range(j - 1, -1, -1):  # a paragraph of rows[i:j]
            size += len(rows[i][0])
            if i < j - 1:
                inner += join_cost(i)
            edge = split_cost(i - 1) if i else 0.0
            cost = best[i][0] + edge + inner + 1.5 + (1.0 if size < 40 else 0.0)
            options.append((cost, best[i][1] + 1, i))
            least = min(least, cost)
            # rows[k:i] as a paragraph cost best[i] at least, so one that begins at k < i costs no less than this
            if i and best[i][0] + join_cost(i - 1) + inner - 1.0 > least:
                break
        best.append(min(options))
    cuts, j = [], n
    while j:
        cuts.append((best[j][2], j))
        j = best[j][2]
    return [" ".join(r for r, _ in rows[i:j]) for i, j in reversed(cuts)]


_UNIT_PY = regex.compile(UNIT)
_TAIL = regex.compile(rf"[{_SP}\n]+$")
_BREAK_PY = regex.compile(_BREAK)


def _spelled(seen: str, word: str) -> str:
    letters = [c for c in seen if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return word.upper()
    return word[0].upper() + word[1:] if seen[0].isupper() else word


def repair(stream: str, path: list[dict]) -> str:
    """The stream with the words of its path written out and its lines put together to paragraphs.

    A break at a hyphen that the path does not join stays a line end, so that no space comes
    into a compound; marks a reading does not hold stay behind it.
    """
    taken = {e["pos"]: e for e in path}
    out, at, skip = [], 0, False
    found = list(_UNIT_PY.finditer(stream)) if path else []
    for i, m in enumerate(found):
        if skip or (e := taken.get(i)) is None:
            skip = False
            continue
        start, end = m.start(1), m.end(1) - len(t[0] if (t := _TAIL.search(m[1])) else "")
        seen = stream[start:end]
        if " " in e["surface"] and i + 1 < len(found):
            n = found[i + 1]
            end, skip = n.end(1) - len(t[0] if (t := _TAIL.search(n[1])) else ""), True
            seen += " " + stream[n.start(1) : end]
        if _BREAK_PY.sub("-\n", seen.lower()) != e["surface"]:
            continue  # the other engine parts the text elsewhere
        marks = len(seen) - len(seen.rstrip("!")) if not e["word"].endswith("i") else 0
        out += [stream[at:start], _spelled(seen, e["word"]), "!" * marks]
        at = end
    text = "".join(out) + stream[at:]
    kept = _BREAK_PY.sub(lambda m: m[0][0] + _JOINT, text)
    return "\n\n".join(paragraphs(kept.split("\n"))).replace(_JOINT, "\n")


_JOINT = "\ufdd2"  # no character of any text: a line end that stays


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        path = [p or [] for p in b.column("path").to_pylist()]
        clean = [repair(s, p) for s, p in zip(b.column("stream").to_pylist(), path, strict=True)]
        yield pa.RecordBatch.from_arrays([*[b.column(k) for k in _KEYS], pa.array(clean, pa.string()), pa.array([len(p) for p in path], pa.int32())], [*_KEYS, "clean_text", "repaired"])


def clean_scans(blocks: DataFrame, chapters: DataFrame, books: DataFrame, common_words: DataFrame) -> DataFrame:
    """(book_id, chapter_index, block_pos, clean_text, repaired) of every text with noise of any kind
    or with more than one line: header and page number lines gone, words repaired, paragraphs of
    one line each.  Copies of a block count once; texts without any of this are not listed."""
    streams = delined(blocks, chapters, books)
    _, paths = decode(streams, common_words)
    once = streams.select(*_KEYS, F.xxhash64("text").alias("text_hash"), "stream", "kinds").groupBy(*_KEYS).agg(F.max(F.struct("stream", "text_hash", "kinds")).alias("s")).select(*_KEYS, "s.*")
    null_safe = [once[k].eqNullSafe(paths[k]) for k in _PATH]
    both = once.join(paths, null_safe, "left").select(*[once[k] for k in _KEYS], "stream", "path", "kinds")
    noisy = both.where("path IS NOT NULL OR size(kinds) > 0 OR contains(stream, '\n')")
    return noisy.select(*_KEYS, "stream", "path").mapInArrow(_repair, "book_id bigint, chapter_index int, block_pos int, clean_text string, repaired int")
