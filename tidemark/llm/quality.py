"""Per-document text quality statistics (problem 4): prose, lists, tables and junk.

Gradient-boosted trees over statistics of passages.  Labelling functions mark passages they
are sure of as prose, list, table or junk; trees are grown on a bounded sample of those, the
class probabilities are calibrated on a hand-checked holdout, and every passage of every
chapter is then classified.  A chapter is what most of its words stand in.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.quality_holdout import HOLDOUT
from tidemark.tables import spread, training_rows

KINDS = ("prose", "list", "table", "junk")
#: Weakly labelled passages of each kind that the trees are grown on, at most; the ones with the least hashes.
SAMPLE = 1500
#: Chapters that are labelled for training, at most, by the hash of their key; all are classified.
TRAIN_CHAPTERS = 5_000
FEATURES = ("log_words", "mean_word_length", "symbol_ratio", "digit_ratio", "punct_line_share", "common_share", "log_lines", "mean_line_words", "item_share", "number_end_share", "delimiters", "delimiter_spread", "vowelless_share", "single_share", "mixed_share", "letter_share", "capital_share", "long_share", "sentence_share")

_PASSAGE = re.compile(r"\n\s*\n")
_TOKEN = re.compile(r"\S+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_ASCII_WORD = re.compile(r"[a-z]+")
_ENDS = re.compile(r"[.!?…:;,][\"'”’»)\]]*$")
_SENTENCE = re.compile(r"[.!?…](?<=[^\W\d_][^\W\d_].)[\"'”’»)\]]*(?=\s|$)")
_ITEM = re.compile(r"\s*(?:[-*+•–]|\(?(?:\d{1,3}|[a-zA-Z]|[ivxlc]{1,7}|[IVXLC]{1,7})[.)]|\d{1,4}(?=\s+[^\W\d_]))\s+\S")
_NUMBER_END = re.compile(r"(?:[.\s]{3,}|,\s|\s)\d{1,4}$")
_DELIMITER = re.compile(r"\s?\|\s?|;|\t|,(?=\S)|(?<=\S) {2,}(?=\S)")
_ALNUM = re.compile(r"[^\W_]")
_LETTER = re.compile(r"[^\W\d_]")
_ROMAN = re.compile(r"^\s*(?:[ivxlc]{2,7}|[IVXLC]{2,7})\.\s", re.M)  # ends no sentence
_DIGIT, _CLOSE_COMMA = re.compile(r"\d"), re.compile(r",\S")
#: Words of three letters and more without a vowel.
_VOWELLESS = re.compile(r"(?<![^\W_])[^\W\d_aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüœ]{3,}(?![^\W\d_])")


def passages(text: str, title: str | None) -> list[str]:
    """The passages of a text parted by empty lines, without an opening line that repeats the title."""
    plain = text.replace("\r\n", "\n").replace("\r", "\n")
    parts = [p for p in _PASSAGE.split(plain) if p.strip()]
    if parts and title:
        letters = lambda s: "".join(c for c in s.casefold() if c.isalnum())
        first, _, rest = parts[0].strip().partition("\n")
        if letters(first) == letters(title):
            parts = ([rest] if rest.strip() else []) + parts[1:]
    return parts


def words_of(passage: str) -> int:
    """Words as the share of prose counts them: tokens with a letter or digit, or all tokens if none has."""
    tokens = passage.split()
    return sum(t[0].isalnum() or t[-1].isalnum() or _ALNUM.search(t) is not None for t in tokens) or len(tokens)


class Common:
    """Common words, each with the languages it belongs to."""

    def __init__(self, lists: dict[str, frozenset[str]]) -> None:
        self.languages = sorted(lists)
        masks: dict[str, int] = {}
        for i, lang in enumerate(self.languages):
            for w in lists[lang]:
                if len(w) > 1:  # single letters are no evidence
                    masks[w] = masks.get(w, 0) | 1 << i
        self.masks = masks

    def most(self, words: list[str]) -> int:
        """How many of the words are common in the language that has most of them."""
        found = Counter(map(self.masks.get, words))
        return max((sum(n for mask, n in found.items() if mask and mask >> i & 1) for i in range(len(self.languages))), default=0)


def statistics(text: str, common: Common) -> list[float]:
    """The FEATURES of one text; common_share is that of the language it fits best.  All 0 for an empty text."""
    tokens = text.split()
    lines = [x for x in map(str.rstrip, text.split("\n")) if x]
    if not tokens:
        return [0.0] * len(FEATURES)
    low = text.lower()
    words = _WORD.findall(low) if not text.isascii() or "'" in low else _ASCII_WORD.findall(low)
    sizes = list(map(len, tokens))
    n, m, k, chars = len(tokens), max(1, len(words)), len(lines), sum(sizes)
    signs = Counter(text)
    digits = sum(k for ch, k in signs.items() if ch.isdigit())
    letters = sum(k for ch, k in signs.items() if ch.isalpha())
    parted = signs["|"] or signs[";"] or signs["\t"] or "  " in text or (signs[","] and _CLOSE_COMMA.search(text))
    seps = [len(_DELIMITER.findall(x.lstrip())) for x in lines] if parted else [0] * k
    mean_sep = sum(seps) / k
    spread = (sum((s - mean_sep) ** 2 for s in seps) / k) ** 0.5
    lengths = list(map(len, words))
    return [
        math.log1p(n),
        min(40.0, sum(lengths) / m if words else chars / n),
        (chars - digits - letters) / chars,
        digits / chars,
        sum(bool(_ENDS.search(x[-8:])) for x in lines) / k,
        common.most(words) / max(m, n),
        math.log1p(k),
        min(60.0, n / k),
        sum(bool(_ITEM.match(x)) for x in lines) / k,
        sum(x[-1].isdigit() and bool(_NUMBER_END.search(x[-24:])) for x in lines) / k,
        min(20.0, mean_sep),
        min(5.0, spread / (mean_sep + 0.25)),
        len(_VOWELLESS.findall(low)) / max(1, m - lengths.count(1) - lengths.count(2)),
        sizes.count(1) / n,
        sum(not t.isalpha() and _DIGIT.search(t) is not None and _LETTER.search(t) is not None for t in tokens) / n if digits else 0.0,
        letters / chars,
        sum(map(str.isupper, [t[0] for t in tokens])) / n,
        sum(x > 20 for x in sizes) / n if max(sizes) > 20 else 0.0,
        (len(_SENTENCE.findall(text)) - len(_ROMAN.findall(text))) / (n / 10 + 1),
    ]


_AT = {f: i for i, f in enumerate(FEATURES)}


def weak_label(x: Sequence[float]) -> int:
    """Index into KINDS of a passage the labelling functions are sure of, -1 for the rest."""
    v = dict(zip(FEATURES, x, strict=True))
    lines, words = np.expm1(v["log_lines"]), np.expm1(v["log_words"])
    if v["common_share"] >= 0.1 and v["sentence_share"] >= 0.25 and v["letter_share"] > 0.7 and v["digit_ratio"] < 0.08 and words >= 8 and v["item_share"] < 0.2 and v["delimiters"] < 0.5:
        return 0
    if v["sentence_share"] >= 0.4 and v["letter_share"] > 0.9 and v["vowelless_share"] < 0.02 and v["mixed_share"] == 0 and words >= 12 and v["mean_line_words"] >= 6 and v["item_share"] == 0 and v["delimiters"] < 0.3 and 0.02 < v["capital_share"] < 0.3:
        return 0  # sentences of a language whose common words are not known
    if words >= 8 and (v["symbol_ratio"] > 0.7 or (v["single_share"] > 0.7 and v["common_share"] < 0.1 and v["digit_ratio"] < 0.5)):
        return 3
    if lines >= 3 and v["delimiters"] >= 0.9 and v["delimiter_spread"] < 0.35 and v["item_share"] < 0.2 and v["vowelless_share"] < 0.25 and v["mixed_share"] < 0.1 and v["single_share"] < 0.6 and v["digit_ratio"] > 0.05:
        return 2
    if lines >= 3 and (v["item_share"] >= 0.8 or v["number_end_share"] >= 0.8) and v["delimiters"] < 0.5 and v["vowelless_share"] < 0.2 and v["letter_share"] > 0.35 and v["mixed_share"] < 0.1:
        return 1
    if lines >= 4 and v["common_share"] >= 0.05 and v["sentence_share"] < 0.02 and v["punct_line_share"] < 0.1 and v["mean_line_words"] <= 10 and v["letter_share"] > 0.9 and v["delimiters"] < 0.3:
        return 1
    if v["common_share"] < 0.04 and words >= 8 and v["delimiters"] < 1.0 and (v["vowelless_share"] > 0.5 or v["symbol_ratio"] > 0.45 or v["mixed_share"] > 0.4 or v["single_share"] > 0.7 or (v["mean_word_length"] > 3 and v["letter_share"] > 0.9 and v["capital_share"] < 0.05 and v["punct_line_share"] < 0.2 and lines >= 3) or v["long_share"] > 0.6):
        return 3
    return -1


class Trees:
    """Multi-class gradient boosting: depth-limited trees over quantile bins, Newton leaf values."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, penalty: float = 1.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.penalty = rounds, depth, rate, bins, penalty
        self.temperature, self.bias = 1.0, np.zeros(len(KINDS))
        self.trees: list[list[tuple[list[tuple[int, float]], np.ndarray]]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        k = len(KINDS)
        weight = np.array([1.0 / max(1, (y == c).sum()) for c in range(k)])[y]
        weight *= len(y) / weight.sum()
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
        score = np.zeros((len(y), k))
        target = np.eye(k)[y]
        for _ in range(self.rounds):
            p = _softmax(score)
            level = []
            for c in range(k):
                tree = self._grow(binned, cuts, (p[:, c] - target[:, c]) * weight, np.maximum(p[:, c] * (1 - p[:, c]), 1e-6) * weight)
                level.append(tree)
                score[:, c] += _leaf(tree, x)
            self.trees.append(level)
        return self

    def _grow(self, binned: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> tuple[list[tuple[int, float]], np.ndarray]:
        """An oblivious tree: one split for each level, the same in all its nodes."""
        node, splits = np.zeros(len(g), np.int64), []
        for depth in range(self.depth):
            best = (-1.0, 0, 0)
            for f, cut in enumerate(cuts):
                if not len(cut):
                    continue
                width = len(cut) + 1
                key = node * width + binned[:, f]
                size = (1 << depth) * width
                gs = np.bincount(key, g, size).reshape(-1, width).cumsum(1)
                hs = np.bincount(key, h, size).reshape(-1, width).cumsum(1)
                left, hl, whole, hw = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = (left**2 / (hl + self.penalty) + (whole - left) ** 2 / (hw - hl + self.penalty) - whole**2 / (hw + self.penalty)).sum(0)
                at = int(gain.argmax())
                if gain[at] > best[0] + 1e-12:
                    best = (float(gain[at]), f, at)
            _, f, at = best
            threshold = float(cuts[f][at]) if len(cuts[f]) else 0.0
            splits.append((f, threshold))
            node = node * 2 + (binned[:, f] > at)
        size = 1 << self.depth
        value = -self.rate * np.bincount(node, g, size) / (np.bincount(node, h, size) + self.penalty)
        return splits, value

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(KINDS)))
        for level in self.trees:
            for c, tree in enumerate(level):
                out[:, c] += _leaf(tree, x)
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Trees:
        """Temperature and a bias for each class, by gradient descent on the holdout's log loss."""
        s, target = self.scores(x), np.eye(len(KINDS))[y]
        log_t, bias = 0.0, np.zeros(len(KINDS))
        for _ in range(300):
            z = s * np.exp(-log_t) + bias
            d = (_softmax(z) - target) / len(y)
            log_t -= 0.5 * (-(d * s).sum() * np.exp(-log_t) + 0.02 * log_t)
            bias -= 0.5 * (d.sum(0) + 0.02 * bias)
            log_t = float(np.clip(log_t, -1.5, 3.0))
        self.temperature, self.bias = float(np.exp(log_t)), bias
        return self

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _softmax(self.scores(x) / self.temperature + self.bias)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _leaf(tree: tuple[list[tuple[int, float]], np.ndarray], x: np.ndarray) -> np.ndarray:
    splits, value = tree
    node = np.zeros(len(x), np.int64)
    for f, t in splits:
        node = node * 2 + (x[:, f] > t)
    return value[node]


def common_lists(common_words: DataFrame) -> dict[str, frozenset[str]]:
    """The common words of each language; a table of fixed length."""
    rows = common_words.where("lang IS NOT NULL AND word IS NOT NULL").groupBy("lang").agg(F.collect_set(F.lower("word")).alias("w")).collect()
    return {r.lang: frozenset(r.w) for r in rows}


def _sampler(common: Common):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels, features = [], []
            for text, title in zip(b.column("text").to_pylist(), b.column("chapter_title").to_pylist(), strict=True):
                for p in passages(text, title):
                    x = statistics(p, common)
                    k = weak_label(x)
                    if k >= 0:
                        labels.append(k)
                        features.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(features, pa.list_(pa.float64()))], ["kind", "x"])

    return run


def train(chapters: DataFrame, common: Common, sample: int = SAMPLE) -> Trees:
    """Trees grown on up to ``sample`` weakly labelled passages of each kind, calibrated on the holdout.

    The sample is the passages with the least hash of their statistics, so it does not depend
    on partitioning; only it reaches the driver.  For kinds the data lack every second passage
    of the holdout stands in, which is then left out of the calibration.
    """
    some = training_rows(chapters, TRAIN_CHAPTERS, "book_id", "chapter_index")
    texts = spread(some.select("text", "chapter_title")).where("text IS NOT NULL AND trim(text) <> ''")
    labelled = texts.mapInArrow(_sampler(common), "kind int, x array<double>").withColumn("h", F.xxhash64("x", F.lit(4)))
    first = F.row_number().over(Window.partitionBy("kind").orderBy("h", "x"))
    rows = labelled.withColumn("rank", first).where(F.col("rank") <= sample).orderBy("kind", "rank").select("kind", "x").collect()
    hx = np.array([statistics(t, common) for t, _ in HOLDOUT])
    hy = np.array([KINDS.index(k) for _, k in HOLDOUT])
    x = np.array([r.x for r in rows]).reshape(-1, len(FEATURES))
    y = np.array([r.kind for r in rows], np.int64)
    lacking = np.array([i % 2 == 0 and not (y == k).any() for i, k in enumerate(hy)], bool)
    x, y = np.concatenate([x, hx[lacking]]), np.concatenate([y, hy[lacking]])
    return Trees().fit(x, y).calibrate(hx[~lacking], hy[~lacking])


_STATS = "book_id bigint, chapter_index int, words int, mean_word_length double, symbol_ratio double, punct_line_share double, common_share double, prose_words int, list_words int, table_words int, junk_words int, prose_probability double"


def _classifier(model: Trees, common: Common, details: bool):
    named = [x.split()[0] for x in _STATS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [passages(t, c) for t, c in zip(b.column("text").to_pylist(), b.column("chapter_title").to_pylist(), strict=True)]
            flat = [(i, p) for i, ps in enumerate(parts) for p in ps]
            x = np.array([statistics(p, common) for _, p in flat]).reshape(-1, len(FEATURES))
            prob = model.probabilities(x) if flat else np.zeros((0, len(KINDS)))
            size = np.array([words_of(p) for _, p in flat], np.int64)
            owner = np.array([i for i, _ in flat], np.int64)
            n, k = b.num_rows, len(KINDS)
            by_kind = np.bincount(owner * k + prob.argmax(1), size, n * k).reshape(n, k).astype(np.int64) if flat else np.zeros((n, k), np.int64)
            prose = np.bincount(owner, prob[:, 0] * size, n) / np.maximum(by_kind.sum(1), 1) if flat else np.zeros(n)
            whole = np.array([statistics("\n\n".join(p), common) for p in parts]).reshape(n, -1) if details else np.zeros((n, len(FEATURES)))
            of = lambda f: pa.array(whole[:, _AT[f]], pa.float64())
            yield pa.RecordBatch.from_arrays(
                [b.column("book_id"), b.column("chapter_index"), pa.array(by_kind.sum(1), pa.int32()), of("mean_word_length"), of("symbol_ratio"), of("punct_line_share"), of("common_share"), *[pa.array(by_kind[:, i], pa.int32()) for i in range(k)], pa.array(prose, pa.float64())],
                named,
            )

    return run


def chapter_quality(chapters: DataFrame, common_words: DataFrame, sample: int = SAMPLE, details: bool = True) -> DataFrame:
    """Statistics and kind of every chapter with text: (book_id, chapter_index, words, mean_word_length,
    symbol_ratio, punct_line_share, common_share, <kind>_words, prose_probability, kind).

    ``kind`` is prose unless most words stand in other passages, and then the kind most of
    those stand in (ties: list, table, junk).  Without ``details`` the statistics of the whole
    text are 0 and only the kind and the words are worked out.  Chapters without text are not listed; the
    title that opens a chapter counts for nothing.
    """
    common = Common(common_lists(common_words))
    model = train(chapters, common, sample)
    texts = spread(chapters.select("book_id", "chapter_index", "text", "chapter_title")).where("text IS NOT NULL AND trim(text) <> ''")
    rows = texts.mapInArrow(_classifier(model, common, details), _STATS)
    other = F.greatest("list_words", "table_words", "junk_words")
    kind = F.when((F.col("words") == 0) | (F.col("prose_words") * 2 >= F.col("words")), "prose")
    for k in KINDS[1:]:
        kind = kind.when(F.col(f"{k}_words") == other, k)
    return rows.withColumn("kind", kind)


def not_prose(chapters: DataFrame, common_words: DataFrame) -> DataFrame:
    """(book_id, chapter_index, kind) of the chapters that are no prose (query p4_found)."""
    return chapter_quality(chapters, common_words, details=False).where("kind <> 'prose'").select("book_id", "chapter_index", "kind").distinct()


def with_catalog(chapters: DataFrame, common_words: DataFrame) -> DataFrame:
    """chapter_quality beside the catalog's word_count and preview, and whether they fit the text."""
    plain = F.trim(F.regexp_replace("text", r"(?U)\s+", " "))
    counted = F.when(plain == "", 0).otherwise(F.size(F.split(plain, " ")))
    catalog = chapters.select("book_id", "chapter_index", "word_count", "preview", counted.alias("text_words"), (F.col("word_count") == counted).alias("count_fits"), F.startswith(plain, F.regexp_replace(F.trim("preview"), r"\s*(\.\.\.|…)$", "")).alias("preview_fits"))
    return chapter_quality(chapters, common_words).join(catalog, ["book_id", "chapter_index"])
