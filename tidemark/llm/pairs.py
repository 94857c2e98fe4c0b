"""Broken prompt and response pairs (problem 6).

The clauses of a response (the cleaned text, then the reading hint) are tagged as answer,
refusal, echo, foreign or unfinished by a linear-chain conditional random field; the words
its tags cover decide the defect of the pair.

No list of phrases tells a refusal.  Labelling functions are sure of pairs by their structure
alone: an answer far shorter than its passage and without its words declines, one as long as
the passage in another language is foreign.  On a bounded sample of those the words and word
pairs of clauses are weighed (how much likelier in a declined answer than in any other), and
the field is trained on structure and weight, every sequence also with its weights left out,
so that it neither needs nor only trusts words it has seen.  It decides all pairs, those the
labelling functions are not sure of included.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.tables import spread, training_rows

TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
DEFECTS = ("empty", "refusal", "other_language", "truncated", "copied")
#: Pairs that the field is trained on, of each weakly labelled defect and of sound ones; those with the least hashes.
SAMPLE = 120
#: Pairs that are labelled for training, at most, by the hash of their key; all are tagged.
TRAIN_PAIRS = 40_000
#: Clauses of a response that is trained on, at most; longer ones are only tagged.
TRAIN_CLAUSES = 16

# Marks a sound answer drops.
_MARK = re.compile(r"\(\s*(?:https?://|www\.)[^\s)]*\s*\)|https?://[^\s)\]}”\"]+|www\.[^\s)\]}”\"]*[^\s)\]}”\".,;:!?]|\([^()\d]{2,60}\b(?:1[4-9]|20)\d\d[a-z]?(?:,\s*(?:pp?|S|s)\.?\s*\d+(?:[-–]\d+)?)?\)|\[\^?\d{1,4}\]|\((?:see|cf\.?|siehe|voir|véase|vedi|ver|zie)\s+\w+\s+\d+\)|[¹²³⁴⁵⁶⁷⁸⁹⁰]+|(?<=\w)[†‡]|(?<=[.!?])[†‡*]+(?=\s|$)")
_MAY_MARK = re.compile(r"[(\[¹²³⁴⁵⁶⁷⁸⁹⁰†‡*]|https?:|www\.")
_CLAUSE = re.compile(r"[^.!?…]*[.!?…]+[\"'”’»)\]]*(?=\s|$)|[^.!?…]+(?:[.!?…]+(?=\S))?|[.!?…]+")
_WORD = re.compile(r"\w+")
_PAGE = re.compile(r"\n\s*\d{1,4}\s*\n")
_STOP = re.compile(r"[.!?][\"'”’»)\]]*\s*$")

FEATURES = ("bias", "known_all", "known_part", "known_none", "language_same", "language_other", "language_unknown", "marked", "marks_kept", "marks_dropped", "first", "last", "open_end", "cut_short", "passage_open", "hint", "hint_copies", "alone", "last_cut", "cut_open", "verbatim", "reworded", "reworded_other", "kept_mark", "hint_own", "tiny", "short", "full", "alien_tiny", "alien_short", "alien_full", "alien_behind", "declines", "tells", "alien_declines", "alien_tells", "alien_tells_other")
_AT = {f: i for i, f in enumerate(FEATURES)}


def _without_ends(m: re.Match) -> str:
    return re.sub(r"[.!?…]", "_", m[0])


def clauses(text: str) -> list[str]:
    """The clauses of a text: sentences with their end marks; pieces without a word go with the one before."""
    out: list[str] = []
    whole = _MARK.sub(_without_ends, text) if _MAY_MARK.search(text) else text  # a mark ends no sentence
    for m in _CLAUSE.finditer(whole):
        piece = text[m.start() : m.end()].strip()
        if not piece:
            continue
        if out and not _WORD.search(piece):
            out[-1] += piece
        else:
            out.append(piece)
    return out


@lru_cache(maxsize=8)
def _union(lists: tuple[frozenset[str], ...]) -> frozenset[str]:
    return frozenset().union(*lists)


def _marks(text: str) -> list[str]:
    """The marks of a text; most texts have no character that begins one."""
    return _MARK.findall(text) if _MAY_MARK.search(text) else []


def _unmarked(text: str) -> str:
    return _MARK.sub(" ", text) if _MAY_MARK.search(text) else text


def _language(words: list[str], common: dict[str, frozenset[str]]) -> tuple[str | None, dict[str, int]]:
    every = _union(tuple(common.values()))
    words = [w for w in words if w in every]
    votes = {k: sum(w in c for w in words) for k, c in common.items()}
    best = max(votes.values(), default=0)
    return (next(k for k, v in sorted(votes.items()) if v == best) if best else None), votes


Weights = dict[str, float]


def _weight(words: list[str], weights: Weights) -> float:
    """The log of how much likelier the words of a clause are in a declined answer; 0 for unknown words."""
    return sum(weights.get(w, 0.0) for w in words) + sum(weights.get(f"{a} {b}", 0.0) for a, b in zip(words, words[1:], strict=False))


def describe(raw: str | None, cleaned: str | None, instruct: str | None, common: dict[str, frozenset[str]], weights: Weights | None = None) -> tuple[np.ndarray, list[int]]:
    """(feature rows, [clauses of the cleaned text, words of each clause]) of a response: the clauses of the
    cleaned text, then those of the hint.  An alien clause holds few words of the passage."""
    raw, cleaned, instruct = raw or "", cleaned or "", instruct or ""
    plain = _unmarked(_PAGE.sub("\n", raw) if "\n" in raw else raw)
    raw_words = _WORD.findall(plain.lower())
    all_words = _WORD.findall(raw.lower()) if plain is not raw else raw_words
    raw_set = set(all_words) | set(raw_words)
    raw_text = " " + " ".join(raw_words) + " "
    raw_whole = " " + " ".join(all_words) + " "
    language, _ = _language(raw_words, common)
    marks, kept = len(_marks(raw)), len(_marks(cleaned))
    own = clauses(cleaned)
    cleaned_words = _WORD.findall(_unmarked(cleaned).lower())
    short = len(raw_words) - len(cleaned_words) >= 4 and len(cleaned_words) < 0.85 * len(raw_words)
    open_passage = not _STOP.search(plain.strip())
    size = "tiny" if len(cleaned_words) < 0.4 * len(raw_words) else "short" if len(cleaned_words) < 0.75 * len(raw_words) else "full"

    def inside(clause: str, words: list[str]) -> bool:  # the last word may be cut
        if " " + " ".join(words) in raw_whole:
            return True
        bare = _unmarked(clause)
        return " " + " ".join(words if bare is clause else _WORD.findall(bare.lower())) in raw_text

    spoken_words = [_WORD.findall(c.lower()) for c in own]
    verbatims = [inside(c, w) for c, w in zip(own, spoken_words, strict=True)]
    pooled = [x for w, v in zip(spoken_words, verbatims, strict=True) if not v for x in w]
    spoken, own_votes = _language(pooled, common)
    best = max(own_votes.values(), default=0)
    same = language is None or spoken is None or own_votes.get(language, 0) == best
    heard = "language_unknown" if language is None or best < 2 else "language_same" if same else "language_other"
    rows, sizes = [], []
    for i, clause in enumerate([*own, *clauses(instruct)]):
        hint = i >= len(own)
        words = _WORD.findall(clause.lower()) if hint else spoken_words[i]
        known = sum(w in raw_set for w in words) / max(1, len(words))
        verbatim = inside(clause, words) if hint else verbatims[i]
        on = {"bias", "known_all" if known >= 0.9 else "known_part" if known >= 0.5 else "known_none", "verbatim" if verbatim else "reworded"}
        on.add("language_unknown" if hint else "language_same" if verbatim else heard)  # clauses that are not the passage's are heard together
        other = not verbatim and "language_other" in on
        last = i == len(own) - 1
        if marks:
            on.add("marks_kept" if kept * 2 > marks else "marks_dropped")
        if _marks(clause):
            on |= {"marked", "kept_mark"} if "marks_kept" in on else {"marked"}
        on |= {name for name, yes in (("first", i == 0), ("last", last), ("open_end", not _STOP.search(clause)), ("passage_open", open_passage), ("reworded_other", other)) if yes}
        if hint:
            grams = [" " + " ".join(words[j : j + 4]) + " " for j in range(len(words) - 3)]
            copies = bool(grams) and sum(g in raw_text or g in raw_whole for g in grams) >= 0.6 * len(grams)
            on |= {"hint", "hint_copies" if copies else "hint_own"}
        else:
            on |= {size, *(["cut_short"] if short else []), *(["alone"] if len(own) == 1 else [])}
            if last and short:
                on |= {"last_cut", *(["cut_open"] if not _STOP.search(clause) else [])}
            alien = not verbatim and "known_none" in on
            if alien:
                on |= {f"alien_{size}", *(["alien_behind"] if any(verbatims[:i]) else [])}
            if weights and not verbatim:
                w = _weight(words, weights)
                on |= {"declines", *(["alien_declines"] if alien else [])} if w > 3 else {"tells", *(["alien_tells"] if alien else []), *(["alien_tells_other"] if alien and other else [])} if w < -3 else set()
        x = np.zeros(len(FEATURES), np.float32)
        x[[_AT[f] for f in on]] = 1
        rows.append(x)
        sizes.append(len(words))
    return np.array(rows, np.float32).reshape(-1, len(FEATURES)), [len(own), *sizes]


def weak_tags(x: np.ndarray) -> list[int]:
    """The tag of each clause by the labelling functions, -1 where they are not sure; they see structure and no words."""
    out = []
    own = [r for r in x if not r[_AT["hint"]]]
    declined = bool(own) and all(r[_AT["alien_tiny"]] for r in own)
    for r in x:
        on = lambda f: r[_AT[f]] > 0  # noqa: B023, E731
        if on("hint"):
            tag = "echo" if on("hint_copies") else "answer"
        elif declined:
            tag = "refusal"
        elif on("known_none") and on("reworded"):
            tag = "foreign" if on("language_other") and (on("alien_full") or on("alien_behind")) else None
        elif on("kept_mark"):
            tag = "echo"
        elif on("last_cut"):
            tag = "unfinished"
        elif on("verbatim") or (on("known_all") and not on("language_other")):
            tag = "answer"
        else:
            tag = None
        out.append(-1 if tag is None else TAGS.index(tag))
    return out


class Field:
    """A linear-chain conditional random field over TAGS, trained in padded batches."""

    def __init__(self) -> None:
        k = len(TAGS)
        self.emit, self.move = np.zeros((len(FEATURES), k)), np.zeros((k, k))

    def fit(self, rows: list[np.ndarray], tags: list[list[int]], steps: int = 100, rate: float = 0.15, penalty: float = 1e-4) -> Field:
        """Adam on the mean log likelihood of the sequences."""
        n, k = len(rows), len(TAGS)
        if not n:
            return self
        width = max(len(r) for r in rows)
        x = np.zeros((n, width, len(FEATURES)), np.float32)
        y, mask = np.zeros((n, width), np.int64), np.zeros((n, width))
        for i, (r, t) in enumerate(zip(rows, tags, strict=True)):
            x[i, : len(r)], y[i, : len(r)], mask[i, : len(r)] = r, t, 1
        hot = np.eye(k)[y] * mask[..., None]
        flat = x.reshape(-1, len(FEATURES)).astype(float)
        want_move = np.einsum("nti,ntj->ij", hot[:, :-1], hot[:, 1:])
        want_emit = flat.T @ hot.reshape(-1, k)
        state = [np.zeros_like(self.emit), np.zeros_like(self.emit), np.zeros_like(self.move), np.zeros_like(self.move)]
        for step in range(1, steps + 1):
            unary = (flat @ self.emit).reshape(n, width, k)
            node, pair = self._marginals(unary, mask)
            grads = ((flat.T @ node.reshape(-1, k) - want_emit) / n + penalty * self.emit, (pair - want_move) / n + penalty * self.move)
            for w, g, (m, v) in ((self.emit, grads[0], state[:2]), (self.move, grads[1], state[2:])):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return self

    def _marginals(self, unary: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, width, k = unary.shape
        a, b = np.zeros_like(unary), np.zeros_like(unary)
        a[:, 0] = unary[:, 0]
        for t in range(1, width):
            step = _lse(a[:, t - 1, :, None] + self.move[None], 1) + unary[:, t]
            a[:, t] = np.where(mask[:, t, None] > 0, step, a[:, t - 1])
        z = _lse(a[:, -1], 1)
        for t in range(width - 2, -1, -1):
            step = _lse(self.move[None] + (unary[:, t + 1] + b[:, t + 1])[:, None, :], 2)
            b[:, t] = np.where(mask[:, t + 1, None] > 0, step, 0.0)
        node = np.exp(a + b - z[:, None, None]) * mask[..., None]
        pair = np.zeros((k, k))
        for t in range(1, width):
            joint = np.exp(a[:, t - 1, :, None] + self.move[None] + (unary[:, t] + b[:, t])[:, None, :] - z[:, None, None])
            pair += (joint * mask[:, t, None, None]).sum(0)
        return node, pair

    def tag(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        """The best tags of each sequence (Viterbi), sequences of one length together."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(rows)
        by_length: dict[int, list[int]] = {}
        for i, r in enumerate(rows):
            if len(r):
                by_length.setdefault(len(r), []).append(i)
        for length, members in by_length.items():
            u = np.stack([rows[i] for i in members]) @ self.emit
            score, back = u[:, 0], []
            for t in range(1, length):
                s = score[:, :, None] + self.move[None]
                back.append(s.argmax(1))
                score = s.max(1) + u[:, t]
            path = np.zeros((len(members), length), np.int64)
            path[:, -1] = score.argmax(1)
            for t in range(length - 2, -1, -1):
                path[:, t] = back[t][np.arange(len(members)), path[:, t + 1]]
            for j, i in enumerate(members):
                out[i] = path[j]
        return out


def _lse(z: np.ndarray, axis: int) -> np.ndarray:
    top = z.max(axis, keepdims=True)
    return (np.log(np.exp(z - top).sum(axis, keepdims=True)) + top).squeeze(axis)


def defect(tags: np.ndarray, sizes: list[int]) -> str | None:
    """The defect of a pair by the words its tags cover: the share of refusal, of foreign clauses at
    the end, an unfinished last clause, any echo in the answer or echo in most of the hint."""
    own, words = sizes[0], sizes[1:]
    total = sum(words[:own])
    if not total:
        return "empty"
    cover = {t: sum(n for k, n in zip(tags[:own], words[:own], strict=True) if k == i) / total for i, t in enumerate(TAGS)}
    if cover["refusal"] >= 0.5:
        return "refusal"
    if cover["foreign"] >= 0.25:
        return "other_language"
    if own and tags[own - 1] == TAGS.index("unfinished"):
        return "truncated"
    hint = sum(words[own:])
    echoed = sum(n for k, n in zip(tags[own:], words[own:], strict=True) if k == TAGS.index("echo"))
    if cover["echo"] > 0 or (hint and echoed >= 0.5 * hint):
        return "copied"
    return None


def _texts(b: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(b.column(c).to_pylist() for c in ("raw_text", "cleaned_text", "instruct")), strict=True)


def _sampler(common: dict[str, frozenset[str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, pairs = [], []
            for n, pair in enumerate(_texts(b)):
                if n % 16 and plainly_sound(*pair):  # some of the plainly sound ones are enough
                    continue
                x, sizes = describe(*pair, common)
                t = weak_tags(x)
                if 0 < len(x) <= TRAIN_CLAUSES and min(t) >= 0:
                    kinds.append(defect(np.array(t), sizes) or "sound")
                    pairs.append(dict(zip(("raw_text", "cleaned_text", "instruct"), pair, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(pairs, pa.struct([(c, pa.string()) for c in ("raw_text", "cleaned_text", "instruct")]))], ["kind", "pair"])

    return run


def weigh(clauses_by_kind: list[tuple[list[str], bool]]) -> Weights:
    """Log odds of words and word pairs in clauses of declined answers (True) against all others, smoothed;
    a word that neither side prefers twofold has no weight."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for words, declined in clauses_by_kind:
        counts[declined].update({*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))})
    sides = [max(1, sum(d == k for _, d in clauses_by_kind)) for k in (False, True)]
    odds = {w: math.log((counts[1][w] + 0.5) / (sides[1] + 1)) - math.log((counts[0][w] + 0.5) / (sides[0] + 1)) for w in counts[0].keys() | counts[1].keys()}
    return {w: v for w, v in odds.items() if abs(v) > math.log(2)}


FOLDS = 4


def fit(pairs: list[tuple[str | None, str | None, str | None]], common: dict[str, frozenset[str]]) -> tuple[Field, Weights]:
    """Field and weights of surely labelled pairs.

    A pair is described with the weights of clauses of other folds, which are made by the
    clause, so that no clause is weighed by itself; and once more without any weights.
    """
    read = [(p, describe(*p, common)) for p in pairs]
    tagged = [(p, x, weak_tags(x)) for p, (x, _) in read]
    spoken = [(_WORD.findall(c.lower()), TAGS[t] == "refusal") for p, x, tags in tagged for c, t, r in zip(clauses(p[1] or ""), tags, x, strict=False) if not r[_AT["hint"]]]
    fold = lambda words: zlib.crc32(" ".join(words).encode()) % FOLDS
    parts = [weigh([s for s in spoken if fold(s[0]) != k]) for k in range(FOLDS)]
    rows, tags = [x for _, x, _ in tagged], [t for *_, t in tagged]
    for p, x, t in tagged:
        first = next(iter(clauses(p[1] or "")), "")
        rows.append(describe(*p, common, parts[fold(_WORD.findall(first.lower()))])[0])
        tags.append(t)
    return Field().fit(rows, tags), weigh(spoken)


def train(pairs: DataFrame, common: dict[str, frozenset[str]], sample: int = SAMPLE) -> tuple[Field, Weights]:
    """Field and weights from up to ``sample`` surely labelled pairs of each kind; only they reach the driver."""
    labelled = pairs.mapInArrow(_sampler(common), "kind string, pair struct<raw_text:string,cleaned_text:string,instruct:string>").distinct().withColumn("h", F.xxhash64("pair"))
    first = F.row_number().over(Window.partitionBy("kind").orderBy("h", "pair"))
    rows = labelled.withColumn("rank", first).where(F.col("rank") <= sample).orderBy("kind", "rank").select("pair").collect()
    return fit([tuple(r.pair) for r in rows], common)


#: What lies between words, as far as it is dropped before texts are compared; anything else tells them apart.
_BETWEEN = dict.fromkeys(map(ord, " \t\r\n\u00a0.,;:!?-–—…'\"()[]{}«»“”„‘’¿¡"))


@lru_cache(maxsize=4096)
def _runs(hint: str) -> tuple[str, ...]:
    """The runs of four words of a hint, without what lies between the words."""
    words = _WORD.findall(hint.lower())
    return tuple("".join(words[i : i + 4]).translate(_BETWEEN) for i in range(len(words) - 3))


def plainly_sound(raw: str | None, cleaned: str | None, instruct: str | None) -> bool:
    """Whether a pair is sound beyond doubt: the answer is the passage letter by letter without its marks and page
    numbers, holds no mark itself, and the hint shares no four words with the passage.

    Such pairs have answer clauses only; the field is asked about all others.
    """
    if not raw or not cleaned:
        return False
    if raw != cleaned or _MAY_MARK.search(raw) or "\n" in raw:
        if _marks(cleaned):
            return False
        bare = _unmarked(_PAGE.sub("\n", raw) if "\n" in raw else raw)
        if bare != cleaned and bare.translate(_BETWEEN) != cleaned.translate(_BETWEEN):
            return False
    else:
        bare = raw
    runs = _runs(instruct) if instruct else ()
    if runs:
        whole = [t.lower().translate(_BETWEEN) for t in {raw, bare}]
        if any(r in t for t in whole for r in runs):
            return False
    return _WORD.search(cleaned) is not None


_DDL = "book_id bigint, chapter_index int, chunk_index int, defect string, answer_share double, label string"


def _tagger(field: Field, weights: Weights, common: dict[str, frozenset[str]], sound: bool):
    """``sound``: whether plainly sound pairs are listed too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4000):
                part, pairs = b.slice(at, 4000), list(_texts(b.slice(at, 4000)))
                doubtful = [i for i, p in enumerate(pairs) if not plainly_sound(*p)]
                read = [describe(*pairs[i], common, weights) for i in doubtful]
                tags = field.tag([x for x, _ in read])
                labels = [weak_tags(x) for x, _ in read]
                weak = [(defect(np.array(t), s) or "sound") if min(t, default=0) >= 0 else None for t, (_, s) in zip(labels, read, strict=True)]
                share = [float(sum(n for k, n in zip(t[: s[0]], s[1:], strict=False) if k == 0) / max(1, sum(s[1 : s[0] + 1]))) for t, (_, s) in zip(tags, read, strict=True)]
                rows = dict(zip(doubtful, zip([defect(t, s) for t, (_, s) in zip(tags, read, strict=True)], share, weak, strict=True), strict=True))
                shown = list(range(len(pairs))) if sound else doubtful
                cols = list(zip(*(rows.get(i, (None, 1.0, "sound")) for i in shown), strict=True)) if shown else [(), (), ()]
                index = pa.array(shown, pa.int64())
                yield pa.RecordBatch.from_arrays([*[part.column(c).take(index) for c in _KEY], *[pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.float64(), pa.string()), strict=True)]], [*_KEY, "defect", "answer_share", "label"])

    return run


_KEY = ("book_id", "chapter_index", "chunk_index")


def _model(cleaned_chunks: DataFrame, common: dict[str, frozenset[str]], sample: int) -> tuple[Field, Weights]:
    some = training_rows(cleaned_chunks, TRAIN_PAIRS, *_KEY)
    return train(spread(some.select("raw_text", "cleaned_text", "instruct")), common, sample)


def _tagged(cleaned_chunks: DataFrame, common_words: DataFrame, sample: int, sound: bool) -> DataFrame:
    from tidemark.llm.quality import common_lists

    common = common_lists(common_words)
    field, weights = _model(cleaned_chunks, common, sample)
    rows = spread(cleaned_chunks.select(*_KEY, "raw_text", "cleaned_text", "instruct"))
    return rows.mapInArrow(_tagger(field, weights, common, sound), _DDL)


def pair_defects(cleaned_chunks: DataFrame, common_words: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(book_id, chapter_index, chunk_index, defect, answer_share, label) of every pair, defect NULL where it is
    sound; label is what the labelling functions alone say, NULL where they are not sure.

    Defects: empty, refusal, other_language, truncated, copied; one at most, in this order.  A
    NULL answer is empty, a NULL hint none, and with a NULL passage nothing in the answer is
    known.  Exact copies give one row; different answers under one key a row each.
    """
    return _tagged(cleaned_chunks, common_words, sample, True).distinct()


def defective_pairs(cleaned_chunks: DataFrame, common_words: DataFrame) -> DataFrame:
    """One row for each defective pair (query p6_found); of several answers under a key the defect first in DEFECTS."""
    found = _tagged(cleaned_chunks, common_words, SAMPLE, False).where("defect IS NOT NULL").select(*_KEY, "defect").distinct()
    rank = F.array_position(F.array(*map(F.lit, DEFECTS)), F.col("defect"))
    return found.groupBy("book_id", "chapter_index", "chunk_index").agg(F.min_by("defect", rank).alias("defect"))
