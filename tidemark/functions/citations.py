"""Citations, callouts and headings of reference sections, told by words and brackets.

A text is scanned once for its innermost bracketed groups; what a group is, is decided by its
words.  The same predicates serve columns (as Arrow UDFs) and the operators on notes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

# Headings of reference sections and of what follows them, words of imprints, particles of names, cues.
REFERENCE_HEADINGS = ("reference", "references", "bibliography", "works cited", "works consulted", "literature cited", "notes and references", "notes and bibliography", "citations", "further reading", "sources")
RESUME_HEADINGS = ("acknowledgment", "acknowledgments", "acknowledgement", "acknowledgements", "about the author", "conclusion", "afterword", "epilogue", "glossary", "index", "appendix", "appendices")
NOTES_HEADINGS = ("notes", "footnotes", "endnotes")
IMPRINTS = ("press", "university", "verlag", "macmillan", "urbanomic", "publisher", "editionen", "madra", "tuttle", "bloomsbury", "columbia", "athlone", "semiotext", "harper", "princeton", "cambridge", "oxford")
NOTE_IMPRINTS = IMPRINTS[:9]
PARTICLES = ("van", "von", "de", "der", "da", "di", "del", "bin", "al")
PRONOUNS = ("he", "she", "it", "they", "we", "i", "this", "that", "these", "those")
LEAD_CUES, SOFT_CUES = ("for example", "such as"), ("tandem",)

#: Spaces of a heading's margin, and marks of emphasis and ends around it.
_EDGE = " \t*_\"':.#"
NUMBER = r"\d+[a-z]?"
#: A pointer to notes, with the numbers as its group.
POINTER = re.compile(rf"[\[(]{{0,2}}\s*\bsee\s+notes?\s+({NUMBER}(?:\s*[-–—,;]\s*{NUMBER})*)(?:\s+below\b)?\s*[\])]{{0,2}}", re.I)


def heading(line: str) -> str:
    """The words of a heading in lower case, without marks of Markdown and emphasis."""
    return " ".join(line.strip().strip(_EDGE).lower().split())


def opens_references(line: str) -> bool:
    return heading(line) in REFERENCE_HEADINGS


def resumes(line: str) -> bool:
    """Whether a heading ends a reference section: a listed one, or an appendix with its letter or number."""
    words = heading(line)
    first, _, rest = words.partition(" ")
    return words in RESUME_HEADINGS or (first in RESUME_HEADINGS[-2:] and rest.isalnum())


def heading_words(line: Column) -> Column:
    """``heading`` as a column expression."""
    return F.regexp_replace(F.lower(F.trim(F.trim(line), F.lit(_EDGE))), r"\s+", " ")


def opens_references_column(line: Column) -> Column:
    return F.coalesce(heading_words(line).isin(*REFERENCE_HEADINGS), F.lit(False))


def resumes_column(line: Column) -> Column:
    words = heading_words(line)
    parts = F.split(words, " ")
    lettered = parts[0].isin(*RESUME_HEADINGS[-2:]) & (F.size(parts) == 2) & parts[1].rlike("^[a-z0-9]+$")
    return F.coalesce(words.isin(*RESUME_HEADINGS) | lettered, F.lit(False))


# --- words -----------------------------------------------------------------------------


def _page(word: str) -> bool:
    """A page or a span of pages, such as 53, 12a or 53–58."""
    parts = [p.strip() for p in re.split("[-–—]", word)]
    return 1 <= len(parts) <= 2 and all(p and (p.isdigit() or (p[:-1].isdigit() and p[-1].isalpha())) for p in parts)


def _year(word: str) -> bool:
    bare = word[:-1] if len(word) == 5 and word[-1].isalpha() else word
    return len(bare) == 4 and bare.isdigit() and 1800 <= int(bare) <= 2099


def _paged(text: str) -> bool:
    """Whether a text names a page by p. or pp."""
    words = text.lower().replace("p.", "p. ").split()
    return any(w.lstrip("([,;") in ("p.", "pp.") and after[:1].isdigit() for w, after in zip(words, words[1:], strict=False))


def _name_word(word: str) -> bool:
    return len(word) > 1 and word[0].isupper() and all(c.isalpha() or c in "'’.-" for c in word)


def _name(words: list[str]) -> bool:
    """Whether words are one author: capitalised words with particles between them, et al. behind."""
    if words[-2:] in (["et", "al."], ["et", "al"]):
        words = words[:-2]
    return bool(words) and _name_word(words[0]) and all(_name_word(w) or w in PARTICLES for w in words)


def _innermost(text: str, opening: str, closing: str) -> Iterator[tuple[int, int]]:
    at = -1
    for i, c in enumerate(text):
        if c == opening:
            at = i
        elif c == closing and at >= 0:
            yield at, i + 1
            at = -1


def groups(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, inner text) of the innermost parentheses, and of the innermost brackets outside them, in order."""
    round_ = list(_innermost(text, "(", ")"))
    square, inside = [], iter(round_)
    current = next(inside, None)
    for a, b in _innermost(text, "[", "]"):
        while current and current[1] <= a:
            current = next(inside, None)
        if not (current and current[0] < a and b <= current[1]):
            square.append((a, b))
    for a, b in sorted(round_ + square):
        yield a, b, text[a + 1 : b - 1]


# --- citations in running text ---------------------------------------------------------


def _short_citation(inner: str) -> bool:
    """(Author, 1999, p. 12)"""
    before, _, pages = inner.rpartition(",")
    words = before.replace(",", " ").split()
    mark, _, page = pages.strip().partition(".")
    return len(words) >= 2 and _year(words[-1]) and _name(words[:-1]) and mark.lower() in ("p", "pp") and _page(page.strip())


def _bibliographic(inner: str) -> bool:
    """Whether a parenthesis of some length is a reference: an imprint, pages, an editor or translator, or see also."""
    if not 12 <= len(inner) <= 900:
        return False
    low = inner.lower()
    words = [w.strip(",;:[]()") for w in low.split()]
    tail = [p.rsplit(",", 1)[-1].strip() for p in inner.split(";") if "," in p]
    return bool(set(words) & set(IMPRINTS)) or _paged(inner) or any(_page(t) and not _year(t) for t in tail) or "see also" in low or "see especially" in low or "tr." in words or bool({"ed.", "eds."} & set(words) and "[" in inner)


def _without_pages(text: str) -> str:
    head, comma, last = text.rpartition(",")
    last = last.strip()
    bare = last.partition(".")[2].strip() if last.lower().startswith(("p.", "pp.")) else last
    return head if comma and _page(bare) and not _year(bare) else text


def shorten(inner: str) -> str:
    """A reference in parentheses as ``Author in Work``; the author alone, or nothing, if no more can be told."""
    first = inner.split(";")[0]
    first = re.sub(r"\[[^\]]*\]", "", first)
    parts = [p.strip() for p in _without_pages(first.strip().rstrip(",.;")).split(",")]
    parts = [p for p in parts if p and not p.startswith("tr. ")]
    while parts and (lead := parts[0].split(" ", 1))[0].lower().rstrip(".") in ("see", "especially", "also", "cf", "in") and len(lead) == 2:
        parts[0] = lead[1]
    if not parts:
        return ""
    if len(parts) == 1:
        return parts[0] if len(parts[0].split()) <= 12 else ""
    author, work = parts[0], parts[1].strip("\"'“”‘’")
    if len(work.split()) > 20:
        work = re.split("[:;]", work)[0].strip()
    return f"{author} in {work}" if work and len(work.split()) <= 20 else author


def _author_before(text: str, at: int) -> int | None:
    """Where the name of two words and more begins that stands before ``at``; None if there is none."""
    words = list(re.finditer(r"\S+", text[max(0, at - 120) : at].rpartition("\n")[2]))
    taken = 0
    while taken < len(words) and (_name_word(w := words[-1 - taken][0]) or w in (*PARTICLES, "et", "al.")):
        taken += 1
    while taken and not _name_word(words[-taken][0]):
        taken -= 1
    if taken < 2:
        return None
    return at - (words[-1].end() - words[-taken].start()) - (len(text[:at]) - len(text[:at].rstrip()))


def simplify(text: str, year_words: Callable[[int], str]) -> str:
    """Inline citations reduced: ellipses of editors, numbers in brackets and author-year-page parentheses go, a
    full citation is said in words, long references become author and work; the spaces they leave are repaired."""
    out, at = [], 0
    for start, end, inner in groups(text):
        if start < at:
            continue
        plain, keep = inner.strip(), None
        margin = start - len(text[at:start]) + len(text[at:start].rstrip()) if start > at else start
        if text[start] == "[":
            numbers = [x.strip() for x in re.split("[-–,;]", plain)]
            if plain in ("...", "…"):
                keep, margin = "", start
            elif all(x.isdigit() for x in numbers):
                keep = ""
        elif _year(plain) and plain.isdigit() and text.startswith(". ", end) and (name := _author_before(text, start)) is not None and name >= at:
            stop = text.find(".", end + 2)
            body = text[end + 2 : stop if stop >= 0 else len(text)]
            marked = re.match(r"\.\s*\d+[a-z]?(?:\s*[-–—]\s*\d+[a-z]?)?\.?", text[stop:]) if stop >= 0 else None
            first = body.split()[0].lower().rstrip(",;:") if body.split() else ""
            if marked and body[-2:].lower() in (" p", "pp", ",p") and 8 <= len(body) <= 242 and "\n" not in body and "," in body and first not in PRONOUNS:
                keep, margin, end = f"Wrote {text[name:start].strip()} in {year_words(int(plain))}.", name, stop + marked.end()
        elif _short_citation(plain):
            keep = ""
        elif _bibliographic(inner):
            keep, margin = (f"({s})" if (s := shorten(inner)) else ""), start
        if keep is not None:
            out += [text[at:margin], keep]
            at = end
    whole = "".join(out) + text[at:]
    return re.sub(r"\s+([.,;:])", r"\1", re.sub(r"[ \t]{2,}", " ", whole))


def say_examples(text: str) -> str:
    """A list of titles in parentheses read out when a cue stands right before it, left alone otherwise."""
    out, at = [], 0
    for start, end, inner in groups(text):
        items = [x.strip() for x in inner.split(",")]
        if text[start] != "(" or len(items) < 2 or not all(x and all(w[0].isupper() for w in x.split()) for x in items):
            continue
        before = text[at:start].rstrip()
        lead = next((c for c in LEAD_CUES if before.lower().endswith(c)), None)
        if lead or before.lower().endswith(SOFT_CUES):
            out += [before[: len(before) - len(lead)] if lead else before + " ", "for example " + ", ".join(items)]
            at = end
    return "".join(out) + text[at:]


# --- notes -----------------------------------------------------------------------------


def citation_only(note: str) -> bool:
    """Whether a note holds no prose of its own: two of five signals (pages, an imprint in parentheses, a link, a
    line that begins with See, an author in front), or few words and one of the first three; never over 80 words."""
    text = note.strip()
    words, low = text.split(), text.lower()
    if not words or len(words) > 80:
        return not words
    lines = text.split("\n")
    ends = [x.rstrip(" .").rpartition(",") for x in lines]
    pages = _paged(text) or any(comma and _page(tail.strip()) for _, comma, tail in ends)
    imprint = any(text[a] == "(" and any(w in inner.lower() for w in NOTE_IMPRINTS) for a, _, inner in groups(text))
    link = "http://" in low or "https://" in low or "www." in low
    see = any(x.startswith("See ") and x[4:].lstrip()[:1].isupper() for x in lines)
    initials = [w for w in words[:4] if len(w) == 2 and w[0].isupper() and w[1] == "."]
    front = text.partition(",")[0].split() if "," in text else []
    author = (words[0] in initials and len(words) > len(initials) and _name_word(words[len(initials)].rstrip(","))) or (1 <= len(front) <= 2 and all(map(_name_word, front)))
    signals = [pages, imprint, link, see, author]
    return sum(signals) >= 2 or (len(words) <= 25 and any(signals[:3]))


_POINTED = re.compile(r"[ \t]*" + POINTER.pattern, re.I)


def without_callouts(text: str) -> str:
    """The text without lines that are a note's number and without pointers to notes."""
    lines = ["" if (x := line.strip()).isdigit() and len(x) <= 3 and not line[:1].isspace() else line for line in text.split("\n")]
    return _POINTED.sub("", "\n".join(lines))


def _udf(f: Callable[[str], object], kind) -> Callable[[Column], Column]:
    @F.pandas_udf(kind)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda t: t if t is None else f(t))

    return run


def _simplified(text: str) -> str:
    from tidemark.functions.text import year_words

    return simplify(text, year_words)


simplify_column = _udf(_simplified, StringType())
say_examples_column = _udf(say_examples, StringType())
without_callouts_column = _udf(without_callouts, StringType())
citation_only_column = _udf(citation_only, BooleanType())
