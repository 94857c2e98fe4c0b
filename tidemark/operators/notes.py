"""Notes of documents: blocks and notes out of flat text, and notes moved to where they are called.

A text is labelled line by line; regions, entries and paragraphs are then running counts over
the labels, and who owns a note is decided by its first call.  Chapters are worked on one at a
time in Arrow batches, and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.functions import citations as C

#: (region, label of a line) to the region from that line on; any other pair changes nothing.
_REGIONS = {("body", "notes"): "notes", ("references", "notes"): "notes", ("notes", "references"): "references", ("body", "references"): "references", ("notes", "resumes"): "body", ("references", "resumes"): "body"}
_DOTTED = re.compile(r"\d+(?:\.\d+)+\s+\S")
_GLUED = re.compile(r"(?<=[^\W\d_]{3})(['’\"”]?)(\d{1,2})(?![\d])(?!\.\d)")


def label(line: str) -> str:
    """What a line is by itself: blank, call (a number alone), section (a dotted number and words), entry (a
    number, a full stop and words), notes, references, resumes or text."""
    plain = line.strip()
    number, dot, rest = plain.partition(".")
    if not plain:
        return "blank"
    if plain.rstrip("abcdefghijklmnopqrstuvwxyz").isdigit() and len(plain) <= 4 and sum(c.isalpha() for c in plain) <= 1 and len(plain.rstrip("abcdefghijklmnopqrstuvwxyz")) <= 3:
        return "call"
    if _DOTTED.match(plain):
        return "section"
    if dot and number.isdigit() and len(number) <= 3 and rest[:1].isspace():
        return "entry"
    head = C.heading(plain)
    return "notes" if head in C.NOTES_HEADINGS else "references" if C.opens_references(plain) else "resumes" if C.resumes(plain) else "text"


def numbers_of(spec: str) -> list[str]:
    """Note numbers of a list such as 1-3, 5a; ranges are written out, reversed ones turned."""
    out: list[int] = []
    for part in re.split("[,;]", spec):
        ends = [int(x) for x in re.findall(r"\d+", part)]
        out += range(min(ends), max(ends) + 1) if ends else []
    return [str(n) for n in out]


def regions(text: str, keep_references: bool) -> tuple[list[str], list[str]]:
    """(lines of the body, lines of the notes).  Reference sections belong to neither, or stay in the body."""
    lines = text.replace("\r\n", "\n").split("\n")
    labels = [label(x) for x in lines]
    at = list(accumulate(labels, lambda region, x: _REGIONS.get((region, x), region), initial="body"))[1:]
    body = [x for x, region in zip(lines, at, strict=True) if region == "body" or (keep_references and region == "references")]
    notes = [x for x, region, name in zip(lines, at, labels, strict=True) if region == "notes" and name != "notes"]
    return body, notes


def entries(lines: list[str]) -> tuple[str, dict[str, str]]:
    """(words before the first entry, notes by number) of the lines of a notes region.

    An entry begins with its number and a full stop, or with a number alone on its line.  Of
    several notes under a number one of prose counts before a citation, then the longer, then
    the first.
    """
    begins = [label(x) in ("entry", "call") for x in lines]
    parts = [[x.strip() for x, _ in rows] for _, rows in groupby(zip(lines, accumulate(begins), strict=True), key=lambda r: r[1])] if lines else []
    preamble = parts.pop(0) if parts and not begins[0] else []
    found: dict[str, list[str]] = {}
    for first, *rest in parts:
        number, _, words = first.partition(".")
        found.setdefault(re.sub(r"\D", "", number), []).append(" ".join(" ".join([words, *rest]).lstrip(" .").split()))
    best = {n: min((b for b in bodies if b), key=lambda b: (C.citation_only(b), -len(b)), default="") for n, bodies in found.items()}
    return " ".join(" ".join(preamble).split()), {n: b for n, b in best.items() if b}


def _paragraphs(lines: list[str]) -> list[tuple[str, str, list[str]]]:
    """(kind, words, numbers called) of a body: a blank line ends a paragraph, and so does a call unless the next
    line with words goes on in lower case."""
    labels = [label(x) for x in lines]
    behind = list(accumulate(reversed([x.strip() if k not in ("blank", "call") else "" for x, k in zip(lines, labels, strict=True)]), lambda after, x: x or after, initial=""))[::-1][1:]
    goes_on = [x[:1].islower() for x in behind]
    called = list(accumulate(labels, lambda open_, k: k == "call" or (open_ and k == "blank"), initial=False))[1:]
    ends = [k == "section" or (k == "call" and not on) or (k == "blank" and not (open_ and on)) for k, on, open_ in zip(labels, goes_on, called, strict=True)]
    starts = [k == "section" for k in labels]
    number = accumulate(a + b for a, b in zip([False, *ends[:-1]], starts, strict=True)) if lines else []
    out = []
    for _, rows in groupby(zip(lines, labels, number, strict=True), key=lambda r: r[2]):
        part = [(x.strip(), k) for x, k, _ in rows]
        words = " ".join(x for x, k in part if k not in ("blank", "call"))
        calls = [x for x, k in part if k == "call"] + [n for m in C.POINTER.finditer(words) for n in numbers_of(m[1])]
        words = re.sub(r"\s+([,.;:])", r"\1", " ".join(C.POINTER.sub(" ", words).split()))
        if words or calls:
            out.append(("heading" if part[0][1] == "section" else "paragraph", words, calls))
    return out


def plain_blocks(text: str) -> list[dict]:
    """Blocks of flat text: headings with dotted numbers, paragraphs, and each note behind the block that calls it first.

    A number glued to a word is a call only if that note exists.  Notes nobody calls come
    last, by number, without parent.
    """
    body, apparatus = regions(text, False)
    preamble, notes = entries(apparatus)
    loose = [x for line in body for x in (line if label(line) == "section" else _GLUED.sub(lambda m: f"{m[1]}\n{m[2]}\n" if m[2] in notes else m[0], line)).split("\n")]
    heads = [*_paragraphs(loose), *([("paragraph", preamble, [])] if preamble else [])]
    owner: dict[str, int] = {}
    for i, (_, _, calls) in enumerate(heads):
        for n in calls:
            if n in notes:
                owner.setdefault(n, i)
    block = lambda name, kind, words, refs=(), number=None, parent=None, hint=False: {"block_id": name, "kind": kind, "text": words, "note_refs": list(refs), "note_number": number, "parent_id": parent, "bibliographic_hint": hint}
    note = lambda n, parent: block(f"fn:{n}", "footnote", notes[n], number=n, parent=parent, hint=C.citation_only(notes[n]))
    out = []
    for i, (kind, words, _) in enumerate(heads):
        own = [n for n, k in owner.items() if k == i]
        out += [block(f"b{i + 1}", kind, words, [f"fn:{n}" for n in own]), *(note(n, f"b{i + 1}") for n in own)]
    return out + [note(n, None) for n in sorted(notes, key=int) if n not in owner]


def place_notes(text: str) -> str:
    """The text with each note of prose put behind its first call, calls and notes of mere citation dropped;
    what nobody calls is appended by number.  Without notes only the pointers go."""
    body, apparatus = regions(text, True)
    preamble, notes = entries(apparatus)
    left = dict(notes)

    def take(numbers: list[str]) -> list[str]:
        return [x for n in numbers if (x := left.pop(n, None)) is not None and not C.citation_only(x)]

    out: list[str] = []
    for line in body:
        if (notes or preamble) and label(line) == "call" and line.strip().isdigit() and not line[:1].isspace():
            found = take([line.strip()])
            out += ["", *found, ""] if found else []
            continue
        parts = C.POINTER.split(line)  # words, numbers, words, ...
        moved = parts[0] if len(parts) > 1 else line
        for numbers, rest in zip(parts[1::2], parts[2::2], strict=True):
            found = take(numbers_of(numbers))
            stop = rest[:1] if rest[:1] in tuple(".,;:") else ""
            moved = (moved.rstrip() if stop else moved) + stop + ("\n\n" + "\n\n".join(found) + "\n\n" if found else "") + rest[len(stop) :]
        out.append(line if len(parts) == 1 else re.sub(r"(?<=\S)[ \t]{2,}", " ", moved))
    rest = [left[n] for n in sorted(left, key=int) if not C.citation_only(left[n])]
    return "\n".join([*out, *filter(None, [preamble, *rest])]).strip()


@F.pandas_udf(StringType())
def place_notes_udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """``place_notes`` over a column; NULL stays."""
    for s in texts:
        yield s.map(lambda t: t if t is None else place_notes(t))


BLOCK = "block_pos int, block_id string, kind string, text string, note_refs array<string>, note_number string, parent_id string, bibliographic_hint boolean"


def document_blocks(chapters: DataFrame) -> DataFrame:
    """(book_id, chapter_index, block_pos, ...) of every chapter's flat text; NULL and blank texts have no blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{"book_id": k, "chapter_index": c, "block_pos": i, **x} for k, c, t in zip(b["book_id"], b["chapter_index"], b["text"], strict=True) for i, x in enumerate(plain_blocks(t))]
            yield pd.DataFrame(rows, columns=["book_id", "chapter_index", "block_pos", "block_id", "kind", "text", "note_refs", "note_number", "parent_id", "bibliographic_hint"])

    texts = chapters.where("text IS NOT NULL AND trim(text) <> ''").select("book_id", "chapter_index", "text")
    return texts.mapInPandas(run, f"book_id bigint, chapter_index int, {BLOCK}")
