"""Pages to blocks: headings, paragraphs, list items, tables and figures, notes behind the paragraph that calls them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

from tidemark.functions.citations import citation_only
from tidemark.operators.notes import BLOCK

_NUMBER = re.compile(r"^[\[(]?(\d{1,3}[a-z]?)[\])]?$")
_LEADING = re.compile(r"^\s*[\[(]?\d{1,3}[a-z]?[\])]?(?:\s*[.)])?\s+|^\s*[↩^]\s*")
_KIND = {**{f"h{i}": "heading" for i in range(1, 7)}, "li": "list_item", "table": "table", "figure": "figure"}
_LEAVES = frozenset([*_KIND, "p", "pre", "blockquote", "aside", "div", "section", "article", "td", "body"])


class _Blocks(HTMLParser):
    """Leaves of a page in order: kind, anchors that name it, text, and the fragments its numbered links point to."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.leaves: list[dict] = [self._leaf("paragraph")]
        self.open: list[str] = []
        self.skip, self.link, self.inside = 0, None, None
        self.feed(html)
        self.close()

    @staticmethod
    def _leaf(kind: str) -> dict:
        return {"kind": kind, "ids": [], "text": [], "calls": [], "alt": "", "caption": []}

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag in ("script", "style"):
            self.skip += 1
        if self.inside is None and tag in _LEAVES:
            self.leaves.append(self._leaf(_KIND.get(tag, "paragraph")))
            if tag in ("table", "figure"):
                self.inside = tag
        for name in (a.get("id"), a.get("name") if tag == "a" else None):
            if name:
                self.leaves[-1]["ids"].append(name)
        if tag == "a" and (a.get("href") or "").startswith("#"):
            self.link = (a["href"][1:], [])
        if tag == "img" and self.inside == "figure":
            self.leaves[-1]["alt"] = a.get("alt") or ""
        self.open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        if tag == "a" and self.link:
            target, words = self.link
            if _NUMBER.match("".join(words).strip()):
                self.leaves[-1]["calls"].append((target, _NUMBER.match("".join(words).strip())[1]))
            else:
                self.leaves[-1]["text"] += words
            self.link = None
        if tag == self.inside:
            self.inside = None
        if tag in _LEAVES and self.inside is None:
            self.leaves.append(self._leaf("paragraph"))
        if tag in self.open:
            del self.open[len(self.open) - 1 - self.open[::-1].index(tag) :]

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        if self.inside and self.open and self.open[-1] in ("caption", "figcaption"):
            self.leaves[-1]["caption"].append(data)
        (self.link[1] if self.link else self.leaves[-1]["text"]).append(data)


def page_blocks(html: str) -> list[dict]:
    """Blocks of a page.  A numbered link calls the leaf its fragment names, unless it stands in that leaf; the first
    call of a fragment wins, the called leaf is a note and comes behind its caller; a note nobody calls does not exist."""
    leaves = [x for x in _Blocks(html).leaves if "".join(x["text"]).strip() or x["calls"] or x["kind"] in ("table", "figure")]
    home = {name: i for i, x in enumerate(leaves) for name in x["ids"]}
    callers: dict[int, tuple[int, str]] = {}
    for i, x in enumerate(leaves):
        for target, number in x["calls"]:
            j = home.get(target)
            if j is not None and j != i and j not in callers and i not in callers and j > i:
                callers[j] = (i, number)
    out: list[dict] = []
    for i, x in enumerate(leaves):
        if i in callers:
            continue
        words = " ".join("".join(x["text"]).split())
        if x["kind"] == "table":
            words = " ".join("".join(x["caption"]).split()) or "See the table in this chapter."
        elif x["kind"] == "figure":
            words = " ".join("".join(x["caption"]).split()) or x["alt"].strip() or "See the figure in this chapter."
        if x["kind"] == "heading" and re.fullmatch(r"(?i)(?:notes|footnotes|endnotes)\s*[:.]?", words):
            continue
        mine = [(j, n) for j, (caller, n) in callers.items() if caller == i]
        if not words and not mine:
            continue
        name = f"b{sum(b['kind'] != 'footnote' for b in out) + 1}"
        notes = [(f"fn:{leaves[j]['ids'][0]}", n, _LEADING.sub("", " ".join("".join(leaves[j]["text"]).split()))) for j, n in mine]
        notes = [x for x in notes if x[2]]
        out.append({"block_id": name, "kind": x["kind"], "text": words, "note_refs": [k for k, _, _ in notes], "note_number": None, "parent_id": None, "bibliographic_hint": False})
        out += [{"block_id": k, "kind": "footnote", "text": t, "note_refs": [], "note_number": n, "parent_id": name, "bibliographic_hint": citation_only(t)} for k, n, t in notes]
    return out


def html_blocks(pages: DataFrame, key: str = "path", html: str = "html") -> DataFrame:
    """(key, block_pos, ...) of every page; NULL pages have no blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{key: k, "block_pos": i, **x} for k, h in zip(b[key], b[html], strict=True) for i, x in enumerate(page_blocks(h))]
            yield pd.DataFrame(rows, columns=[key, "block_pos", "block_id", "kind", "text", "note_refs", "note_number", "parent_id", "bibliographic_hint"])

    kind = dict(pages.dtypes)[key]
    return pages.where(f"{html} IS NOT NULL").select(key, html).mapInPandas(run, f"{key} {kind}, {BLOCK}")
