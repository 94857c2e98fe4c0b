"""Markup residue in texts (problem 2): HTML, Markdown, wiki and LaTeX.

Each text is read into a flat tree of marked nodes: code samples and formulas are taken out
first, so that nothing inside them is read as markup, then tables, headings, list items,
links, emphasis, references and single marks.  The nodes tell which languages a text holds
(``markup_found``) and give its clean text with headings, lists, code samples, tables and
formulas told apart (``clean_markup``).

``induce_wrappers`` is wrapper induction: the DOM trees of neighbouring texts of a host
(here a book) are aligned by simple tree matching; a node that stays the same in enough
texts of the host becomes template, a varying one is a slot.  The wrapper tells what
``clean_markup`` drops as page chrome; the language of one text's residue does not follow from it, as a text may
hold the only mark of its book, so the languages come from the nodes themselves.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Callable, Iterator
from html.entities import html5

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.tables import shared_dir, small

LANGUAGES = ("html", "markdown", "wiki", "latex")
#: A text without any of these characters holds no markup; tested before Python is reached.
SUSPECT = r"[<&\\\[\]{}*_`~#|$=^>]|''|(?m:^-{3,}\s*$)"

# Elements of HTML, extension tags of wikis, switches of wikis, LaTeX commands without argument.
_ELEMENTS = "a abbr address area article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col colgroup data dd del details dfn dialog div dl dt em embed fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe img input ins kbd label legend li link main map mark meta meter nav noscript object ol optgroup option output p param picture pre progress q rp rt ruby s samp script section select small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr"
_WIKI_TAGS = "ref references nowiki gallery syntaxhighlight math onlyinclude includeonly noinclude"
_SWITCHES = "TOC NOTOC FORCETOC NOEDITSECTION NOINDEX INDEX NOGALLERY HIDDENCAT"
_BARE = "ldots dots cdots item noindent newline newpage clearpage maketitle tableofcontents LaTeX TeX par hline centering quad qquad textbackslash bigskip medskip smallskip indent appendix"

_TAG = re.compile(rf"</?(?:{_ELEMENTS.replace(' ', '|')})(?:\s+[^<>]*|\s*)/?>|<!DOCTYPE[^>]*>", re.I)
_WIKI_TAG = re.compile(rf"</?(?:{_WIKI_TAGS.replace(' ', '|')})(?:\s+[^<>]*|\s*)/?>", re.I)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|([A-Za-z][A-Za-z0-9]{1,31}));")
_KEPT = re.compile(  # what is kept or dropped as a whole
    r"(?P<hcomment><!--.*?-->)|(?P<hdrop><(?P<hd>script|style)\b[^>]*>.*?</(?P=hd)\s*>)"
    r"|(?P<hcode><pre\b[^>]*>(?:\s*<code\b[^>]*>)?(?P<hbody>.*?)(?:</code\s*>\s*)?</pre\s*>)"
    r"|(?P<hline><(?P<ht>code|tt|kbd|samp)\b[^>]*>(?P<hl>[^\n]*?)</(?P=ht)\s*>)|(?P<mline>(?<![`\\])`(?!`)(?=[^`\n]*\w)(?P<ml>[^`\n]+)`(?!`))"
    r"|(?P<wcode><(?P<wt>syntaxhighlight|nowiki)\b[^>]*>(?P<wbody>.*?)</(?P=wt)\s*>)|(?P<wmath><math\b[^>]*>(?P<wf>.*?)</math\s*>)"
    r"|(?P<lcode>\\begin\{(?P<le>verbatim\*?|lstlisting|minted)\}(?P<lbody>.*?)\\end\{(?P=le)\})"
    r"|(?P<mcode>^[ \t]*(?P<mf>`{3,}|~{3,})[^\n`]*\n(?P<mbody>.*?)(?:^[ \t]*(?P=mf)[`~]*[ \t]*$|\Z))"
    r"|(?P<lform>\\begin\{(?P<fe>(?:equation|align|gather|displaymath|eqnarray|math)\*?)\}(?P<lf1>.*?)\\end\{(?P=fe)\}|\\\[(?P<lf2>.*?)\\\]|\\\((?P<lf3>.*?)\\\)|\$\$(?P<lf4>[^$]+)\$\$)"
    r"|(?P<ldollar>(?<![\\$\w])\$(?=[^\s$])(?!\d[\d.,]*\s)(?P<lf5>[^$\n]*?[\\^_=][^$\n]*?)(?<![\s\\])\$(?!\d))",
    re.S | re.M | re.I,
)
_HTML_TABLE = re.compile(r"<table\b[^>]*>(.*?)</table\s*>", re.S | re.I)
_HTML_ROW, _HTML_CELL = re.compile(r"<tr\b[^>]*>(.*?)(?=<tr\b|</tr\s*>|\Z)", re.S | re.I), re.compile(r"<t[dh]\b[^>]*>(.*?)(?=<t[dh]\b|</t[dhr]\s*>|\Z)", re.S | re.I)
_HTML_HEAD, _HTML_ITEM = re.compile(r"<h([1-6])\b[^>]*>(.*?)</h\1\s*>", re.S | re.I), re.compile(r"<li\b[^>]*>(.*?)(?=</li\s*>|<li\b|</[uo]l\s*>|\Z)(?:</li\s*>)?", re.S | re.I)
_HTML_BREAK = re.compile(r"</?(?:p|div|br|hr|ul|ol|table|blockquote|section|article|header|footer|nav|tr)\b[^>]*>", re.I)
_MD_TABLE = re.compile(r"^[ \t]*\|?[^\n]*\|[^\n]*\n[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)*\|?[ \t]*(?:\n[^\n]*\|[^\n]*)*|^[ \t]*\|[^\n]*\|[ \t]*\n[ \t]*\|(?:[ \t]*:?-+:?[ \t]*\|){2,}[ \t]*(?:\n[^\n]*\|[^\n]*)*", re.M)
_MD_DELIMITER = re.compile(r"^[ \t]*\|(?:[ \t]*:?-+:?[ \t]*\|){2,}[ \t]*$|^[ \t]*\|[ \t]*:?-{2,}|-\|-|^[ \t]*:?-{2,}:?[ \t]*\|", re.M)
_MD_ATX, _MD_SETEXT = re.compile(r"^[ \t]{0,3}#{1,6}[ \t]+(\S[^\n]*?)[ \t]*#*[ \t]*$", re.M), re.compile(r"^[ \t]*(?![-=|>])([^\n|]*\S)[ \t]*\n[ \t]{0,3}(?:={3,}|-{3,})[ \t]*$", re.M)
_MD_RULE = re.compile(r"^[ \t]{0,3}(?:(?:\*[ \t]*){3,}|(?:_[ \t]*){3,4}|(?:-[ \t]*){3,})$", re.M)
_MD_QUOTE = re.compile(r"^[ \t]{0,3}>[ \t]?(?=[\w\"'“”«»‘’*_\[(`¿¡—-]|[ \t]*$|>)", re.M)
_MD_IMAGE, _MD_LINK = re.compile(r"!\[([^\[\]]*)\](?:\([^()\s]*(?:\s+\"[^\"]*\")?\)|\[[^\[\]]*\])"), re.compile(r"(?:(?<![\w\])])|(?=\[[^\[\]]+\]\([^()\s]*[/.:#]))\[([^\[\]]+)\]\((?:<[^<>]*>|[^()\s]+)(?:\s+\"[^\"]*\")?\)")  # an index and a call, b[j](x), are no link
_MD_REFERENCE, _MD_DEFINITION = re.compile(r"\[([^\[\]\n]+)\]\s?\[([^\[\]\n]+)\]"), re.compile(r"^[ \t]{0,3}\[[^\[\]\n]+\]:[ \t]+\S+[^\n]*$", re.M)
_MD_STRIKE = re.compile(r"~~(?=[^\s~])(.+?)(?<=[^\s~])~~", re.S)
_MD_STAR = re.compile(r"(?<![\w*\\])(\*{1,3})(?=[^\s*])((?:[^*]|(?<=\s)\*(?=\s))+?)(?<=[^\s*])\1(?!\*)|(?<=\w)(\*{2,3})(?=[^\s*])([^*\n]+?)(?<=[^\s*])\3(?!\*)", re.S)
_DUNDERS = "init main name file doc new del repr str len iter next enter exit call eq hash all dict class slots version getitem setitem contains"
_MD_UNDER = re.compile(rf"(?<![\w\\])(?!__(?:{_DUNDERS.replace(' ', '|')})__)" r"(_{1,2})(?=[^\W_])([^_\n]+?)(?<=[^\s_])\1(?![\w])")
_MD_AUTOLINK = re.compile(r"<((?:https?://|mailto:)[^<>\s]+)>")
_MD_TASK = re.compile(r"^([ \t]*[-*+][ \t]+)\[[ xX]\][ \t]+", re.M)
_WIKI_TABLE = re.compile(r"^[ \t]*\{\|([^\n]*)\n(.*?)^[ \t]*\|\}", re.S | re.M)
_WIKI_HEAD = re.compile(r"^[ \t]*(={2,6})[ \t]*([^=\n]+?)[ \t]*\1[ \t]*$", re.M)
_WIKI_TEMPLATE, _WIKI_LINK = re.compile(r"\{\{([^{}]*)\}\}"), re.compile(r"\[\[([^\[\]]*)\]\]")
_WIKI_EXTERNAL = re.compile(r"\[(?:https?|ftp)://[^\s\[\]]+(?:[ \t]+([^\[\]\n]+))?\](?![(\[])")
_WIKI_BOLD, _WIKI_SWITCH = re.compile(r"'''(?=[^'\s])(.+?)(?<=[^'\s])'''", re.S), re.compile(rf"__(?:{_SWITCHES.replace(' ', '|')})__")
_WIKI_ITALIC = re.compile(r"(?<!')''(?=[^'\s])(.+?)(?<=[^'\s])''(?!')", re.S)
_TEX_QUOTE = re.compile(r"``(?=[^\s`])(.+?)(?<=\S)''", re.S)
_TEX_HEAD = re.compile(r"\\(?:part|chapter|(?:sub)*section|(?:sub)?paragraph)\*?\{([^{}]*)\}")
_TEX_ITEM = re.compile(r"\\item\b(?:\[[^\]]*\])?[ \t]*([^\n]*)")
_TEX_DROP = re.compile(r"~?\\(?:cite[a-z]*|label|ref|eqref|pageref|index|vspace|hspace|usepackage|documentclass|bibliography(?:style)?)\*?(?:\[[^\]]*\])?\{[^{}]*\}")
_TEX_NOTE = re.compile(r"\\(?:footnote|footnotetext)\{([^{}]*)\}")
_TEX_TABLE = re.compile(r"\\begin\{(tabular|tabularx|longtable|array)\*?\}(?:\[[^\]\n]*\])?((?:\{(?:[^{}]|\{[^{}]*\})*\})*)(.*?)\\end\{\1\*?\}", re.S)
_TEX_RULE = re.compile(r"\\(?:hline|toprule|midrule|bottomrule)\b|\\c(?:mid)?(?:line|rule)\{[^{}]*\}")
_TEX_ENV = re.compile(r"\\(?:begin|end)\{[^{}\n]*\}(?:\[[^\]]*\])?")
_TEX_COMMAND = re.compile(r"(?<![\w:\\/])\\[A-Za-z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}|(?<=[^\W\d_])\\(?:emph|text\w+|underline)\{([^{}]*)\}")
_TEX_BARE, _TEX_ESCAPE = re.compile(rf"(?<![\w:\\])\\(?:{_BARE.replace(' ', '|')})\b(?![\\_\w])|(?<=[\w'])\\(?:ldots|dots)\b"), re.compile(r"(?<=\d)\s?\\%|\\\$(?=\d)|(?<=\s)\\[&#](?=\s|\d)|(?<=\w)\\_(?=\w)")
_BULLET = re.compile(r"^[ \t]*(?:[-*+•–]|\d{1,3}[.)])[ \t]+(\S.*)$")

_OPEN, _CLOSE = "\ufdd0", "\ufdd1"  # no characters of any text: they bracket the number of a node taken out
_HOLE = re.compile(_OPEN + r"(\d+)" + _CLOSE)


#: What parts a text into blocks; inside them other tags mark words of a sentence.
_BLOCK = re.compile(r"</?(?:address|article|aside|blockquote|body|br|caption|d[dlt]|div|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|p|pre|section|table|t(?:body|d|foot|h|head|r)|ul)\b|<!DOCTYPE", re.I)
_INNER = re.compile(r"[<&\\\[{*_`~$]|''")


class Reading:
    """The nodes of one text: ``languages`` it holds, ``nodes`` taken out, ``rest`` with holes for them."""

    def __init__(self, text: str, within: Reading | None = None) -> None:
        self.languages: set[str] = set()
        self.nested = within is not None
        self.nodes: list[tuple[str, str, str]] = within.nodes if within else []  # (language, kind, text)
        self.rest = text if within else text.replace("\r\n", "\n").replace("\r", "\n").replace(_OPEN, "").replace(_CLOSE, "")
        self._read()

    def _hole(self, language: str, kind: str, text: str) -> str:
        self.languages.add(language)
        if kind in ("heading", "list_item", "table") and not self.nested and _INNER.search(text):
            inner = Reading(text, self)  # its own marks; what it takes out joins the nodes of the whole
            self.languages |= inner.languages
            text = inner.rest
        self.nodes.append((language, kind, text))
        return f"{_OPEN}{len(self.nodes) - 1}{_CLOSE}"

    def _sub(self, pattern: re.Pattern, language: str, give: Callable[[re.Match], str | None]) -> None:
        def one(m: re.Match) -> str:
            out = give(m)
            if out is None:
                return m[0]
            self.languages.add(language)
            return out

        self.rest = pattern.sub(one, self.rest)

    def _until_stable(self, *steps: tuple) -> None:
        """Steps that each take marks away, over and over until none finds any, for marks inside marks."""
        before = None
        while before != self.rest:
            before = self.rest
            for step in steps:
                self._sub(*step)

    def _whole(self, m: re.Match) -> str:
        if m["hcomment"] is not None or m["hdrop"] is not None:
            self.languages.add("html")
            return " "
        for group, body, language in (("hcode", "hbody", "html"), ("wcode", "wbody", "wiki"), ("lcode", "lbody", "latex"), ("mcode", "mbody", "markdown")):
            if m[group] is not None:
                code = html.unescape(m[body]) if language == "html" else m[body]
                return self._hole(language, "code", code.strip("\n"))
        if m["hline"] is not None:
            return self._hole("html", "inline", html.unescape(m["hl"]))
        if m["mline"] is not None:
            return self._hole("markdown", "inline", m["ml"])
        if m["wmath"] is not None:
            return self._hole("wiki", "formula", m["wf"].strip())
        return self._hole("latex", "formula", next(m[g] for g in ("lf1", "lf2", "lf3", "lf4", "lf5") if m[g] is not None).strip())

    def _read(self) -> None:
        t = self.rest
        if "<" in t or "`" in t or "~~~" in t or "\\" in t or "$" in t:
            self.rest = _KEPT.sub(self._whole, t)
        if "\\" in self.rest or "``" in self.rest:
            self._latex()
        if "[" in self.rest or "{" in self.rest or "=" in self.rest or "''" in self.rest or "__" in self.rest or "<" in self.rest:
            self._wiki()
        self._markdown()
        if "<" in self.rest or "&" in self.rest:
            self._html()

    def _latex(self) -> None:
        s = self._sub
        if "\\begin" in self.rest:
            s(_TEX_TABLE, "latex", lambda m: self._hole("latex", "table", "\n".join(" | ".join(c.strip() for c in re.split(r"(?<!\\)&", row)) for row in re.split(r"\\\\(?:\[[^\]]*\])?", _TEX_RULE.sub("", m[3])) if row.strip())))
        s(_TEX_HEAD, "latex", lambda m: self._hole("latex", "heading", m[1].strip()))
        s(_TEX_DROP, "latex", lambda m: "")
        s(_TEX_NOTE, "latex", lambda m: f" ({m[1].strip()})")
        s(_TEX_ITEM, "latex", lambda m: self._hole("latex", "list_item", m[1].strip()) + "\n")
        s(_TEX_ENV, "latex", lambda m: "\n")
        self._until_stable((_TEX_COMMAND, "latex", lambda m: m[1] if m[1] is not None else m[2]))  # commands inside commands
        s(_TEX_BARE, "latex", lambda m: "…" if "dots" in m[0] else " ")
        s(_TEX_ESCAPE, "latex", lambda m: m[0].replace("\\", "").strip() if "%" in m[0] else m[0][1:])
        s(_TEX_QUOTE, "latex", lambda m: f"“{m[1]}”")

    def _wiki(self) -> None:
        s = self._sub

        def link(m: re.Match) -> str:
            parts = m[1].split("|")
            space = parts[0].split(":", 1)[0].strip().lower()
            if ":" in parts[0] and space in ("category", "file", "image", "kategorie", "datei", "fichier", "archivo", "ficheiro", "bestand"):
                return "" if len(parts) < 2 or space in ("category", "kategorie") else parts[-1]
            return parts[-1] or parts[0]

        s(_WIKI_TABLE, "wiki", lambda m: self._hole("wiki", "table", "\n".join(" | ".join(c.strip() for c in re.split(r"\|\||!!", r.strip().lstrip("|!"))) for r in m[2].split("\n") if r.strip().lstrip("|!-+ "))))
        s(_WIKI_HEAD, "wiki", lambda m: self._hole("wiki", "heading", m[2]))
        self._until_stable((_WIKI_LINK, "wiki", link), (_WIKI_TEMPLATE, "wiki", lambda m: ""))
        s(_WIKI_EXTERNAL, "wiki", lambda m: m[1] or "")
        s(_WIKI_BOLD, "wiki", lambda m: m[1])
        s(_WIKI_ITALIC, "wiki", lambda m: m[1])
        s(_WIKI_SWITCH, "wiki", lambda m: "")
        s(_WIKI_TAG, "wiki", lambda m: "")

    def _markdown(self) -> None:
        s, t = self._sub, self.rest
        if "|" in t or "-|-" in t:
            s(_MD_TABLE, "markdown", lambda m: self._hole("markdown", "table", "\n".join(r.strip().strip("|").strip() for i, r in enumerate(m[0].split("\n")) if i != 1)) if _MD_DELIMITER.search(m[0]) else None)
        if "#" in t:
            s(_MD_ATX, "markdown", lambda m: self._hole("markdown", "heading", m[1]))
        if "===" in t or "---" in t:
            s(_MD_SETEXT, "markdown", lambda m: self._hole("markdown", "heading", m[1].strip()) if re.search(r"[^\W\d_]", m[1]) and not _HOLE.fullmatch(m[1].strip()) else None)
        if "***" in t or "---" in t or "* *" in t or "- -" in t:
            s(_MD_RULE, "markdown", lambda m: "\n")
        if ">" in t:
            s(_MD_QUOTE, "markdown", lambda m: "")
        if "[" in t:
            s(_MD_IMAGE, "markdown", lambda m: m[1])
            s(_MD_LINK, "markdown", lambda m: m[1])
            s(_MD_DEFINITION, "markdown", lambda m: "" if re.search(r"\]:\s+(?:<|\w+://|/|#)", m[0]) else None)
            s(_MD_REFERENCE, "markdown", lambda m: m[1])
            s(_MD_TASK, "markdown", lambda m: m[1])
        if "~~" in t:
            s(_MD_STRIKE, "markdown", lambda m: m[1] if re.search(r"\w", m[1]) else None)
        if "*" in t:
            self._until_stable((_MD_STAR, "markdown", lambda m: (m[2] if m[2] is not None else m[4]) if re.search(r"\w", m[0]) else None))
        if "_" in t:
            s(_MD_UNDER, "markdown", lambda m: m[2])
        if "<" in t:
            s(_MD_AUTOLINK, "markdown", lambda m: m[1])

    def _html(self) -> None:
        s = self._sub
        cells = lambda row: " | ".join(_plain(c) for c in _HTML_CELL.findall(row))
        if "<" in self.rest:
            s(_HTML_TABLE, "html", lambda m: self._hole("html", "table", "\n".join(filter(None, map(cells, _HTML_ROW.findall(m[1]))))))
            s(_HTML_HEAD, "html", lambda m: self._hole("html", "heading", _plain(m[2])))
            s(_HTML_ITEM, "html", lambda m: self._hole("html", "list_item", _plain(m[1])))
            s(_HTML_BREAK, "html", lambda m: "\n" if m[0][1] in "bB" else "\n\n")
            s(_TAG, "html", lambda m: "")
        if "&" in self.rest:
            s(_ENTITY, "html", lambda m: html.unescape(m[0]) if m[1] is None or m[1] + ";" in html5 else None)

    def parts(self) -> list[tuple[str, str]]:
        """(kind, text) of the clean text in order: heading, paragraph, list_item, code, table, formula."""
        out: list[tuple[str, str]] = []

        def prose(text: str) -> None:
            for para in re.split(r"\n\s*\n", text):
                lines = para.strip("\n").split("\n")
                run: list[str] = []
                for line in lines:
                    if m := _BULLET.match(line):
                        if run:
                            out.append(("paragraph", "\n".join(run)))
                            run = []
                        out.append(("list_item", m[1].strip()))
                    elif line.strip():
                        run.append(line.strip())
                if run:
                    out.append(("paragraph", "\n".join(run)))

        at = 0
        for m in _HOLE.finditer(self.rest):
            _, kind, text = self.nodes[int(m[1])]
            inline = kind == "inline" or kind == "formula" and self.rest[m.start() - 1 : m.start()] not in ("", "\n")
            if inline:
                continue
            prose(self._filled(self.rest[at : m.start()]))
            out.append((kind, self._filled(text)))
            at = m.end()
        prose(self._filled(self.rest[at:]))
        return [(k, t) for k, t in out if t.strip()]

    def _filled(self, text: str) -> str:
        while _HOLE.search(text):  # a node holds none but earlier ones
            text = _HOLE.sub(lambda m: self.nodes[int(m[1])][2], text)
        return text


def _plain(fragment: str) -> str:
    return html.unescape(re.sub(r"<[^<>]*>", "", fragment)).strip()


def languages(text: str | None) -> list[str]:
    """The markup languages a text holds, in order of LANGUAGES; none for NULL and empty texts."""
    if not text:
        return []
    found = Reading(text).languages
    return [x for x in LANGUAGES if x in found]


def texts(blocks: DataFrame, chapters: DataFrame) -> DataFrame:
    """(book_id, chapter_index, block_pos, text): blocks, and chapters without block rows at -1.

    NULL texts drop out; exact copies of a block stay and are merged in the results.
    """
    keys = blocks.select("book_id", "chapter_index").distinct()
    lone = chapters.where("text IS NOT NULL").join(small(keys), ["book_id", "chapter_index"], "left_anti")
    own = lone.select("book_id", "chapter_index", F.lit(-1).alias("block_pos"), "text")
    return blocks.where("text IS NOT NULL").select("book_id", "chapter_index", "block_pos", "text").unionByName(own)


def _suspects(blocks: DataFrame, chapters: DataFrame) -> DataFrame:
    suspect = F.col("text").rlike(SUSPECT)
    return texts(blocks, chapters.where(suspect)).where(suspect)


_KEYS = ("book_id", "chapter_index", "block_pos")


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [languages(t) for t in b.column("text").to_pylist()]
        index = pa.array([i for i, x in enumerate(found) for _ in x], pa.int64())
        yield pa.RecordBatch.from_arrays([*[b.column(k).take(index) for k in _KEYS], pa.array([y for x in found for y in x], pa.string())], [*_KEYS, "markup"])


def markup_found(blocks: DataFrame, chapters: DataFrame) -> DataFrame:
    """(book_id, chapter_index, block_pos, markup), one row for each language of a text (query p2_found)."""
    return _suspects(blocks, chapters).mapInArrow(_found, "book_id bigint, chapter_index int, block_pos int, markup string").distinct()


def without_chrome(text: str, chrome: set[str]) -> str:
    """The text without what stands between two block tags and is template as a whole; a template node inside a sentence stays."""
    out, at, run, run_at = [], 0, [], 0

    def close(end: int) -> None:
        words = [w for w in (" ".join(r.split()) for r in run) if w]
        out.append("".join(m[0] for m in _TAG.finditer(text, run_at, end)) if words and all(w in chrome for w in words) else text[run_at:end])

    for m in _TAG.finditer(text):
        run.append(text[at : m.start()])
        at = m.end()
        if _BLOCK.match(m[0]):
            close(m.start())
            out.append(m[0])
            run, run_at = [], at
    run.append(text[at:])
    close(len(text))
    return "".join(out)


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())]))
    for b in batches:
        chrome = b.column("chrome").to_pylist()
        read = [(Reading(t), without_chrome(t, set(c)) if c else t) for t, c in zip(b.column("text").to_pylist(), chrome, strict=True)]
        parts = [(Reading(kept) if c else r).parts() for (r, kept), c in zip(read, chrome, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                *[b.column(k) for k in _KEYS],
                pa.array([[x for x in LANGUAGES if x in r.languages] for r, _ in read], pa.list_(pa.string())),
                pa.array(["\n\n".join(t for _, t in p) for p in parts], pa.string()),
                pa.array([[{"kind": k, "text": t} for k, t in p] for p in parts], part),
            ],
            [*_KEYS, "markup", "clean_text", "parts"],
        )


def clean_markup(blocks: DataFrame, chapters: DataFrame) -> DataFrame:
    """(book_id, chapter_index, block_pos, markup, clean_text, parts) of every text, marked or not.

    ``parts`` is an array of (kind, text), kind one of heading, paragraph, list_item, code,
    table, formula.  A text of nothing but marks has no parts and an empty clean_text.  What
    the wrapper of a book holds as template is dropped from its HTML texts as page chrome;
    only they meet the wrappers, all others are cleaned where they are scanned.
    """
    ddl = "book_id bigint, chapter_index int, block_pos int, markup array<string>, clean_text string, parts array<struct<kind:string,text:string>>"
    chrome = induce_wrappers(blocks, chapters).where("role = 'template' AND node = '#text'").groupBy("book_id").agg(F.collect_set("content").alias("chrome"))
    rows, none = texts(blocks, chapters), F.lit(None).cast("array<string>").alias("chrome")
    marked = _join(rows.where(F.col("text").rlike(_MARKED)), chrome, "left", "book_id").select(*_KEYS, "text", "chrome")
    return rows.where(~F.col("text").rlike(_MARKED)).select(*_KEYS, "text", none).unionByName(marked).mapInArrow(_clean, ddl)


# --- wrapper induction -----------------------------------------------------------------


def dom(text: str, depth: int = 200) -> tuple:
    """The DOM tree of a text as (label, content, children), to ``depth`` levels; unclosed elements end with the text."""
    root: list = ["#root", "", []]
    stack, at = [root], 0
    for m in _TAG.finditer(text):
        words = text[at : m.start()].strip()
        if words:
            stack[-1][2].append(["#text", " ".join(words.split()), []])
        at = m.end()
        name = re.match(r"</?\s*([A-Za-z0-9]+)", m[0])
        if name is None:
            continue
        label = name[1].lower()
        if m[0].startswith("</"):
            names = [n[0] for n in stack]
            if label in names[1:]:
                del stack[len(names) - 1 - names[::-1].index(label) :]
        else:
            node = [label, "", []]
            stack[-1][2].append(node)
            if label not in ("br", "hr", "img", "input", "meta", "link") and not m[0].endswith("/>") and len(stack) < depth:
                stack.append(node)
    if words := text[at:].strip():
        stack[-1][2].append(["#text", " ".join(words.split()), []])
    return tuple(root)


def simple_tree_matching(a: tuple | list, b: tuple | list) -> tuple[int, list[tuple[tuple, tuple]]]:
    """(size, pairs of nodes) of the largest order-keeping matching of two trees with equal roots."""
    if a[0] != b[0]:
        return 0, []
    m, n = len(a[2]), len(b[2])
    best: list[list[tuple[int, tuple]]] = [[(0, ())] * (n + 1) for _ in range(m + 1)]
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            size, pairs = simple_tree_matching(a[2][i - 1], b[2][j - 1])
            take = (best[i - 1][j - 1][0] + size, (best[i - 1][j - 1][1], pairs))
            best[i][j] = max(take, best[i - 1][j], best[i][j - 1], key=lambda x: x[0]) if size else max(best[i - 1][j], best[i][j - 1], key=lambda x: x[0])
    pairs, link = [], best[m][n][1]
    while link:
        pairs += link[1]
        link = link[0]
    return best[m][n][0] + 1, [(a, b), *pairs]


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _nodes(tree: tuple | list) -> Iterator[tuple]:
    for child in tree[2]:
        yield child
        yield from _nodes(child)


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of nodes as (book, label, content if equal, its hash in either text), and the nodes of
    either text as (book, label, -, hash, -, hash of the text)."""
    names = ["book_id", "node", "content", "a", "b", "held_by"]
    types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    for b in batches:
        rows: list[tuple] = []
        for book, text, other in zip(*(b.column(c).to_pylist() for c in ("book_id", "text", "next_text")), strict=True):
            tags = len(_TAG.findall(text)) * len(_TAG.findall(other))
            if not tags:
                continue
            one, two = dom(text), dom(other)
            _, pairs = simple_tree_matching(one, two)
            rows += [(book, x[0], x[1] if x[1] == y[1] else None, _hash(x[1]), _hash(y[1]), None) for x, y in pairs if x[0] != "#root"]
            for t, tree in ((text, one), (other, two)):
                key = _hash(t)
                rows += [(book, label, None, _hash(content), None, key) for label, content in {(n[0], n[1]) for n in _nodes(tree)}]
        cols = list(zip(*rows, strict=True)) if rows else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


#: Chapters of a book whose texts are put in order in one task.
_GROUP = 8
#: A node is template if so large a share of the book's aligned texts, and two different ones at least, hold its content.
TEMPLATE_SHARE = 0.5
_MARKED = "<[A-Za-z/!]"


def _join(left: DataFrame, right: DataFrame, how: str, *keys: str) -> DataFrame:
    """Join on keys that may be NULL; the keys stay once."""
    other = right.select(*[F.col(c).alias(f"_{c}" if c in keys else c) for c in right.columns])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return left.join(other, same, how).drop(*[f"_{k}" for k in keys])


def _neighbours(marked: DataFrame) -> DataFrame:
    """(book_id, text, next_text): every text of a book with the one behind it, in order of chapter, block and text.

    Texts are put in order by groups of chapters, so that a hot book is many tasks; the last
    text of a group then meets the first one of the next group of its book that holds any.
    Only the numbers of the groups are put in order by whole books.
    """
    group = F.floor(F.col("chapter_index") / _GROUP)
    order = Window.partitionBy("book_id", "part").orderBy("chapter_index", "block_pos", "text")
    rows = marked.withColumn("part", group).select("book_id", "part", "text", F.lead("text").over(order).alias("next_text"), F.row_number().over(order).alias("n"))
    follows = F.lead("part").over(Window.partitionBy("book_id").orderBy("part"))
    parts = marked.select("book_id", group.alias("part")).distinct().select("book_id", "part", follows.alias("next_part")).where("next_part IS NOT NULL")
    last, first = rows.where("next_text IS NULL").select("book_id", "part", "text"), rows.where("n = 1").select("book_id", "part", F.col("text").alias("next_text"))
    at = last.join(parts, last.book_id.eqNullSafe(parts.book_id) & last.part.eqNullSafe(parts.part)).select(last.book_id, "next_part", "text")
    edges = at.join(first, at.book_id.eqNullSafe(first.book_id) & (at.next_part == first.part)).select(at.book_id, "text", "next_text")
    return rows.where("next_text IS NOT NULL").select("book_id", "text", "next_text").unionByName(edges)


def induce_wrappers(blocks: DataFrame, chapters: DataFrame) -> DataFrame:
    """(book_id, node, content, aligned, role): the nodes that simple tree matching pairs in
    neighbouring HTML texts of a book; role is ``template`` for a content that is the same in
    a pair and that TEMPLATE_SHARE of the book's aligned texts hold, ``slot`` (content NULL)
    for all other nodes; ``aligned`` counts the pairs.  A node is one or the other: a template
    met by something else is no slot.  Every text meets its neighbour in the whole book,
    whatever chapters lie between them, so a book of any size is as many small alignments as
    it has texts."""
    shared_dir(blocks.sparkSession)
    marked = texts(blocks, chapters).where(F.col("text").rlike(_MARKED))
    ddl = "book_id bigint, node string, content string, a bigint, b bigint, held_by bigint"
    nodes = _neighbours(marked.distinct()).mapInArrow(_aligned, ddl).checkpoint()  # read five times below, texts are left behind
    pairs, held = nodes.where("held_by IS NULL"), nodes.where("held_by IS NOT NULL")
    constant = pairs.where("content IS NOT NULL").groupBy("book_id", "node", "a").agg(F.first("content").alias("same"))
    total = held.groupBy("book_id").agg(F.countDistinct("held_by").alias("of"))
    times = held.groupBy("book_id", "node", "a").agg(F.countDistinct("held_by").alias("n"))
    enough = _join(times, total, "inner", "book_id").where((F.col("n") >= 2) & (F.col("n") >= TEMPLATE_SHARE * F.col("of")))
    template = _join(constant, enough.select("book_id", "node", "a"), "inner", "book_id", "node", "a")
    left = template.withColumnRenamed("same", "same_a")
    right = template.select("book_id", "node", F.col("a").alias("b"), F.col("same").alias("same_b"))
    named = _join(_join(pairs.select("book_id", "node", "a", "b"), left, "left", "book_id", "node", "a"), right, "left", "book_id", "node", "b")
    found = F.array_distinct(F.array_compact(F.array("same_a", "same_b")))
    content = F.explode(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(None).cast("string")))).alias("content")
    role = F.when(F.col("content").isNull(), "slot").otherwise("template").alias("role")
    return named.select("book_id", "node", content).groupBy("book_id", "node", "content").agg(F.count("*").alias("aligned")).select("*", role)
