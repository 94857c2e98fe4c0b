"""Held-out accuracy on cases planted in sentences made here."""

import random

from tidemark.llm.markup import languages
from tidemark.llm.pairs import defective_pairs
from tidemark.llm.quality import not_prose
from tidemark.llm.scan_noise import noise_found

NOUNS = "bakery window lantern harbour kitchen captain village chimney blanket orchard library teacher journal hallway candle river".split()
VERBS = "carried visited balanced remembered delivered examined welcomed repaired measured ignored".split()
ADJECTIVES = "quiet narrow golden ancient clever wooden hollow gentle familiar restless".split()
COMMON = [("en", w) for w in "the and of was in with near his one that".split()] + [("de", w) for w in "der die das und war im von ein".split()]
CONFUSE = [("i", "!"), ("o", "0"), ("l", "|"), ("e", "c"), ("h", "b"), ("d", "cl"), ("m", "rn"), ("w", "vv"), ("t", "f"), ("g", "9"), ("u", "ii")]


def sentence(rng):
    one = lambda: f"the {rng.choice(ADJECTIVES)} {rng.choice(NOUNS)}"
    s = f"{one()} {rng.choice(VERBS)} {one()} and {one()} was near the {rng.choice(NOUNS)}"
    return s[0].upper() + s[1:] + "."


def rates(found, want):
    return len(found & want) / len(found or {1}), len(found & want) / len(want)


def test_scan_noise(spark):
    rng = random.Random(3)
    rows, want = [], set()
    for i in range(900):
        text = " ".join(sentence(rng) for _ in range(3))
        if i % 3 == 0:
            words = text.split(" ")
            k = rng.choice([j for j, w in enumerate(words) if len(w) > 5 and w.isalpha() and any(a in w for a, _ in CONFUSE)])
            a, b = rng.choice([c for c in CONFUSE if c[0] in words[k]])
            words[k] = words[k].replace(a, b, 1)
            text = " ".join(words)
            want.add((1, 0, i, "misread"))
        if i % 3 == 1:
            words = text.split(" ")
            k = rng.choice([j for j, w in enumerate(words) if len(w) > 5 and w.isalpha()])
            cut = rng.randrange(2, len(words[k]) - 2)
            words[k] = words[k][:cut] + rng.choice("-­¬‐") + "\n" + words[k][cut:]
            text = " ".join(words)
            want.add((1, 0, i, "hyphen"))
        rows.append((1, 0, i, text))
    blocks = spark.createDataFrame(rows, "book_id bigint, chapter_index int, block_pos int, text string")
    chapters = spark.createDataFrame([], "book_id bigint, chapter_index int, text string, chapter_title string")
    books = spark.createDataFrame([], "book_id bigint, title string, author string")
    found = {tuple(r) for r in noise_found(blocks, chapters, books, spark.createDataFrame(COMMON, "lang string, word string")).collect()}
    precision, recall = rates(found, want)
    assert precision > 0.98 and recall > 0.95, (precision, recall)


def test_markup():
    rng = random.Random(4)
    marks = {
        "html": ["<b>{}</b>", "<p class='x'>{}</p>", "{}&nbsp;", "{}<br/>", "<!-- {} -->", "<a href=\"https://x.test/a\">{}</a>"],
        "markdown": ["**{}**", "*{}*", "`{}`", "[{}](https://x.test/a)", "\n## {}\n", "~~{}~~", "![{}](a.png)"],
        "wiki": ["'''{}'''", "''{}''", "[[{}]]", "{{{{cite|{}}}}}", "\n== {} ==\n", "[https://x.test/a {}]"],
        "latex": ["\\emph{{{}}}", "\\section{{{}}}", "{}\\cite{{a1}}", "{} \\(\\frac{{1}}{{n}}\\)", "``{}''", "{} $x_1 = 2$"],
    }
    wrong = 0
    for _ in range(800):
        words = sentence(rng).split(" ")
        picked = rng.sample(sorted(marks), rng.choice([0, 1, 1, 2]))
        for language, k in zip(picked, rng.sample(range(len(words) - 1), len(picked)), strict=True):
            words[k] = rng.choice(marks[language]).format(words[k])
        wrong += languages(" ".join(words)) != [x for x in ("html", "markdown", "wiki", "latex") if x in picked]
    assert wrong <= 16, wrong


def test_pairs(spark):
    rng = random.Random(5)
    rows, want = [], set()
    for i in range(600):
        parts = [sentence(rng) for _ in range(4)]
        raw = " ".join(p[:-1] + f" (Hobber {1950 + i % 60}, p. {i})." if k == 1 else p for k, p in enumerate(parts))
        clean, hint, kind = " ".join(parts), "Calm and slow.", None
        if i % 6 == 1:
            clean, kind = clean[: len(clean) // 2], "truncated"
        elif i % 6 == 2:
            clean, kind = rng.choice(["I'm sorry, but I can't help with this.", "As an AI assistant, I cannot process this text.", "Es tut mir leid, aber das ist nicht möglich."]), "refusal"
        elif i % 6 == 3:
            clean, kind = raw, "copied"
        elif i % 6 == 4:
            clean, kind = parts[0] + " Die Nacht war kalt und das Haus war leer. Der Mond und die Uhr im Turm von gestern.", "other_language"
        elif i % 6 == 5 and i % 2:
            hint, kind = parts[0], "copied"
        rows.append((1, 0, i, raw, clean, hint))
        if kind:
            want.add((1, 0, i, kind))
    pairs = spark.createDataFrame(rows, "book_id bigint, chapter_index int, chunk_index int, raw_text string, cleaned_text string, instruct string")
    found = {tuple(r) for r in defective_pairs(pairs, spark.createDataFrame(COMMON, "lang string, word string")).collect()}
    precision, recall = rates(found, want)
    assert precision > 0.98 and recall > 0.98, (precision, recall)


def test_quality(spark):
    rng = random.Random(6)
    rows, want = [], set()
    for i in range(240):
        prose = "\n\n".join(" ".join(sentence(rng) for _ in range(3)) for _ in range(3))
        kind = (None, "list", "table", "junk")[i % 4]
        if kind == "list":
            prose = "\n".join(f"{k}. The {rng.choice(NOUNS)} Of The {rng.choice(NOUNS)}" for k in range(1, 25))
        elif kind == "table":
            d = rng.choice(["\t", ";", " | ", ","])
            prose = "\n".join(d.join([rng.choice(NOUNS), *(str(rng.randrange(900)) for _ in range(4))]) for _ in range(25))
        elif kind == "junk":
            prose = "\n".join(" ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randrange(3, 12))) for _ in range(8)) for _ in range(15))
        rows.append((1, i, "T", prose))
        if kind:
            want.add((1, i, kind))
    chapters = spark.createDataFrame(rows, "book_id bigint, chapter_index int, chapter_title string, text string")
    found = {tuple(r) for r in not_prose(chapters, spark.createDataFrame(COMMON, "lang string, word string")).collect()}
    precision, recall = rates(found, want)
    assert precision > 0.98 and recall > 0.98, (precision, recall)
