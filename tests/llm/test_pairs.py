import numpy as np

from tidemark.llm import pairs as P

COMMON = [("en", w) for w in "the of and to in a is was on it that with".split()] + [("de", w) for w in "der die das und den im ein war".split()]
RAW = "The baker was in the village (Hobber 1985, p. 200). He went to the hill and it was late.[12] The night was on the roof of the house. That was the end of it."
SOUND = "The baker was in the village. He went to the hill and it was late. The night was on the roof of the house. That was the end of it."


def test_clauses():
    assert P.clauses('A b. "C d?" e') == ["A b.", '"C d?"', "e"] and P.clauses("") == [] and P.clauses("...") == ["..."]


def test_field_learns():
    rng = np.random.default_rng(0)
    rows, tags = [], []
    for _ in range(200):
        t = rng.integers(0, len(P.TAGS), 4)
        x = np.zeros((4, len(P.FEATURES)), np.float32)
        x[:, 0] = 1
        x[np.arange(4), t + 1] = 1
        rows.append(x)
        tags.append(list(t))
    f = P.Field().fit(rows, tags)
    assert all((a == b).all() for a, b in zip(f.tag(rows), tags, strict=True)) and P.Field().fit([], []).tag([np.zeros((0, len(P.FEATURES)))])[0].size == 0


def test_defects(spark):
    german = "Der Bäcker war im Dorf und die Nacht war kalt. Das Dach und der Berg. Die Uhr war im Haus und das Tor."
    cases = [
        (SOUND, "Calm and slow.", None), (SOUND, None, None), ("", None, "empty"), (None, "x", "empty"), (" … ", None, "empty"), (SOUND[:60], None, "truncated"), ("I'm sorry, but I can't help with this passage.", None, "refusal"),
        (RAW, None, "copied"), (SOUND, '"he went to the hill and it was late. the night was on the roof"', "copied"), (german, None, "other_language"), (SOUND[:75] + " " + german, None, "other_language"),
    ]
    rows = [(1, r, i, RAW, c, h, 1) for r in range(3) for i, (c, h, _) in enumerate(cases)] + [(1, 0, 0, RAW, SOUND, "Calm and slow.", 1), (9, 9, 9, None, "a b", None, 1)]
    df = spark.createDataFrame(rows, "book_id bigint, chapter_index int, chunk_index int, raw_text string, cleaned_text string, instruct string, defect int")
    words = spark.createDataFrame(COMMON, "lang string, word string")
    found = {tuple(r) for r in P.defective_pairs(df, words).collect() if r.book_id == 1}
    assert found == {(1, r, i, d) for r in range(3) for i, (_, _, d) in enumerate(cases) if d}
    assert P.defective_pairs(df.limit(0), words.limit(0)).count() == 0


def test_plainly_sound():
    rows = [(RAW, SOUND, None, True), (RAW, SOUND, "Calm and slow, with a smile.", True), (RAW, RAW, None, False), (SOUND, SOUND, "", True), (SOUND, SOUND, "the night was on the roof", False), (SOUND.replace("house.", "house.¹"), SOUND.replace("house.", "house.¹"), None, False), (None, None, None, False), ("", "", "", False), ("...", "...", None, False)]
    assert [P.plainly_sound(*r[:3]) for r in rows] == [r[3] for r in rows]


def test_weights():
    w = P.weigh([(["sorry", "no"], True)] * 3 + [(["the", "cat"], False)] * 3 + [(["the", "no"], False)] * 3)
    assert w["sorry"] > 0 and w["sorry no"] > 0 and w["the"] < 0 and "no" not in w and P._weight(["unseen"], w) == 0


def test_phrasings_held_out(spark):
    """Refusals of wording that no training pair has, in the passage's language and in others; foreign answers are none."""
    nouns, verbs = "baker village hill night roof house river candle".split(), "saw left found kept".split()
    tale = lambda i, n: " ".join(f"The {nouns[(i + j) % 8]} {verbs[(i * j) % 4]} the {nouns[(i * 3 + j) % 8]} on a {nouns[(j * 5) % 8]} number {i}." for j in range(n))
    german = lambda n: " ".join("Der Bäcker war im Dorf und die Uhr war im Haus." for _ in range(n))
    seen = ["I'm sorry, but I can't help with this text.", "As a language model, I cannot process this request.", "Es tut mir leid, das ist mir nicht möglich."]
    training = [(tale(i, 6), tale(i, 6) if i % 4 == 0 else seen[i % 3] if i % 4 == 1 else german(6) if i % 4 == 2 else tale(i, 6)[:100], "Slow and calm.") for i in range(240)]
    common = {}
    for lang, word in COMMON:
        common.setdefault(lang, set()).add(word)
    common = {k: frozenset(v) for k, v in common.items()}
    field, weights = P.fit(training, common)
    told = lambda raw, answer: (lambda x, s: P.defect(field.tag([x])[0], s))(*P.describe(raw, answer, None, common, weights))
    unseen = ["Ich lehne diese Anfrage ab.", "No puedo continuar.", "That is beyond what I may produce.", "We decline to carry out such an instruction.", "Je refuse.", "Dat doe ik niet.", "Diese Aufgabe übernehme ich nicht."]
    assert [told(raw, a) for raw in (tale(7, 6), german(5)) for a in unseen] == ["refusal"] * 14
    assert told(tale(7, 6), german(6)) == "other_language" and told(tale(7, 6), tale(7, 3) + " " + german(3)) == "other_language" and told(german(5), german(5)) is None
    assert told(tale(7, 3), "I'm sorry, but I cannot process this text. As a language model I can't help with this request.") == "refusal"
