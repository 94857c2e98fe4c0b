"""Personal records, guards and predicates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.units import clock

# Types of records, and label tokens that are kept, dropped and ranked.
TYPES = {3: ("5K", 0), 4: ("10K", 1), 5: ("Half Marathon", 3), 6: ("Marathon", 4), 7: ("Longest Run", 5)}
KEPT = ("5k", "10k", "15k", "half", "marathon", "longest run")
DROPPED = ("1k", "1 km", "3k", "3 km", "20k", "20 km", "1 mile", "1-mile", "1mi")
RANKS = (("marathon", 4), ("longest", 5), ("half", 3), ("10k", 1), ("15k", 2), ("5k", 0))


def has_token(label: Column, *tokens: str) -> Column:
    """Whether a label holds one of the tokens, not behind a digit (15k holds no 5k)."""
    return label.rlike("(?i)" + "|".join(rf"(?<!\d){t}\b" for t in tokens))


def record_label(type_id: Column, *names: Column) -> Column:
    known = F.create_map(*[F.lit(x) for k, (name, _) in TYPES.items() for x in (k, name)])
    given = [F.nullif(F.trim(n), F.lit("")) for n in names]
    return F.coalesce(F.try_element_at(known, type_id), *given, type_id.cast("string"), F.lit("PR"))


def keeps_record(type_id: Column, label: Column) -> Column:
    """By type where there is one; else by label: dropped tokens first, the longest must be a run."""
    by_label = ~has_token(label, *DROPPED) & ~(F.lower(label).contains("longest") & ~F.lower(label).contains("run")) & has_token(label, *KEPT)
    return F.when(type_id.isNotNull(), type_id.isin(*TYPES)).otherwise(F.coalesce(by_label, F.lit(False)))


def record_value(value: Column, type_id: Column, label: Column) -> Column:
    """The value as text: a time or kilometres by type, else by label; a dash for NULL."""
    km = F.format_string("%.2f km", value / 1000)
    timed = type_id.isin(3, 4, 5, 6)
    return F.when(value.isNull(), "—").when(timed, clock(value)).when(type_id == 7, km).when(F.lower(label).rlike("longest|distance"), km).when(has_token(label, "5k", "10k", "15k", "half", "marathon"), clock(value)).otherwise(value.cast("string"))


def record_rank(type_id: Column, label: Column) -> Column:
    rank = F.when(F.lit(False), 0)
    for k, (_, r) in TYPES.items():
        rank = rank.when(type_id == k, r)
    for token, r in RANKS:
        rank = rank.when(has_token(label, token), r)
    return rank.otherwise(50)


def personal_records(items: DataFrame) -> DataFrame:
    """Kept records of (user_id, type_id, name, value, day) with label, display_value and rank, in order."""
    named = items.withColumn("label", record_label(F.col("type_id"), F.col("name"))).where(keeps_record(F.col("type_id"), F.col("label")))
    shown = named.withColumn("display_value", record_value(F.col("value"), F.col("type_id"), F.col("label")))
    order = Window.partitionBy("user_id").orderBy(record_rank(F.col("type_id"), F.col("label")), "label", "day")
    return shown.withColumn("place", F.row_number().over(order))


def is_cover(image: Column) -> Column:
    """Whether bytes are a JPEG or PNG image of at least 10,000 bytes."""
    head = F.hex(F.substring(image, 1, 8))
    return (F.length(image) >= 10_000) & (head.startswith("FFD8FF") | (head == "89504E470D0A1A0A"))


def guarded_answer(raw: Column, cleaned: Column, most: float = 2.5) -> Column:
    """The answer unless it is blank or has more than ``most`` times the words; then the passage."""
    from tidemark.functions.text import word_count

    n = word_count(raw)
    bad = (word_count(cleaned) == 0) | (word_count(cleaned) > n * most)
    return F.when((n > 0) & bad, raw).otherwise(cleaned)


def guarded_hint(reply: Column, narration: Column) -> Column:
    """A short reading hint, NULL when it is blank, long, tagged or taken from the narration."""
    from tidemark.functions.text import word_count

    hint = F.regexp_replace(F.trim(reply), r"^[\"'`]+|[\"'`]+$", "")
    plain = F.trim(narration)
    words = word_count(hint)
    bad = (hint == "") | (F.length(hint) > 400) | (words > 60) | hint.rlike(r"\[[A-Za-z][^\]]*\]") | F.coalesce((plain != "") & F.contains(plain, hint), F.lit(False)) | F.coalesce((words > 40) & (F.length(hint) > 0.5 * F.length(plain)), F.lit(False))
    return F.when(~bad, hint)


def error_kind(message: Column) -> Column:
    """Kind of a logged error: permanent before transient, memory apart."""
    m = F.lower(message)
    return F.when(m.rlike(r"out of memory|\boom\b"), "memory").when(m.rlike(r"not found|\b(?:404|401|403)\b|forbidden|unauthori[sz]ed|gated|invalid"), "permanent").when(m.rlike(r"connection|timed? ?out|temporar|reset by peer|unreachable|\b50[234]\b"), "transient").otherwise("other")


def voice_family(model: Column) -> Column:
    m = F.lower(model)
    return F.when(m.contains("voicedesign"), "design").when(m.contains("customvoice"), "custom").when(m.contains("base"), "base").otherwise("other")
