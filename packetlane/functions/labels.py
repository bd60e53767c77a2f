"""Canonical text of labelled fields, and the parts in which two readings of one field are compared.

All of it is Column algebra that stays in the JVM; similarity ratios come in as columns (see functions.fuzzy). Texts
are never null here: null reads as empty.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlane.functions.text import DATE, compact_alnum, date_signatures, digit_ratio, digits_preserved, has_evidence, low_signal, norm_ws, nontrivial_words, quality_score, strip_markup, word_signatures

# Labels of the printed forms and how they are found; the share of equal characters that makes two readings one.
LABELS = {"Record ID: ": r"\bRecord\s*ID\s*:", "Name of Teacher: ": r"\bName\s+of\s+Teacher\s*:", "Name of School: ": r"\bName\s+of\s+School\s*:", "Today's Date: ": r"\bToday'?s\s+Date\s*:"}
LABEL = "Record ID|Name of Teacher|Name of School|Today's Date"
KINDS = {"today's date:": "date", "record id:": "id", "name of teacher:": "teacher", "name of school:": "school", "what is your age?": "age"}
NEAR, AMBIGUOUS = 0.78, 0.5


def canonical_label(c: Column) -> Column:
    """Labels spelled one way and standing first, one space after each colon."""
    t = strip_markup(F.coalesce(c, F.lit("")))
    for label, pattern in LABELS.items():
        t = F.regexp_replace(t, f"(?i){pattern}", label)
    t = F.regexp_replace(t, rf"(?i)\A(.+?)\s+({LABEL}):\s*\z", "$2: $1")
    date = F.regexp_extract(t, DATE, 0)
    dated = F.contains(F.lower(t), F.lit("today")) & F.contains(F.lower(t), F.lit("date")) & (date != "")
    t = F.when(dated, F.concat(F.lit("Today's Date: "), date)).otherwise(t)
    return norm_ws(F.regexp_replace(F.regexp_replace(t, r"\s+:", ":"), r":(?=\S)", ": "))


class Reading:
    """A canonical text and what rules ask of it; each part is built on first use, or is a column of a table that holds it."""

    def __init__(self, text: Column):
        self.text = text

    compact = cached_property(lambda self: compact_alnum(self.text))
    known = cached_property(lambda self: has_evidence(self.text))
    weak = cached_property(lambda self: low_signal(self.text))
    fuzzy = cached_property(lambda self: (F.length(self.compact) >= 5) & (digit_ratio(self.text) < 0.45) & self.compact.rlike("[a-z]"))
    digits = cached_property(lambda self: F.length(F.regexp_replace(self.text, "[^0-9]", "")))
    dates = cached_property(lambda self: date_signatures(self.text))
    words = cached_property(lambda self: word_signatures(self.text))
    telling = cached_property(lambda self: nontrivial_words(self.text))
    quality = cached_property(lambda self: quality_score(self.text))


def held(df: DataFrame, name: str, c: Column, *parts: str) -> tuple[DataFrame, Reading, list[str]]:
    """df with a text and these parts of its reading as columns, the reading made of them, and the columns' names."""
    columns = {p: f"{name}_{p}" for p in ("text", *parts)}
    df = df.withColumn(columns["text"], c)
    inline, out = Reading(F.col(columns["text"])), Reading(F.col(columns["text"]))
    df = df.withColumns({columns[p]: getattr(inline, p) for p in parts})
    for p in parts:
        out.__dict__[p] = F.col(columns[p])
    return df, out, list(columns.values())


def placeholder_only(r: Reading) -> Column:
    return r.text.rlike(r"\A(?:_+\s*)*\z")


def split_prompt(c: Column) -> Column:
    """prompt and tail of a canonical text: a known label, else at least five words up to a last mark with at most five words after it."""
    known = rf"(?i)\A((?:{LABEL}):)\s*(.+)\z"
    part = lambda p, t: F.struct(norm_ws(p).alias("prompt"), norm_ws(t).alias("tail"))
    words = lambda x: F.when(x == "", 0).otherwise(F.size(F.split(x, " ")))
    out = F.when(c.rlike(known), part(F.regexp_extract(c, known, 1), F.regexp_extract(c, known, 2)))
    for mark in (r"\.", r"\?", ":"):
        cut = rf"(?s)\A(.*{mark})(.*)\z"
        both = part(F.regexp_extract(c, cut, 1), F.regexp_extract(c, cut, 2))
        out = out.when((words(both["prompt"]) >= 5) & words(both["tail"]).between(1, 5), both)
    return out.otherwise(part(F.lit(""), c))


def prompt_kind(c: Column) -> Column:
    """Of a canonical prompt: date, id, teacher, school, age, question or nothing."""
    low = F.lower(c)
    named = F.coalesce(*[F.when(F.contains(low, F.lit(text)), name) for text, name in KINDS.items()])
    return F.coalesce(named, F.when(low != "", "question"), F.lit(""))


def _within(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def near_duplicate(a: Reading, b: Reading, ratio: Column) -> Column:
    return a.fuzzy & b.fuzzy & (_within(a.compact, b.compact) | (ratio >= NEAR))


def ambiguous_token(a: Reading, b: Reading, ratio: Column) -> Column:
    """Two single words of letters and digits, alike but not the same."""
    x, y = a.compact, b.compact
    one = ~F.contains(a.text, F.lit(" ")) & ~F.contains(b.text, F.lit(" "))
    return one & x.rlike("[a-z]") & y.rlike("[a-z]") & (x.rlike("[0-9]") | y.rlike("[0-9]")) & (F.abs(F.length(x) - F.length(y)) <= 2) & (ratio >= AMBIGUOUS)


def trimmed(a: Reading, b: Reading) -> Column:
    """One of two compact texts is the other with up to two characters behind it."""
    x, y = a.compact, b.compact
    return (F.startswith(x, y) | F.startswith(y, x)) & (F.abs(F.length(x) - F.length(y)) <= 2)


def cleaner(a: Reading, b: Reading) -> Column:
    """The reading with less noise: of a text and the same with a little more, the shorter; of a text inside another, the longer."""
    x, y = a.compact, b.compact
    full = (x != "") & (y != "")
    return (
        F.when(full & trimmed(a, b), F.when(F.length(x) <= F.length(y), a.text).otherwise(b.text))
        .when(full & F.contains(y, x), b.text)
        .when(full & F.contains(x, y), a.text)
        .when(a.quality >= b.quality, a.text)
        .otherwise(b.text)
    )


def prefer_second(a: Reading, b: Reading) -> Column:
    return F.when(b.known, b.text).otherwise(a.text)


def prefer_similar(a: Reading, b: Reading, ratio: Column) -> Column:
    return F.when(ambiguous_token(a, b, ratio), prefer_second(a, b)).otherwise(cleaner(a, b))


def prefer_substantial(a: Reading, b: Reading) -> Column:
    return F.when(a.weak & b.known, b.text).when(b.weak & a.known, a.text).otherwise(cleaner(a, b))


def preserves_source(candidate: Reading, source: Reading, ratio: Column) -> Column:
    """Whether all of a source is in a candidate: as it is, by its dates and what stands beside them, or nearly."""

    def plain(s: Reading) -> Column:
        return (s.compact == "") | F.contains(candidate.compact, s.compact) | (digits_preserved(s.text, candidate.text) & near_duplicate(candidate, s, ratio))

    dated = (F.size(source.dates) > 0) & (F.size(F.array_except(source.dates, candidate.dates)) == 0)
    return plain(source) | (dated & plain(Reading(norm_ws(F.regexp_replace(source.text, DATE, "")))))


def subset(a: Column, b: Column) -> Column:
    """Whether a set of words is not empty and within another."""
    return (F.size(a) > 0) & (F.size(F.array_except(a, b)) == 0)


def append_detail(base: Reading, more: Reading, ratio: Column) -> Column:
    """base with the words of `more` that it has not."""
    noise = F.exists(F.regexp_extract_all(more.text, F.lit("[0-9]+"), 0), lambda g: ~F.contains(F.regexp_replace(base.text, "[^0-9]", ""), g))
    repeats = subset(more.words, base.words) & (F.size(base.dates) > 0) & (F.size(more.dates) == 0) & noise
    own = F.filter(F.transform(F.split(base.text, " "), compact_alnum), lambda x: x != "")
    new = F.array_join(F.filter(F.split(more.text, " "), lambda w: (compact_alnum(w) != "") & ~F.exists(own, lambda h: _within(h, compact_alnum(w)))), " ")
    return F.when(~base.known, more.text).when(~more.known | near_duplicate(base, more, ratio) | repeats, base.text).otherwise(norm_ws(F.concat_ws(" ", base.text, new)))


def choose_tail(a: Reading, b: Reading, kind: Column, words: Column, ratio: Column) -> Column:
    """The better of two answers to one printed prompt of a kind, which has these words."""
    n, m = a.digits, b.digits
    da, db = F.size(a.dates) > 0, F.size(b.dates) > 0
    echo = lambda r: (F.size(words) > 0) & (F.size(F.array_except(r.words, words)) == 0)
    long_a, long_b = F.length(a.compact) >= 6, F.length(b.compact) >= 6
    date, age, code = kind == "date", kind == "age", kind == "id"
    first = ~b.known | (a.known & ~placeholder_only(a) & placeholder_only(b))
    by_kind = (
        F.when(date & (da != db), da)
        .when(date & (n >= 4) & (m == 0), True)
        .when(date & (m >= 4) & (n == 0), False)
        .when(age & ((n > 0) != (m > 0)), n > 0)
        .when(age & echo(a) & (m > 0), False)
        .when(age & echo(b) & (n > 0), True)
        .when(code & (long_a != long_b), long_a)
        .when(kind.isin("teacher", "school") & (a.weak != b.weak), b.weak)
    )
    return (
        F.when(~a.known, b.text)
        .when(first, a.text)
        .when(placeholder_only(a), b.text)
        .when(by_kind, a.text)
        .when(~by_kind, b.text)
        .when(near_duplicate(a, b, ratio) | ambiguous_token(a, b, ratio), cleaner(a, b))
        .when(a.weak != b.weak, F.when(a.weak, b.text).otherwise(a.text))
        .otherwise(cleaner(a, b))
    )


def join_prompt(prompt: Column, tail: Column) -> Column:
    return norm_ws(F.concat_ws(" ", prompt, tail))
