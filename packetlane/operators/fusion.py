"""Two readings of one field become one text: a ladder of rules over columns, decided row by row in the JVM.

Only the similarity of two texts is a vectorised Python function; it sees a pair only where neither text holds the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlane.functions import labels as L
from packetlane.functions.fuzzy import similarity_ratio
from packetlane.functions.text import dedupe_halves, norm_ws

P = "__fusion_"


def ratio_of(x: Column, y: Column) -> Column:
    """Similarity of two compact texts; where one holds the other it follows from their lengths, and nothing goes to Python."""
    inside = F.contains(x, y) | F.contains(y, x)
    by_length = F.when((x == "") | (y == ""), 0.0).otherwise(2.0 * F.least(F.length(x), F.length(y)) / (F.length(x) + F.length(y)))
    return F.when(inside, by_length).otherwise(similarity_ratio(F.when(~inside, x), F.when(~inside, y)))


def fuse(df: DataFrame, page: str, line: str) -> DataFrame:
    """Adds `fused`, and `reason` where rules alone decide (else null: a model may be asked, and `fused` is the union of both).

    page: text of the reader that sees the page; line: text of the scored line reader.
    """
    sides = ("compact", "known", "weak", "fuzzy", "dates", "quality")
    tails = (*sides, "digits", "words")
    out, v, names_v = L.held(df, P + "v", L.canonical_label(F.col(page)), *sides)
    out, p, names_p = L.held(out, P + "p", L.canonical_label(F.col(line)), *sides)
    out = out.withColumns({P + "vs": L.split_prompt(v.text), P + "ps": L.split_prompt(p.text)})
    vp, pp = F.col(P + "vs.prompt"), F.col(P + "ps.prompt")
    asked = (vp != "") | (pp != "")
    prompt = F.when((vp != "") & (pp != ""), L.cleaner(L.Reading(vp), L.Reading(pp))).when(vp != "", vp).otherwise(pp)
    out, q, names_q = L.held(out, P + "q", prompt, "compact", "fuzzy", "words")
    out, vt, names_vt = L.held(out, P + "vt", F.col(P + "vs.tail"), *tails)
    out, pt, names_pt = L.held(out, P + "pt", F.col(P + "ps.tail"), *tails)
    out = out.withColumns({P + "r": ratio_of(v.compact, p.compact), P + "rt": ratio_of(F.when(asked, vt.compact).otherwise(""), F.when(asked, pt.compact).otherwise("")), P + "kind": L.prompt_kind(q.text)})
    r, kind = F.col(P + "r"), F.col(P + "kind")
    out, tail, names_t = L.held(out, P + "t", F.when(asked, L.choose_tail(vt, pt, kind, q.words, F.col(P + "rt"))).otherwise(""), "compact", "known", "fuzzy", "words")
    out = out.withColumn(P + "rq", ratio_of(q.compact, tail.compact))
    echoed = L.subset(tail.words, q.words) & kind.isin("age", "question")
    repeated = L.near_duplicate(q, tail, F.col(P + "rq")) | F.contains(q.compact, tail.compact)
    out = out.withColumn(P + "s", F.when(asked, F.when(~tail.known | echoed | repeated, q.text).otherwise(L.join_prompt(q.text, tail.text))))
    out = out.withColumns({P + "a": L.ambiguous_token(v, p, r), P + "n": L.near_duplicate(v, p, r)})
    s, ambiguous, near = F.col(P + "s"), F.col(P + "a"), F.col(P + "n")
    reason = F.when(~v.known | ~p.known, "single_source").when(v.weak | p.weak, "low_signal_source").when(s.isNotNull(), "structured_prompt_tail").when(ambiguous, "ambiguous_single_token").when(near, "near_duplicate")
    filled = (v.compact != "") & (p.compact != "")
    alike = (filled & ((v.compact == p.compact) | L.trimmed(v, p))) | ((ambiguous | near | (v.text == p.text)) & ~(filled & (F.contains(p.compact, v.compact) | F.contains(v.compact, p.compact))))
    text = (
        F.when(~v.known, p.text)
        .when(~p.known, v.text)
        .when(v.weak != p.weak, F.when(v.weak, p.text).otherwise(v.text))
        .when(s.isNotNull(), s)
        .when(alike, L.prefer_similar(v, p, r))
        .when(filled & F.contains(p.compact, v.compact), p.text)
        .when(filled & F.contains(v.compact, p.compact), v.text)
        .when(v.weak, p.text)
        .when(L.subset(v.telling, p.telling) | L.subset(p.telling, v.telling), L.prefer_substantial(v, p))
        .when((F.size(p.dates) > 0) & (F.size(v.dates) == 0), L.append_detail(p, v, r))
        .otherwise(L.append_detail(v, p, r))
    )
    own = [*names_v, *names_p, *names_q, *names_vt, *names_pt, *names_t, *[P + n for n in ("vs", "ps", "r", "rt", "kind", "rq", "s", "a", "n")]]
    return out.withColumns({"fused": text, "reason": reason}).drop(*own)


def clean_candidate(c: Column) -> Column:
    """A model's answer without the names of its sources, and said once."""
    return dedupe_halves(F.regexp_replace(norm_ws(c), r"(?i)\b(?:OCR\s*[AB]|Output)\s*:\s*", " "))


def accept_candidates(df: DataFrame, candidate: str, page: str, line: str) -> DataFrame:
    """`fused` becomes the cleaned candidate of rows without a reason, where it keeps both readings; adds `candidate_kept`."""
    out = df.withColumn(P + "c", clean_candidate(F.coalesce(F.col(candidate), F.lit(""))))
    parts = ("compact", "fuzzy", "dates")
    out, c, names_c = L.held(out, P + "cc", L.canonical_label(F.col(P + "c")), "known", *parts)
    out, v, names_v = L.held(out, P + "v", L.canonical_label(F.col(page)), *parts)
    out, p, names_p = L.held(out, P + "p", L.canonical_label(F.col(line)), *parts)
    out = out.withColumns({P + "rv": ratio_of(c.compact, v.compact), P + "rp": ratio_of(c.compact, p.compact)})
    kept = F.col("reason").isNull() & c.known & L.preserves_source(c, v, F.col(P + "rv")) & L.preserves_source(c, p, F.col(P + "rp"))
    out = out.withColumn("candidate_kept", F.coalesce(kept, F.lit(False)))
    out = out.withColumn("fused", F.when(F.col("candidate_kept"), F.col(P + "c")).otherwise(F.col("fused")))
    return out.drop(*names_c, *names_v, *names_p, P + "c", P + "rv", P + "rp")


def fusion_prompt(template: Column, page: Column, line: Column, line_json: Column) -> Column:
    """A prompt's template with the two readings put in."""
    for token, value in (("{vlm_text}", page), ("{ocr_text}", page), ("{paddle_text}", line), ("{paddle_confidence}", line_json), ("{paddle_confidence_json}", line_json)):
        template = F.replace(template, F.lit(token), F.coalesce(value, F.lit("")))
    return template


def sidecar_text(detected: Column, parts: Column) -> Column:
    """A second reading's text, else its parts joined."""
    text = norm_ws(F.coalesce(detected, F.lit("")))
    return F.when(text != "", text).otherwise(norm_ws(F.array_join(F.filter(F.transform(parts, F.trim), lambda x: x != ""), " ")))


def is_fusion(raw_workflow: Column, meta_workflow: Column, name: str) -> Column:
    """Whether a row's workflow, by its answer or else by its region, is the named one."""
    clean = lambda c: F.lower(norm_ws(F.coalesce(c, F.lit(""))))
    return F.when(clean(raw_workflow) != "", clean(raw_workflow)).otherwise(clean(meta_workflow)) == name
