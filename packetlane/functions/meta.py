"""Settings of regions and answers of models: steps, guards and shapes, as Column functions over JSON text and maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packetlane.functions.jsonfix import first_scalar_of
from packetlane.functions.text import NULL_WORDS, norm_ws

PASSES = "array<struct<type:string,body:string,model:string>>"
# Marks of the printed question in a field's text.
QUESTION_MARKS = ("could have made this experience better for you", "optional question")


def _text(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\A\s+|\s+\z", "")


def is_object(c: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json(c)), F.lit("OBJECT")), F.lit(False))


def meta_present(meta: Column, *keys: str) -> Column:
    """The value of the first key that a map has, even if that value is null."""
    out = F.lit(None).cast("string")
    for key in reversed(keys):
        out = F.when(F.map_contains_key(meta, key), F.try_element_at(meta, F.lit(key))).otherwise(out)
    return out


def meta_object(meta: Column, *keys: str) -> Column:
    """The same, if it is a JSON object."""
    value = meta_present(meta, *keys)
    return F.when(is_object(value), value)


def format_override(c: Column) -> Column:
    """json, or a JSON object; anything else is no format."""
    t = _text(c)
    return F.when((t == "json") | (F.startswith(t, F.lit("{")) & is_object(t)), t)


def one_pass(c: Column) -> Column:
    """type, body and model of one step, from JSON text of an object or of a string; null if it asks for nothing."""
    get = lambda *ks: F.coalesce(*[F.when(_text(F.get_json_object(c, f"$.{k}")) != "", _text(F.get_json_object(c, f"$.{k}"))) for k in ks])
    kind = F.lower(F.coalesce(get("type", "kind"), F.lit("llm")))
    step = lambda t, body, model: F.when(body.isNotNull(), F.struct(t.alias("type"), body.alias("body"), model.alias("model")))
    none = F.lit(None).cast("string")
    v = F.try_parse_json(c)
    plain = F.when(F.startswith(F.schema_of_variant(v), F.lit("STRING")), _text(F.try_variant_get(v, "$", "string")))
    return F.when(is_object(c), F.when(kind == "code", step(F.lit("code"), get("code", "snippet"), none)).otherwise(step(F.lit("llm"), get("prompt", "text"), get("model", "llm_model")))).otherwise(F.when(plain != "", F.struct(F.lit("llm").alias("type"), plain.alias("body"), none.alias("model"))))


def passes(meta: Column) -> Column:
    """passes and source of a region's steps: its list, the older list, the older single prompt, or none."""

    def listed(key: str) -> Column:
        items = F.from_json(F.try_element_at(meta, F.lit(key)), "array<variant>")
        return F.coalesce(F.array_compact(F.transform(items, lambda v: one_pass(F.to_json(v)))), F.array()).cast(PASSES)

    prompt = _text(F.try_element_at(meta, F.lit("llm_prompt_override")))
    none = F.lit(None).cast("string")
    single = F.array(F.struct(F.lit("llm").alias("type"), prompt.alias("body"), none.alias("model"))).cast(PASSES)
    of = lambda p, s: F.struct(p.alias("passes"), F.lit(s).alias("source"))
    return (
        F.when(F.map_contains_key(meta, "postprocess_passes"), of(listed("postprocess_passes"), "postprocess_passes"))
        .when(F.map_contains_key(meta, "llm_passes"), of(listed("llm_passes"), "legacy_llm_passes"))
        .when(prompt != "", of(single, "legacy_llm_prompt_override"))
        .otherwise(of(F.array().cast(PASSES), "none"))
    )


def select_model(requested: Column, fallback: Column, supported: Column) -> Column:
    """selected, source and reason: what is asked for if it is known (or nothing is known), else the fallback."""
    r, f = _text(requested), F.when(_text(fallback) != "", _text(fallback))
    unknown = (F.size(supported) > 0) & ~F.array_contains(supported, r)
    none = F.lit(None).cast("string")
    of = lambda m, s, why: F.struct(m.alias("selected"), F.lit(s).alias("source"), why.alias("reason"))
    return F.when(r == "", of(f, "fallback", F.lit("no_pass_model"))).when(unknown, of(f, "fallback", F.lit("unsupported_pass_model"))).otherwise(of(r, "pass", none))


def first_model(steps: Column, fallback: Column, supported: Column) -> Column:
    """The model of the first step that asks one."""
    first = F.try_element_at(F.filter(steps, lambda p: p["type"] == "llm"), F.lit(1))
    return F.when(first.isNotNull(), select_model(first["model"], fallback, supported)["selected"])


def internal_uid(c: Column) -> Column:
    return _text(c).rlike(r"\Ap[0-9]+:r[0-9]+:[^:\s]+\z")


def echoes_number(candidate: Column, name: Column, source: Column) -> Column:
    """An answer that is the number of its own field, where the text read has no such number."""
    v = _text(candidate)
    groups = F.regexp_extract_all(F.coalesce(source, F.lit("")), F.lit("[0-9]+"), 0)
    return (v == _text(name)) & v.rlike(r"\A[0-9]{1,3}\z") & ~F.array_contains(groups, v)


def regex_mismatch(candidate: Column, pattern: str | None) -> Column:
    """Whether a text fails a pattern in full; nothing to match, or no pattern, is no mismatch."""
    if not pattern:
        return F.lit(False)
    return (F.coalesce(candidate, F.lit("")) != "") & ~F.coalesce(candidate, F.lit("")).rlike(rf"\A(?:{pattern})\z")


def single_output(parsed: Column) -> Column:
    """found and value of an answer's object: detected_text, else its only value."""
    m = F.from_json(parsed, "map<string,string>")
    named = F.map_contains_key(m, "detected_text")
    only = F.size(m) == 1
    return F.struct((is_object(parsed) & F.coalesce(named | only, F.lit(False))).alias("found"), F.when(named, F.try_element_at(m, F.lit("detected_text"))).when(only, F.map_values(m)[0]).alias("value"))


def detected_text(parsed: Column, raw: Column, fallback: Column) -> Column:
    """The text of an answer; null answers and words for nothing are empty, other shapes fall back to the raw text."""
    single = single_output(parsed)
    value = norm_ws(F.coalesce(single["value"], F.lit("")))
    plain = _text(raw)
    return F.when(parsed.isNull(), "").when(single["found"], F.when(F.lower(value).isin(*NULL_WORDS), "").otherwise(value)).when(plain == "", fallback).otherwise(norm_ws(plain))


def normalize_parsed(parsed: Column) -> Column:
    """An answer's object as a map that always has detected_text, where it has text or any scalar that is not empty."""
    object_ = F.when(is_object(parsed), parsed)
    m = F.from_json(object_, "map<string,string>")
    value = F.when(F.map_contains_key(m, "text"), F.try_element_at(m, F.lit("text"))).otherwise(first_scalar_of(F.from_json(object_, "map<string,variant>")))
    add = ~F.map_contains_key(m, "detected_text") & (F.map_contains_key(m, "text") | value.isNotNull())
    return F.coalesce(F.when(add, F.map_concat(m, F.create_map(F.lit("detected_text"), value))).otherwise(m), F.create_map().cast("map<string,string>"))


def json_candidates(c: Column) -> Column:
    """Pieces of an answer that may be JSON, in the order to try them: fenced blocks, all of it, and from each brace to the next closing one."""
    t = _text(c)
    fences = F.regexp_extract_all(t, F.lit(r"(?is)```(?:json)?\s*(.*?)(?:```|\z)"), 1)
    braces = F.regexp_extract_all(t, F.lit(r"(?s)(?=(\{[^}]*\}?))."), 1)
    every = F.transform(F.concat(fences, F.array(t), braces), _text)
    return F.array_distinct(F.filter(every, lambda x: x != ""))


def strip_malformed(c: Column) -> Column:
    """A value without the quotes, ticks and commas around it."""
    t = _text(F.regexp_replace(F.regexp_replace(_text(c), r"\A`+|`+\z", ""), r"\s*```\s*\z", ""))
    t = _text(F.regexp_replace(_text(t), r"\A,+|,+\z", ""))
    return _text(F.regexp_replace(F.regexp_replace(t, r'\A"+|"+\z', ""), r"\A'+|'+\z", ""))


def merge_params(base: Column, override: Column) -> Column:
    """One map of JSON texts over another; values that are objects on both sides are merged key by key."""
    both = F.map_zip_with(base, override, lambda _, a, b: F.when(b.isNull(), a).when(is_object(a) & is_object(b), _merged(a, b)).otherwise(b))
    return F.when(override.isNull(), base).otherwise(both)


def _merged(a: Column, b: Column) -> Column:
    x, y = (F.from_json(c, "map<string,variant>") for c in (a, b))
    return F.to_json(F.map_zip_with(x, y, lambda _, u, v: F.coalesce(v, u)))


def overall_status(needs_review: Column, any_accepted: Column, text: Column) -> Column:
    return F.when(F.coalesce(needs_review, F.lit(False)), "REVIEW_REQUIRED").when(~F.coalesce(any_accepted, F.lit(False)), "NO_ACCEPTED_STAGE").when(_text(text) != "", "AUTO_ACCEPTED").otherwise("ACCEPTED_EMPTY_TEXT")


def classify_output(given: Column, answer: Column, is_text: Column) -> Column:
    """What a clean-up did: null, invalid_json, unchanged, header_cleanup or other_text."""
    low = F.lower(norm_ws(F.coalesce(given, F.lit(""))))
    marked = F.lit(False)
    for m in QUESTION_MARKS:
        marked = marked | F.contains(low, F.lit(m))
    return F.when(answer.isNull(), "null").when(~is_text, "invalid_json").when(norm_ws(answer) == norm_ws(F.coalesce(given, F.lit(""))), "unchanged").when(marked, "header_cleanup").otherwise("other_text")


def label_norm(c: Column) -> Column:
    """high, medium or low; what is none of them is low."""
    t = F.lower(_text(c))
    return F.when(t.isin("high", "medium"), t).otherwise("low")


# What a reader's note about itself holds when it was not sure.
DOUBTS = ("legibility_issues", "ambiguities", "missing_regions")
DOUBT_WORDS = ("unclear", "illegible", "ambiguous", "cropped", "cut off", "partial", "blur", "faint", "uncertain")


def uncertain(parsed: Column) -> Column:
    """Whether the `self_evaluation` of an answer (JSON text) names a doubt: a list with any text or a text, or a reason with a word of doubt."""
    said = F.get_json_object(parsed, "$.self_evaluation")

    def doubt(name: str) -> Column:
        value = F.get_json_object(said, f"$.{name}")
        listed = F.from_json(F.when(F.startswith(value, F.lit("[")), value), "array<string>")
        filled = F.exists(listed, lambda x: F.trim(F.coalesce(x, F.lit("null"))) != "")
        # numbers, booleans and objects are no doubts; texts come without their quotes, so the type tells
        text = F.coalesce(F.schema_of_variant(F.try_variant_get(F.try_parse_json(said), f"$.{name}", "variant")) == "STRING", F.lit(False))
        return F.coalesce(filled & ~text, F.lit(False)) | (text & (F.trim(F.coalesce(value, F.lit(""))) != ""))

    reason = F.lower(F.coalesce(F.get_json_object(said, "$.reason_for_confidence"), F.lit("")))
    held = [doubt(n) for n in DOUBTS] + [F.contains(reason, F.lit(w)) for w in DOUBT_WORDS]
    found = held[0]
    for h in held[1:]:
        found = found | h
    return F.coalesce(F.startswith(said, F.lit("{")) & found, F.lit(False))
