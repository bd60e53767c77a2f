"""Page headers: form type and record id from noisy text, and the shapes in which answers about headers come.

Column functions that stay in the JVM. Null in, null out. Compatibility forms of Unicode (full-width, raised, circled,
ligatures) count as what they stand for.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packetlane.functions.text import FORM_TYPES, blank_to_null, norm_ws, valid_id

# Letters that readers confuse with digits; in the seven digits of an id, and in a text with none (where B may be the ending).
CONFUSED, MEANT = "OQDILSBG", "00011586"
CONFUSED_OUTSIDE, MEANT_OUTSIDE = "OQDILSG", "0001156"
#: How far from the start a bare PRE or POST counts, and how far GRADE may stand from the grade in run-together text.
HEAD, NEAR = 350, 18


def nfkc(c: Column) -> Column:
    """Unicode normalisation form KC, by the Unicode library that Spark itself ships; plain ASCII is left alone."""
    composed = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    return F.when(c.rlike(r"[^\x00-\x7F]"), composed).otherwise(c)


def normalize_header(c: Column) -> Column:
    """Upper case of form KC, with everything but letters, digits and hyphens as single spaces."""
    return norm_ws(F.regexp_replace(F.upper(nfkc(c)), r"(?U)[^A-Z0-9\s\-]", " "))


def _let(c: Column, use) -> Column:
    """use(c), with c computed once however often it is used."""
    return F.element_at(F.transform(F.array(c), use), 1)


def _grade(norm: Column, squeezed: Column, digit: str) -> Column:
    spelled = norm.rlike(rf"\b{digit}\s*T\s*H\b|\b{digit}\s+T\s+G\s*R\s*A\s*D\s*E\b|\b{digit}\s*TH\s*GRADE\b")
    at, grade = F.instr(squeezed, f"{digit}TH"), F.instr(squeezed, "GRADE")
    return spelled | ((at > 0) & (grade > 0) & (F.abs(at - grade) < NEAR))


def detect_grade(norm: Column) -> Column:
    """h, 8, 7 or 6 of a normalised header."""
    high = F.contains(norm, F.lit("HIGH")) & F.contains(norm, F.lit("SCHOOL"))
    return F.coalesce(F.when(high, "h"), _let(F.regexp_replace(norm, r"\s+", ""), lambda q: F.coalesce(*[F.when(_grade(norm, q, d), d) for d in "876"])))


def detect_phase(norm: Column) -> Column:
    """pre or post of a normalised header: what stands before ASSESS first, else as a word near the start."""
    pre, post = (F.regexp_instr(norm, F.lit(rf"{w}[\s\-_]*ASSESS")) for w in ("PRE", "POST"))
    head = F.substring(norm, 1, HEAD)
    word = head.rlike(r"\bPRE\b")
    has_post = F.contains(head, F.lit("POST"))
    return (
        F.when((pre > 0) & ((post == 0) | (pre < post)), "pre")
        .when(post > 0, "post")
        .when(has_post & word & (F.instr(head, "PRE") < F.instr(head, "POST")), "pre")
        .when(has_post, "post")
        .when(word | F.contains(head, F.lit("PRE-")), "pre")
    )


def form_type_allowed(c: Column, allowed: tuple[str, ...] = FORM_TYPES) -> Column:
    return _let(norm_ws(c), lambda v: F.when(v.isin(*allowed), v))


def infer_form_type(c: Column, allowed: tuple[str, ...] = FORM_TYPES) -> Column:
    return form_type_allowed(_let(normalize_header(c), lambda norm: F.concat(detect_grade(norm), detect_phase(norm))), allowed)


def normalize_id(c: Column) -> Column:
    """Seven digits and A or B, with confused letters put right in the seven; else up to 16 letters and digits; null if there are none."""
    found = rf"([0-9{CONFUSED} ]{{7}})([AB])"

    def of(s: Column) -> Column:
        spaced = F.translate(s, "\t\n", "  ")
        digits = F.regexp_replace(F.translate(F.regexp_extract(spaced, found, 1), CONFUSED + " ", MEANT), "[^0-9]", "")
        loose = F.regexp_replace(F.translate(s, CONFUSED_OUTSIDE, MEANT_OUTSIDE), "[^A-Z0-9]", "")
        inside = F.regexp_extract(loose, "([0-9]{7}[AB])", 1)
        return F.when(F.length(digits) == 7, F.concat(digits, F.regexp_extract(spaced, found, 2))).when(inside != "", inside).when(loose != "", F.substring(loose, 1, 16))

    return _let(norm_upper(c), of)


def norm_upper(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"(?U)\A\s+|\s+\z", ""))


def id_priority(*candidates: Column) -> Column:
    """The first candidate with a whole record id in it."""
    return F.coalesce(*[_let(normalize_id(c), lambda v: F.when(valid_id(v), v)) for c in candidates])


def form_type_priority(texts: list[Column], values: list[Column], allowed: tuple[str, ...] = FORM_TYPES) -> Column:
    """What the texts say, in their order; else the first value that is a form type."""
    return F.coalesce(*[infer_form_type(t, allowed) for t in texts], *[form_type_allowed(v, allowed) for v in values])


def _is_object(c: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json(c)), F.lit("OBJECT")), F.lit(False))


def coerce_batch(c: Column) -> Column:
    """JSON text -> array of JSON objects, one for each page; null if it has another shape.

    One answer, {"results": [...]}, a list of answers, or a list of such wrappers (an empty wrapper stands for an answer without values).
    """
    items = lambda x: F.filter(F.from_json(x, "array<string>"), _is_object)
    results = F.get_json_object(c, "$.results")
    single = _is_object(c) & (F.get_json_object(c, "$.id").isNotNull() | F.get_json_object(c, "$.form_type").isNotNull())
    every = F.from_json(F.when(F.startswith(F.trim(c), F.lit("[")), c), "array<string>")

    def opened(e: Column) -> Column:
        inner = F.get_json_object(e, "$.results")
        nested = items(inner)
        return F.when(F.startswith(inner, F.lit("[")), F.when(F.size(nested) > 0, nested).otherwise(F.array(F.lit("{}")))).otherwise(F.array(e))

    flat = F.when(F.forall(every, _is_object), F.flatten(F.transform(every, opened)))
    return F.when(single, F.array(c)).when(_is_object(c) & F.startswith(results, F.lit("[")), items(results)).otherwise(flat)


def last_parsed(raw: Column) -> Column:
    """JSON text of the parsed answer of the last stage, else of the top level."""
    stages = F.from_json(F.get_json_object(raw, "$.stages"), "array<string>")
    last = F.get_json_object(F.try_element_at(stages, F.lit(-1)), "$.parsed")
    top = F.get_json_object(raw, "$.parsed")
    return F.coalesce(F.when(_is_object(last), last), F.when(_is_object(top), top))


def header_fields(raw: Column, fallback_text: Column, allowed: tuple[str, ...] = FORM_TYPES) -> Column:
    """id and form_type of one page from the answer's JSON and the text read there."""
    get = F.get_json_object

    def of(parsed: Column) -> Column:
        record = id_priority(get(parsed, "$.id"), get(raw, "$.id"), fallback_text)
        texts = [get(parsed, "$.detected_text"), get(raw, "$.detected_text"), fallback_text]
        form = form_type_priority(texts, [get(parsed, "$.form_type"), get(raw, "$.form_type"), fallback_text], allowed)
        return F.struct(record.alias("id"), form.alias("form_type"))

    return _let(last_parsed(raw), of)


def same_name(a: Column, b: Column) -> Column:
    """Names of regions match whatever their case."""
    return F.lower(blank_to_null(a)) == F.lower(blank_to_null(b))
