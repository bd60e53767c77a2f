"""Run-wide value normalisation: consensus, repeated canonicals, fuzzy assignment, checked proposals, and all of it in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetlane.functions.fuzzy import similarity_ratio
from packetlane.functions.text import alpha_signature, levenshtein_similarity, norm_ws, optional_question, placeholder, strip_question_header, structured_id

RATIO = 0.72
LEAST_PART = 3
# Modes of cleaning a field, and older names of them.
MODES = ("casual", "aggressive", "consensus")
ALIASES = {"strict": "casual", "conservative": "casual", "balanced": "aggressive"}


def value_counts(rows: DataFrame, field: list[str], value: Column, position: Column | None = None) -> DataFrame:
    """n of each value of each field, and where it was first seen if rows have a position."""
    v = norm_ws(value)
    first = [F.min("pos").alias("first_seen")] if position is not None else []
    return rows.select(*field, v.alias("value"), *([position.alias("pos")] if first else [])).where("value <> ''").groupBy(*field, "value").agg(F.count(F.lit(1)).alias("n"), *first)


def _order(counts: DataFrame) -> list[str]:
    """Of equally frequent values the first seen counts, or the least text."""
    return [*(["first_seen"] if "first_seen" in counts.columns else []), "value"]


def repeated_canonicals(counts: DataFrame, field: list[str], least: int = 2, name: Column | None = None) -> DataFrame:
    """Values that occur often enough and are neither codes nor placeholders of the field called `name`, ranked by count."""
    w = Window.partitionBy(*field).orderBy(F.desc("n"), *_order(counts))
    return counts.where((F.col("n") >= least) & ~structured_id(F.col("value")) & ~placeholder(F.col("value"), name)).withColumn("rank", F.row_number().over(w))


def dominant(counts: DataFrame, field: list[str], name: Column | None = None) -> DataFrame:
    """The most frequent value of each field and why it counts or not: it needs max(2, min(3, 12 % rounded up)) rows."""
    by = F.min(F.struct((-F.col("n")).alias("neg"), *_order(counts)))
    best = counts.groupBy(*field).agg(F.sum("n").alias("total"), by.alias("b"), F.count(F.lit(1)).alias("distinct_values"))
    need = F.greatest(F.lit(2), F.least(F.lit(3), F.ceil(F.col("total") * 0.12)))
    n = -F.col("b.neg")
    reason = F.when(n < need, "too_few").when(placeholder(F.col("b.value"), name), "placeholder").when(structured_id(F.col("b.value")), "structured_id").otherwise("dominant")
    return best.select(*field, F.col("b.value").alias("value"), n.alias("n"), "total", need.cast("long").alias("min_count"), reason.alias("reason"))


def assign_clusters(values: DataFrame, canonicals: DataFrame, field: list[str], method: str = "ratio", least: float = RATIO) -> DataFrame:
    """Each value's most similar canonical of its field, if it is similar enough or one of the two holds the other.

    Candidates come from an equi-join on the field; the Python ratio sees each pair of texts once. Of equally similar canonicals the more frequent counts.
    """
    a, b = alpha_signature(F.col("value")), alpha_signature(F.col("canonical"))
    pairs = values.join(canonicals.select(*field, F.col("value").alias("canonical"), F.col("rank")), field).where((a != "") & (b != ""))
    same = F.col("value") == F.col("canonical")
    scored = pairs.withColumn("score", levenshtein_similarity(a, b) if method == "levenshtein" else F.when(same, 1.0).otherwise(similarity_ratio(F.when(~same, a), F.when(~same, b))))
    best = scored.groupBy(*field, "value").agg(F.min(F.struct((-F.col("score")).alias("neg"), F.col("rank").alias("rank"), F.col("canonical").alias("canonical"))).alias("b"))
    out = best.select(*field, "value", F.col("b.canonical").alias("canonical"), (-F.col("b.neg")).alias("score"))
    c = alpha_signature(F.col("canonical"))
    return out.where((F.col("score") >= least) | ((F.length(a) >= LEAST_PART) & (F.contains(a, c) | F.contains(c, a))))


def field_mode(mode: Column) -> Column:
    """How a field is cleaned; what is no mode, or nothing, means the default."""
    m = F.lower(norm_ws(F.coalesce(mode, F.lit(""))))
    known = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    return F.when(m.isin(*MODES), m).otherwise(F.coalesce(F.try_element_at(known, m), F.lit(MODES[1])))


def checked_proposals(counts: DataFrame, proposals: DataFrame, field: list[str]) -> tuple[DataFrame, DataFrame]:
    """(fields with error, values with proposed) of the answers to a field's values. proposals: the field, answer (JSON text), attempt.

    An answer must be an object with some of the values as keys, and with texts or nulls as values; keys left out propose
    themselves, placeholders propose nothing. The first attempt without an error counts.
    """
    answer = F.from_json(F.col("answer"), "map<string,variant>")
    given = proposals.select(*field, "attempt", answer.alias("m"), F.startswith(F.schema_of_variant(F.try_parse_json("answer")), F.lit("OBJECT")).alias("is_object"))
    both = counts.select(*field, "value").join(given, field)
    has = F.coalesce(F.map_contains_key("m", F.col("value")), F.lit(False))
    got = F.try_element_at("m", F.col("value"))
    kind = F.schema_of_variant(got)
    text = norm_ws(F.coalesce(F.try_variant_get(got, "$", "string"), F.lit("")))
    silent = placeholder(text) & (text != "")
    said = has & (kind != "VOID")
    checked = both.select(*field, "attempt", "value", "is_object", has.alias("has"), (said & ~F.startswith(kind, F.lit("STRING"))).alias("odd"), (said & (text == "")).alias("blank"), F.when(~has, F.col("value")).when(silent, "").otherwise(text).alias("proposed"))
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    error = F.when(~any_("is_object"), "not_object").when(~any_("has"), "no_expected_keys").when(any_("odd"), "non_string").when(any_("blank"), "empty_string")
    tried = checked.groupBy(*field, "attempt").agg(error.alias("error"))
    good = tried.where("error is null").groupBy(*field).agg(F.min("attempt").alias("attempt"))
    return tried, checked.join(good, [*field, "attempt"]).select(*field, "value", "proposed")


def batch_normalize(rows: DataFrame, enabled: DataFrame, proposals: DataFrame, *, form: str = "form_type", name: str = "name", text: str = "text", kind: str = "kind", position: str = "position") -> DataFrame:
    """Adds normalized and reason to every row. enabled: form, name, mode; proposals: form, name, attempt, answer.

    Only texts of enabled fields take part. A field without a valid answer stays as it is. In consensus mode a clear
    dominant value replaces all, in aggressive mode values go to their clusters, else the answer counts; the printed
    question is cut from optional fields; a value that would vanish without being a placeholder stays. Everything is
    computed once for each distinct value of a field: groups are pre-aggregated, and rows meet them by equi-joins.
    """
    field = ["__form", "__name"]
    key = lambda c: norm_ws(F.coalesce(F.col(c).cast("string"), F.lit("")))
    tagged = rows.withColumns({"__form": key(form), "__name": key(name), "__value": key(text), "__text": F.lower(key(kind)) == "text"})
    on = enabled.select(key(form).alias("__form"), key(name).alias("__name"), field_mode(F.col("mode")).alias("__mode")).dropDuplicates(field)
    live = tagged.where("__text and __form <> '' and __name <> '' and __value <> ''").join(on, field)
    counts = value_counts(live, field, F.col("__value"), F.col(position))
    _, proposed = checked_proposals(counts, proposals.select(key(form).alias("__form"), key(name).alias("__name"), "attempt", "answer"), field)
    label = F.col("__name")
    clear = dominant(counts, field, label).where("reason = 'dominant'").select(*field, F.col("value").alias("__dominant"))
    crowded = counts.join(on.where("__mode = 'aggressive'"), field)
    clusters = assign_clusters(crowded, repeated_canonicals(crowded, field, name=label), field).select(*field, "value", F.col("canonical").alias("__canonical"))
    repeated = repeated_canonicals(crowded, field, name=label).select(*field).distinct().withColumn("__clustered", F.lit(True))
    v = F.col("value")
    made = proposed.join(on, field).join(clear, field, "left").join(clusters, [*field, "value"], "left").join(repeated, field, "left")
    empty = placeholder(v, label)
    by_mode = F.when(F.col("__mode") == "consensus", F.coalesce("__dominant", "proposed")).when((F.col("__mode") == "aggressive") & F.col("__clustered") & empty, "").when(F.col("__mode") == "aggressive", F.coalesce("__canonical", "proposed")).otherwise(F.col("proposed"))
    optional = optional_question(F.col("__form"), label)
    cut = F.when(optional, strip_question_header(by_mode)).otherwise(by_mode)
    stays = (cut == "") & ~empty & (F.when(optional, strip_question_header(v)).otherwise(v) != "")
    final = F.when(stays, F.when(optional, strip_question_header(v)).otherwise(v)).otherwise(cut)
    mapped = made.select(*field, v.alias("__value"), final.alias("__new"), optional.alias("__optional"))
    out = tagged.join(on, field, "left").join(mapped, [*field, "__value"], "left")
    new, old = F.col("__new"), F.col("__value")
    reason = (
        F.when(~F.col("__text") | (F.col("__form") == ""), "not_text")
        .when(F.col("__mode").isNull(), "not_enabled")
        .when(old == "", "empty")
        .when(new.isNull(), "no_valid_response")
        .when((new == "") & F.col("__optional"), "applied")
        .when(new == "", "empty_normalized")
        .when(new == old, "unchanged")
        .otherwise("applied")
    )
    return out.withColumn("reason", reason).withColumn("normalized", F.when(F.col("reason") == "applied", new).otherwise(F.col(text))).select(*rows.columns, "normalized", "reason")


def original_snapshot(rows: DataFrame, raw: str = "raw_text", text: str = "text", kind: str = "kind") -> DataFrame:
    """Text rows as they were read, before any clean-up, where that was kept."""
    return rows.withColumn(text, F.when((F.lower(F.trim(kind)) == "text") & F.col(raw).isNotNull(), F.col(raw)).otherwise(F.col(text)))


def original_ids(rows: DataFrame, item: str, position: str, name: str = "name", text: str = "text") -> DataFrame:
    """item and id: the last row called id of each item of a snapshot."""
    ids = rows.where(F.lower(F.trim(name)) == "id")
    return ids.groupBy(item).agg(F.trim(F.max_by(F.coalesce(text, F.lit("")), position)).alias("id"))


def enabled_fields(schemas: DataFrame) -> DataFrame:
    """form_type, name, mode of regions whose schema switches clean-up on. schemas: form_type, name, normalize (boolean), mode."""
    on = schemas.where(F.coalesce("normalize", F.lit(False)))
    return on.select(norm_ws(F.col("form_type")).alias("form_type"), norm_ws(F.col("name")).alias("name"), field_mode(F.col("mode")).alias("mode")).where("form_type <> '' and name <> ''").dropDuplicates(["form_type", "name"])


def apply_map(rows: DataFrame, mapping: DataFrame, field: list[str], value: str, enabled: DataFrame | None = None) -> DataFrame:
    """Adds normalized and reason (applied, unchanged, not_enabled, empty)."""
    key = norm_ws(F.col(value))
    out = rows.withColumn("__v", key)
    if enabled is not None:
        out = out.join(enabled.select(*field).distinct().withColumn("__on", F.lit(True)), field, "left")
    else:
        out = out.withColumn("__on", F.lit(True))
    out = out.join(mapping.select(*field, F.col("value").alias("__v"), F.col("canonical").alias("__c")), [*field, "__v"], "left")
    on = F.coalesce("__on", F.lit(False))
    new = F.when(on & F.col("__c").isNotNull() & (F.col("__c") != F.col("__v")), F.col("__c"))
    reason = F.when(F.coalesce("__v", F.lit("")) == "", "empty").when(~on, "not_enabled").when(new.isNotNull(), "applied").otherwise("unchanged")
    return out.withColumns({"normalized": F.coalesce(new, F.col(value)), "reason": reason}).drop("__v", "__c", "__on")
