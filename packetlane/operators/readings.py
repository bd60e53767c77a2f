"""Readings of fields by several engines: strategies, fallbacks, regex gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlane.functions.jsonfix import fenced
from packetlane.functions.meta import echoes_number, internal_uid, is_object, meta_present, passes, select_model
from packetlane.functions.text import NULL_WORDS, coerce_score, norm_ws, score_label
from packetlane.operators.fusion import fuse

ACCEPT = 0.90
STRATEGIES = ("first_only", "second_only", "fallback", "second_with_first_score", "fusion")


def choose_reading(pairs: DataFrame, strategy: str, accept: float = ACCEPT) -> DataFrame:
    """pairs: columns a_text, a_score, b_text, b_score (a: scored line reader, b: page reader; null if it failed).

    Adds text, score, label and text_source. Only the fusion strategy runs Python, for the similarity of two texts.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy {strategy!r} is none of {STRATEGIES}")
    a, b = F.col("a_text"), F.col("b_text")
    a_score, b_score = coerce_score(F.col("a_score"), F.lit(None), F.lit(None)), coerce_score(F.col("b_score"), F.lit(None), F.lit(None))
    if strategy == "fusion":
        out = fuse(pairs, "b_text", "a_text").withColumns({"text": F.col("fused"), "text_source": F.coalesce("reason", F.lit("union")), "score": F.coalesce(F.when(a.isNotNull(), a_score), b_score)}).drop("fused", "reason")
    else:
        first = {"first_only": F.lit(True), "second_only": F.lit(False), "fallback": (a_score > accept) & a.isNotNull() | b.isNull(), "second_with_first_score": b.isNull()}[strategy]
        score = F.when(a.isNotNull(), a_score).otherwise(b_score) if strategy == "second_with_first_score" else F.when(first, a_score).otherwise(b_score)
        out = pairs.withColumns({"text": F.coalesce(F.when(first, a).otherwise(b), F.lit("")), "text_source": F.when(first, "first").otherwise("second"), "score": score})
    return out.withColumn("label", score_label(F.col("score")))


def regex_gate(attempts: Column, pattern: str) -> Column:
    """The first attempt that matches in full, else an empty text."""
    return F.coalesce(F.try_element_at(F.filter(attempts, lambda t: t.rlike(rf"\A(?:{pattern})\z")), F.lit(1)), F.lit(""))


def call_batches(rows: DataFrame, model: str, position: str) -> DataFrame:
    """One row for each model, with its rows' positions, in order of first appearance."""
    return rows.groupBy(model).agg(F.min(position).alias("first_seen"), F.count(F.lit(1)).alias("calls"))


def apply_where(df: DataFrame, condition: Column, change) -> DataFrame:
    """change(df) for rows where the condition holds; others pass by, so that costly functions never see them."""
    hit = F.coalesce(condition, F.lit(False))
    return change(df.where(hit)).unionByName(df.where(~hit), allowMissingColumns=True)


#: Named steps for field clean-up; data never carries code.
PASSES = {
    "trim": lambda c: F.trim(c),
    "upper": lambda c: F.upper(c),
    "lower": lambda c: F.lower(c),
    "digits": lambda c: F.regexp_replace(c, r"\D", ""),
    "letters": lambda c: F.regexp_replace(c, r"[^\p{L} ]", ""),
    "first_line": lambda c: F.regexp_extract(c, r"\A\s*([^\n]*)", 1),
    "collapse": lambda c: F.regexp_replace(c, r"(?U)\s+", " "),
}


def run_passes(c: Column, passes: list[str]) -> Column:
    for name in passes:
        c = PASSES[name](c)
    return c


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def answer_json(c: Column) -> Column:
    """The JSON text of an answer: of its fenced block or all of it, from the first brace on if it isn't JSON as a whole; {} if there is none. What follows a complete value is ignored."""

    def found(text: Column) -> Column:
        scalar = text.rlike(r"""\A(?:null|true|false|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|"(?:[^"\\]|\\.)*")\z""")
        part = F.when(scalar, text).otherwise(F.regexp_extract(text, r"(?s)([{\[].*)", 1))
        return let(part, lambda x: F.when(F.try_parse_json(F.when(x != "", x)).isNotNull(), x).otherwise("{}"))

    return let(F.regexp_replace(fenced(F.coalesce(c, F.lit(""))), r"(?U)\A\s+|\s+\z", ""), found)


def answer_value(parsed: Column) -> Column:
    """ok and text of an answer's JSON: null, or an object whose detected_text or only value is a scalar or null. Null words are empty."""

    def members(m: Column) -> Column:
        text, typed = m["text"], m["typed"]
        key = F.when(F.map_contains_key(text, "detected_text"), "detected_text").when(F.size(text) == 1, F.get(F.map_keys(text), F.lit(0)))
        return let(key, lambda k: F.struct(k.alias("key"), F.try_element_at(text, k).alias("text"), F.coalesce(F.schema_of_variant(F.try_element_at(typed, k)), F.lit("VOID")).alias("kind")))

    def value(x: Column) -> Column:
        text = norm_ws(F.when(x["kind"] == "BOOLEAN", F.initcap(x["text"])).when(x["kind"] != "VOID", x["text"]))
        text = let(text, lambda v: F.when(v.isNull() | F.lower(v).isin(*NULL_WORDS), "").otherwise(v))
        return F.struct(F.coalesce(x["key"].isNotNull() & ~x["kind"].rlike(r"\A(?:OBJECT|ARRAY)"), F.lit(False)).alias("ok"), text.alias("text"))

    maps = lambda x: F.struct(*[F.from_json(F.when(is_object(x), x), f"map<string,{t}>").alias(n) for n, t in (("text", "string"), ("typed", "variant"))])
    return let(parsed, lambda x: F.when(x == "null", F.struct(F.lit(True).alias("ok"), F.lit("").alias("text"))).otherwise(let(let(maps(x), members), value)))


TRIES = "array<struct<attempt:int,raw:string>>"
TRACE = "array<struct<pass:int,type:string,model:string,input:string,result:string,attempts:int,parsed_ok:boolean,rejection:string>>"


def attempt_result(value: Column, raw: Column, name: Column, text: Column, pattern: Column) -> Column:
    """value, ok and rejection of one answer: answers of another shape leave the value, answers that can't be true empty it."""

    def guarded(x: Column) -> Column:
        off = (pattern != "") & (x["text"] != "") & ~F.rlike(x["text"], F.concat(F.lit(r"\A(?:"), pattern, F.lit(r")\z")))
        reason = F.when(internal_uid(x["text"]), "internal_uid").when(echoes_number(x["text"], name, text), "numeric_roi_name_echo").when(off, "output_regex_mismatch")
        return let(reason, lambda r: F.struct(F.when(r.isNotNull(), "").otherwise(x["text"]).alias("value"), x["ok"].alias("ok"), r.alias("rejection")))

    return let(let(answer_value(answer_json(raw)), lambda g: F.struct(F.when(g["ok"], g["text"]).otherwise(value).alias("text"), g["ok"].alias("ok"))), guarded)


def postprocess(rows: DataFrame, responses: DataFrame, *, reruns: int = 3, fallback_model: str | None = None, supported: tuple[str, ...] = ()) -> DataFrame:
    """Adds result, pass_source and trace to rows (uid, name, text, meta): every row goes through its own list of passes, each from what the one before left.

    meta: a map of settings as `meta.passes` reads them. A code pass names one of PASSES; unknown names leave the text. A model pass takes the
    answers that responses (uid, pass, attempt, raw; both from 1) have for it, in order, until one has the shape asked for, reruns + 1 at most.
    A row's answers are as many as its passes and attempts, so they come as one array; the passes are a fold over it, all within the row.
    """
    given = responses.groupBy("uid", "pass").agg(F.array_sort(F.collect_list(F.struct(F.col("attempt").cast("int").alias("attempt"), "raw"))).alias("tries"))
    given = given.groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct(F.col("pass").cast("int").alias("pass"), "tries"))).alias("__given"))
    pattern = norm_ws(F.coalesce(meta_present(F.col("meta"), "output_regex", "ocr_output_regex"), F.lit("")))
    roi = F.coalesce(*[F.when(norm_ws(F.try_element_at("meta", F.lit(k))) != "", norm_ws(F.try_element_at("meta", F.lit(k)))) for k in ("roi_name", "name")], F.col("name"))
    wide = rows.join(given, "uid", "left").withColumns({"__text": norm_ws(F.coalesce("text", F.lit(""))), "__p": passes(F.col("meta")), "__pattern": pattern, "__roi": roi})
    models = F.array(*map(F.lit, supported)).cast("array<string>")
    none = F.lit(None).cast("string")

    def step(state: Column, p: Column) -> Column:
        value, n = state["value"], F.size(state["trace"]) + 1
        start = F.struct(value.alias("value"), F.lit(False).alias("ok"), none.alias("rejection"), F.lit(0).alias("attempts"))

        def tried(a: Column, r: Column) -> Column:
            more = lambda got: F.struct(got["value"].alias("value"), got["ok"].alias("ok"), got["rejection"].alias("rejection"), (a["attempts"] + 1).alias("attempts"))
            return F.when(a["ok"], a).otherwise(let(attempt_result(a["value"], r["raw"], F.col("__roi"), F.col("__text"), F.col("__pattern")), more))

        tries = F.slice(F.coalesce(F.try_element_at("__given", n), F.array().cast(TRIES)), 1, reruns + 1)
        coded = F.struct(F.coalesce(*[F.when(p["body"] == k, norm_ws(f(value))) for k, f in PASSES.items()], value).alias("value"), p["body"].isin(*PASSES).alias("ok"), none.alias("rejection"), F.lit(0).alias("attempts"))
        code = p["type"] == "code"
        model = F.when(~code, select_model(p["model"], F.lit(fallback_model).cast("string"), models)["selected"])
        made = F.when(code, coded).otherwise(F.aggregate(tries, start, tried))
        row = lambda x: F.struct(n.alias("pass"), p["type"].alias("type"), model.alias("model"), value.alias("input"), x["value"].alias("result"), x["attempts"].alias("attempts"), x["ok"].alias("parsed_ok"), x["rejection"].alias("rejection"))
        return let(let(made, row), lambda x: F.struct(x["result"].alias("value"), F.concat(state["trace"], F.array(x)).cast(TRACE).alias("trace")))

    first = F.struct(F.col("__text").alias("value"), F.array().cast(TRACE).alias("trace"))
    out = wide.withColumn("__end", F.aggregate(F.col("__p.passes"), first, step))
    return out.withColumns({"result": F.col("__end.value"), "pass_source": F.col("__p.source"), "trace": F.col("__end.trace")}).drop("__given", "__text", "__p", "__pattern", "__roi", "__end")


def retry_rounds(rows: DataFrame, attempts: DataFrame, steps: list[str], clear: bool = True) -> DataFrame:
    """Adds final, matched, cleared and used_step to rows (uid, text, pattern). attempts: uid, step, text.

    A text that fails its pattern is read again, step by step, until it matches; the last reading stands if none does, and
    is cleared if asked for. Texts without a pattern are final. A row has as many attempts as there are steps, so collecting them is bounded.
    """
    order = F.create_map(*[F.lit(x) for k, s in enumerate(steps) for x in (s, k)])
    place = F.try_element_at(order, F.col("step"))
    got = attempts.withColumn("place", place).where("place is not null").groupBy("uid", "place").agg(F.max(F.struct("step", "text")).alias("a"))
    tried = got.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("place", F.col("a.step").alias("step"), norm_ws(F.coalesce("a.text", F.lit(""))).alias("text")))).alias("__tries"))
    first = F.struct(F.lit(-1).alias("place"), F.lit("first").alias("step"), norm_ws(F.coalesce("text", F.lit(""))).alias("text"))
    out = rows.join(tried, "uid", "left").withColumn("__tries", F.concat(F.array(first), F.coalesce("__tries", F.array().cast("array<struct<place:int,step:string,text:string>>"))))
    fits = lambda t: F.rlike(t["text"], F.concat(F.lit(r"\A(?:"), F.col("pattern"), F.lit(r")\z")))
    free = F.coalesce(F.col("pattern"), F.lit("")) == ""
    hit = F.when(free, F.get("__tries", F.lit(0))).otherwise(F.try_element_at(F.filter("__tries", fits), F.lit(1)))
    last = F.try_element_at("__tries", F.lit(-1))
    out = out.withColumns({"__hit": hit, "__last": last})
    matched = F.col("__hit").isNotNull()
    cleared = F.lit(clear) & ~matched & (F.col("__last.text") != "")
    return out.withColumns({"matched": matched, "cleared": cleared, "used_step": F.coalesce("__hit.step", "__last.step"), "final": F.when(matched, F.col("__hit.text")).when(cleared, "").otherwise(F.col("__last.text"))}).drop("__tries", "__hit", "__last")


def retry_counts(done: DataFrame) -> DataFrame:
    """One row: texts with a pattern, first mismatches, those left, those cleared."""
    asked = F.coalesce(F.col("pattern"), F.lit("")) != ""
    return done.agg(F.count_if(asked).alias("rows_with_regex"), F.count_if(asked & (~F.col("matched") | (F.col("used_step") != "first"))).alias("initial_mismatches"), F.count_if(asked & ~F.col("matched")).alias("remaining"), F.count_if("cleared").alias("cleared"))
