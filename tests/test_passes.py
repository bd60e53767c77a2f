"""Passes of a row over its text, against a plain loop."""

import itertools
import json
import random
import re

from pyspark.sql import functions as F

from packetlane.operators import readings

ANSWERS = ['{"detected_text": "X"}', '{"date": " 05/01 "}', '{"a": 1, "b": 2}', "null", "None", "", "plain words", '```json\n{"k": null}\n```', '{"k": "N/A"}', '[{"k": 1}]', '{"k": {"x": 1}}', '{"k": 12.50}', '{"k": true} tail {', '"quoted"', "12 apples", "12", 'see {"k": "v"} there', '{"broken": ', '{"detected_text": "p1:r2:z", "o": 1}', '{"detected_text": "7"}', '{"detected_text": "abc"}']


def parsed(raw):
    s = (raw or "").strip()
    if m := re.search(r"```(?:json)?\s*([\s\S]*?)\s*```", s, re.I):
        s = m.group(1).strip()
    try:
        return json.loads(s)
    except ValueError:
        pass
    at = re.search(r"[{\[]", s)
    try:
        return json.JSONDecoder().raw_decode(s[at.start() :])[0] if at else {}
    except ValueError:
        return {}


def one(value, raw, name, text, pattern):
    p = parsed(raw)
    ok, got = p is None, ""
    if isinstance(p, dict) and ("detected_text" in p or len(p) == 1):
        v = p.get("detected_text", next(iter(p.values())))
        ok = not isinstance(v, (dict, list))
        got = "" if v is None else " ".join(str(v).split())
        got = "" if got.lower() in ("null", "none", "n/a", "na", "unknown", "unreadable") else got
    got = got if ok else value
    why = None
    if re.fullmatch(r"p\d+:r\d+:[^:\s]+", got):
        why = "internal_uid"
    elif got == name and re.fullmatch(r"\d{1,3}", got) and got not in re.findall(r"\d+", text):
        why = "numeric_roi_name_echo"
    elif pattern and got and not re.fullmatch(pattern, got):
        why = "output_regex_mismatch"
    return ("" if why else got), ok, why


def test_like_a_plain_loop(spark):
    r = random.Random(4)
    rows, responses, want = [], [], {}
    steps = {"upper": str.upper, "lower": str.lower, "digits": lambda s: re.sub(r"\D", "", s)}
    for uid in range(300):
        name, text = r.choice(["7", "age"]), r.choice(["read 7 here", "Some Text", "", "  12  b "])
        pattern = r.choice(["", "", "[a-zA-Z]+"])
        passes = [r.choice(["llm", "llm", *steps, "no such"]) for _ in range(r.randrange(4))]
        meta = {"postprocess_passes": json.dumps([{"type": "llm", "prompt": "p"} if p == "llm" else {"type": "code", "code": p} for p in passes])}
        if pattern:
            meta["output_regex"] = pattern
        rows.append((uid, name, text, meta))
        value, trace = " ".join(text.split()), []
        for n, p in enumerate(passes, 1):
            before = value
            if p != "llm":
                value = " ".join(steps[p](value).split()) if p in steps else value
                trace.append((n, "code", before, value, 0, p in steps, None))
                continue
            tries = r.choices(ANSWERS, k=r.randrange(6))
            responses += [(uid, n, k, a) for k, a in enumerate(tries, 1)]
            ok, why, used = False, None, 0
            for a in itertools.islice(tries, 3):
                value, ok, why = one(value, a, name, " ".join(text.split()), pattern)
                used += 1
                if ok:
                    break
            trace.append((n, "llm", before, value, used, ok, why))
        want[uid] = (value, trace)
    r.shuffle(responses)
    df = spark.createDataFrame(rows, "uid long, name string, text string, meta map<string,string>")
    got = readings.postprocess(df, spark.createDataFrame(responses, "uid long, pass int, attempt int, raw string"), reruns=2).collect()
    assert {x.uid: (x.result, [(t["pass"], t.type, t.input, t.result, t.attempts, t.parsed_ok, t.rejection) for t in x.trace]) for x in got} == want


def test_models_of_passes(spark):
    meta = {"postprocess_passes": json.dumps([{"prompt": "a", "model": "known"}, {"prompt": "b", "model": "other"}, "c"])}
    df = spark.createDataFrame([(1, "n", "t", meta)], "uid long, name string, text string, meta map<string,string>")
    none = spark.createDataFrame([], "uid long, pass int, attempt int, raw string")
    row = readings.postprocess(df, none, fallback_model="base", supported=("known", "base")).select("result", F.transform("trace", lambda t: t["model"]).alias("m")).first()
    assert (row.result, row.m) == ("t", ["known", "base", "base"])
