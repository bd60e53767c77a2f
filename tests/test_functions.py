from difflib import SequenceMatcher
from random import Random

import pytest
from oracle import same_rows
from pyspark.sql import functions as F

from packetlane.functions import fuzzy, jsonfix, scanner
from packetlane.functions import header as H
from packetlane.functions import labels as L
from packetlane.functions import text as X
from packetlane.operators import fusion
from packetlane.plans import catalog


def one(spark, column, *values):
    """The column's value over one row with a, b, ... as strings."""
    names = "abcdef"[: len(values)]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(column.alias("v")).first()["v"]


SCALARS = [
    (lambda A: X.norm_ws(A), " a \t b\n", "a b"),
    (lambda A: X.norm_ws(A), None, None),
    (lambda A: X.compact_alnum(A), "Ab-9 é!", "ab9"),
    (lambda A: X.strip_markup(A), "`x` JSON y", "x y"),
    (lambda A: X.has_evidence(A), "N/A", False),
    (lambda A: X.has_evidence(A), None, False),
    (lambda A: X.valid_id(A), "1234567A", True),
    (lambda A: X.valid_id(A), "1234567A\n", False),
    # ids and headers as they are read; results are fixed values
    (lambda A: H.normalize_id(A), "l234S67 a", "1234567A"),
    (lambda A: H.normalize_id(A), " 80l1576a", "8011576A"),
    (lambda A: H.normalize_id(A), "12345678", "12345678"),
    (lambda A: H.normalize_id(A), "call 5551234 4 times", "CA1155512344T1ME"),
    (lambda A: H.normalize_id(A), "id: 123 4567B.", "1234567B"),
    (lambda A: H.normalize_id(A), " \t ", None),
    (lambda A: H.normalize_id(A), None, None),
    (lambda A: H.normalize_header(A), "６th  grade，pre－assess", "6TH GRADE PRE-ASSESS"),
    (lambda A: H.detect_grade(H.normalize_header(A)), "8 items pre", None),
    (lambda A: H.detect_grade(H.normalize_header(A)), "PREFERRED 8TH", "8"),
    (lambda A: H.detect_grade(H.normalize_header(A)), "6 T H GRADE", "6"),
    (lambda A: H.detect_grade(H.normalize_header(A)), "school of the High 8th grade", "h"),
    (lambda A: H.detect_grade(H.normalize_header(A)), "HIGH fever post", None),
    (lambda A: H.detect_phase(H.normalize_header(A)), "PREFERRED 8TH", None),
    (lambda A: H.detect_phase(H.normalize_header(A)), "pre - assessment then post-assessment", "pre"),
    (lambda A: H.detect_phase(H.normalize_header(A)), "POSTER with a pre", "post"),
    (lambda A: H.detect_phase(H.normalize_header(A)), "x" * 400 + " post", None),
    (lambda A: H.infer_form_type(A), "8th Grade Post-Assessment", "8post"),
    (lambda A: H.infer_form_type(A), "7 TH GRADE PRE-ASSESSMENT", "7pre"),
    (lambda A: H.infer_form_type(A), None, None),
    (lambda A: H.coerce_batch(A), '{"results": [{"id": "1"}, 5]}', ['{"id":"1"}']),
    (lambda A: H.coerce_batch(A), '{"id": "1", "form_type": null}', ['{"id": "1", "form_type": null}']),
    (lambda A: H.coerce_batch(A), '[{"results": [{"id": "1"}, {"id": "2"}]}, {"results": []}, {"id": "3"}]', ['{"id":"1"}', '{"id":"2"}', "{}", '{"id":"3"}']),
    (lambda A: H.coerce_batch(A), '[1, {"id": "2"}]', None),
    (lambda A: H.coerce_batch(A), "no json", None),
    (lambda A: H.header_fields(A, F.lit("x 1234567B y")), '{"stages": [{"parsed": {"id": "l"}}, {"parsed": {"id": "8011576A", "form_type": "6pre"}}], "detected_text": "7th grade post-assessment"}', ("8011576A", "7post")),
    (lambda A: H.header_fields(A, F.lit("x 1234567B y")), '{"form_type": "6pre"}', ("1234567B", "6pre")),
    (lambda A: X.parse_number(A), "45.50", "45.5"),
    (lambda A: X.parse_number(A), "1_000", "1000"),
    (lambda A: X.preview_number(A), "5.0", "5"),
    (lambda A: X.normalize_cell(A), "5.0", "5.0"),
    (lambda A: X.normalize_cell(A), None, ""),
    (lambda A: X.normalize_cell(A), "true", "true"),
    (lambda A: X.date_signatures(A), "on 4/5/26, 04-05-2026 and 1/2/2020", ["4/5/2026", "1/2/2020"]),
    (lambda A: X.date_signatures(A), "13/45/2026 1.2.2020 11/2/20201", []),
    (lambda A: X.dedupe_halves(A), "a b a b", "a b"),
    (lambda A: X.dedupe_halves(A), "a b c", "a b c"),
    (lambda A: fusion.clean_candidate(A), "Output: yes OCR B: yes", "yes"),
    (lambda A: X.id_after_colon(A), "Record: 12AB x", "12AB"),
    (lambda A: X.id_fixed_length(A), "12 3", "123?????"),
    (lambda A: X.column_number(A), "AB", 28),
    (lambda A: X.sanitize_stem(A), "a b/c.", "a_b_c"),
    (lambda A: X.acronym(A), "alpha beta 7", "AB7"),
    (lambda A: X.strip_control(A), "a\x00b\tc", "ab\tc"),
    (lambda A: X.low_signal(A), "b", True),
    (lambda A: X.low_signal(A), "mrs", True),
    (lambda A: X.low_signal(A), "Mrs", False),
    (lambda A: X.low_signal(A), "ab 1", False),
    (lambda A: X.structured_id(A), "12-34b", True),
    (lambda A: X.structured_id(A), "Brand#12", False),
    (lambda A: X.structured_id(A), "a12b", True),
    (lambda A: X.structured_id(A), "", True),
    (lambda A: X.structured_id(A), "Riverside", False),
    (lambda A: X.strip_question_header(A), "3. I walked to school. It was cold.", "3. I walked to school. It was cold"),
    (lambda A: X.strip_question_header(A), "21. What, if anything, could have made this experience better for you? More time.", "21. What, if anything, could have made this experience better for you? More time"),
    (lambda A: X.strip_question_header(A), "- 21. what if anything could have made this experience better for you? " * 6 + "if it never existed", "if it never existed"),
    (lambda A: X.strip_question_header(A), "Optional question: vvhat, could have made this better?", ""),
    (lambda A: L.canonical_label(A), "Mrs. Smith Name of  Teacher:", "Name of Teacher: Mrs. Smith"),
    (lambda A: L.canonical_label(A), "`json` recordID :12", "Record ID: 12"),
    (lambda A: L.canonical_label(A), "Date: 9/27/16 today", "Today's Date: 9/27/16"),
    (lambda A: L.split_prompt(A), "27. What is your age? 12", ("27. What is your age?", "12")),
    (lambda A: L.split_prompt(A), "Short one. tail", ("", "Short one. tail")),
    (lambda A: L.prompt_kind(A), "Record ID: 5", "id"),
    (lambda A: L.prompt_kind(A), "Why?", "question"),
    (lambda A: L.prompt_kind(A), "", ""),
    (lambda A: X.digit_groups(A), "a12b345", ["12", "345"]),
    (lambda A: X.categorical_type(A), "Strongly Agree", "likert"),
    (lambda A: X.score_label(A.cast("double")), "0.5", "medium"),
    (lambda A: jsonfix.scalar_text(A), '{"Todays Date":"05/01/2026"}', "05/01/2026"),
    (lambda A: jsonfix.scalar_text(A), 'before ```json\n{"Todays Date":"05/01/2026"}\n``` after', "05/01/2026"),
    (lambda A: jsonfix.scalar_text(A), '```json\n{"Record ID: "8011576A"}\n```', "8011576A"),
    (lambda A: jsonfix.scalar_text(A), '{"Record ID" "8011576A"}', "8011576A"),
    (lambda A: jsonfix.scalar_text(A), '{"Record ID":8011576A}', "8011576A"),
    (lambda A: jsonfix.scalar_text(A), "Record ID: 8011576A", "8011576A"),
    (lambda A: jsonfix.scalar_text(A), "```\n{'Record ID': '8011576A'}\n```", "8011576A"),
    (lambda A: jsonfix.scalar_text(A), '```json\n{"Record ID":""}\n```', ""),
    (lambda A: jsonfix.conforming(A), '{"a": 1}', True),
    (lambda A: jsonfix.conforming(A), '{"a": [1]}', False),
    (lambda A: jsonfix.json_blocks(A), 'x {"a": "}"} {b} {', ['{"a": "}"}', "{b}"]),
]


def test_scalars(spark):
    """All in one query: a column for each."""
    row = spark.createDataFrame([tuple(v for _, v, _ in SCALARS)], ", ".join(f"a{k} string" for k in range(len(SCALARS))))
    for first in range(0, len(SCALARS), 25):
        part = range(first, min(first + 25, len(SCALARS)))
        got = row.select(*[SCALARS[k][0](F.col(f"a{k}")).alias(f"v{k}") for k in part]).first()
        assert [(k, SCALARS[k][1], v) for k, v in zip(part, got, strict=True)] == [(k, SCALARS[k][1], SCALARS[k][2]) for k in part]


def test_pairs(spark):
    A, B = F.col("a"), F.col("b")
    assert one(spark, X.digits_preserved(A, B), "a1 b23", "12-3") is True
    assert one(spark, X.words_subset(A, B), "big Cat", "a cat is BIG") is True
    assert one(spark, X.pages_string(A.cast("int"), B.cast("int")), "5", "6") == "5-6"
    assert one(spark, X.placeholder(A, B), "Name of custom_field", "custom_field") is True
    assert one(spark, fuzzy.similarity_ratio(A, B), "valu one", "value one") == SequenceMatcher(None, "valu one", "value one").ratio()
    assert one(spark, X.heat_color(A.cast("double")), "0") == "FFF4B6B6"
    assert one(spark, X.heat_color(A.cast("double")), "1") == "FFFFFFFF"
    assert one(spark, X.format_confidence(A, B.cast("double")), "high", "0.98765") == "high (0.988)"
    assert one(spark, X.coerce_score(A, B, F.lit("low")), "2", None) == 1.0
    assert one(spark, X.coerce_score(A, B, F.lit("low")), "x", None) == 0.25


@pytest.mark.parametrize("n", [1, 26, 27, 52, 702])
def test_column_letters(spark, n):
    assert one(spark, X.column_number(X.column_letters(F.col("a").cast("int"))), str(n)) == n


# Readings and what they become.
FUSED = [
    ("ure+hra", "urethra", "urethra"),
    ("furskin", "foreskin", "foreskin"),
    ("Fertilization", "Fertilzath", "Fertilization"),
    ("Labiae", "Labia", "Labia"),
    ("12345674", "1234567A", "12345674 1234567A"),
    ("CWRV1X", "cmVix", "cmVix"),
    ("", "uterus", "uterus"),
    ("Name of Teacher: Mrs.Riedlinger", "Mrs.Riedlinger Name of Teacher:", "Name of Teacher: Mrs.Riedlinger"),
    ("Today's Date: 9/27/2016", "023126 Today's Date:", "Today's Date: 9/27/2016"),
    ("b", "27. What is your age?", "27. What is your age?"),
]


def test_fusion(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(FUSED)], "i int, a string, b string")
    assert [r.fused for r in fusion.fuse(df, "a", "b").orderBy("i").collect()] == [want for _, _, want in FUSED]


def test_fusion_of_own_pairs(spark):
    """(page, line, fused, reason): pairs of our own, worked out by hand."""
    pairs = [
        (None, " ", "", "single_source"),
        ("N/A", "Riverside", "Riverside", "single_source"),
        ("x", "Riverside", "Riverside", "low_signal_source"),
        ("Record ID: 1234567", "Record ID: 12", "Record ID: 1234567", "structured_prompt_tail"),
        ("27. What is your age? 12", "27. What is your age?", "27. What is your age?", "structured_prompt_tail"),
        ("27. What is your age? 12", "27. What is your age? b", "27. What is your age? 12", "structured_prompt_tail"),
        ("Room 7B", "Room 7B", "Room 7B", "near_duplicate"),
        ("ab12c", "ab12e", "ab12e", "ambiguous_single_token"),
        ("Riverside School", "Riverside Schol", "Riverside School", "near_duplicate"),
        ("green apples", "seven trains", "green apples seven trains", None),
        ("went on 1/2/2020", "with mother", "went on 1/2/2020 with mother", None),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _, _) in enumerate(pairs)], "i int, a string, b string")
    got = fusion.fuse(df, "a", "b").orderBy("i").collect()
    assert [(r.fused, r.reason) for r in got] == [(c, d) for _, _, c, d in pairs]
    asked = fusion.fuse(df, "a", "b").withColumn("c", F.when(F.col("i") == 9, "Output: seven trains green apples").otherwise("lost"))
    got = {r.i: (r.fused, r.candidate_kept) for r in fusion.accept_candidates(asked, "c", "a", "b").collect()}
    assert got[9] == ("seven trains green apples", True) and got[10] == ("went on 1/2/2020 with mother", False) and got[2][1] is False


def test_preserves_source(spark):
    cases = [("a b 12", "", True), ("the big red house", "Red House", True), ("seen 1/2/20 by me", "by me 01-02-2020", True), ("room 12", "room 13", False), ("Riverside School", "Riversde School", True), ("x", "completely other", False)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    a, b = L.Reading(F.col("a")), L.Reading(F.col("b"))
    got = df.select("i", L.preserves_source(a, b, fusion.ratio_of(a.compact, b.compact)).alias("v")).orderBy("i").collect()
    assert [r.v for r in got] == [want for *_, want in cases]


def test_stream_stop():
    stop = lambda t: scanner.StreamScanner().feed(t)
    assert stop('```json\n{"a": 1}')["mode"] == "json_object"
    assert stop('{"a": 1}{"a":1}{"a": 1}')["end"] == 8
    text = "start " + "and once again the same words " * 3
    assert (stop(text)["mode"], text[: stop(text)["end"]]) == ("repeated_tail", "start and once again the same words")
    assert stop("nothing yet") is stop("short " * 9) is None


@pytest.mark.parametrize(("text", "want"), [
    ("45036020_0000_0000.50", "4503602000000000.5"), ("+010000000000000000.5", "10000000000000000.5"), ("-.12345678901234567890", "-0.1234567890123456789"), ("9007199254740993.0", "9007199254740993.0"), ("9.99999999999999999999", "9.99999999999999999999"),
    ("1" + "0" * 320 + ".", "1" + "0" * 320 + ".0"), ("0." + "0" * 330 + "10", "0." + "0" * 330 + "1"),
    ("10000000000000000.0", "1e+16"), ("9007199254740992.", "9007199254740992.0"), ("0.00001", "1e-05"), ("-0.0", "-0.0"), ("000.10", "0.1"), (".5", "0.5"), ("12345678901234567890.5e-10", "1234567890.1234567"),
])
def test_numbers_beyond_doubles_keep_their_digits(spark, text, want):
    assert one(spark, X.parse_number(F.col("a")), text) == want


def test_decimals_as_floats(spark):
    """Up to 15 digits a double tells all numbers apart, so their text is that of a Python float."""
    rng = Random(7)
    texts = [f"{rng.choice(['', '-', '+', '00'])}{rng.randrange(10 ** rng.randrange(1, 8))}.{rng.randrange(10 ** rng.randrange(1, 8)):0{rng.randrange(1, 8)}d}" for _ in range(500)]
    got = spark.createDataFrame([(x,) for x in texts], "a string").select("a", X.parse_number(F.col("a")).alias("n")).collect()
    assert {r["a"]: r["n"] for r in got} == {x: repr(float(x)) for x in texts}


def test_typed_cells_as_its_sql(spark, tmp_path):
    """Keys from 4503600 on, whose numbers have more digits than a double."""
    rows = [(k, k // 10, "O", 100.5, "1-URGENT") for k in (4503598, *range(4503600, 4503612), 8999996, 8999999, 10000010)]
    columns = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string"
    spark.createDataFrame([(k, min(c, 999999), *r) for k, c, *r in rows], columns).coalesce(1).toPandas().to_parquet(tmp_path / "orders.parquet")
    same_rows(catalog.QUERIES["typed_cells"](spark, str(tmp_path)), catalog.SQL["typed_cells"], tmp_path)
