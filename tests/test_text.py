"""Golden micro-cases for the extraction rules (email, phone, years, skills, clean text)."""

import pytest
from pyspark.sql import functions as F

from shortlist.functions import text as tx

EXTRACTION_CASES = [
    ("Mail JOHN.Doe+x@Sub.Example.COM or b@c.io", "john.doe+x@sub.example.com", "", 0),
    ("no contact here", "", "", 0),
    ("a@b.c", "", "", 0),
    ("(415) 555-1234", "", "4155551234", 0),
    ("+1 (415) 555-0007\n5 years", "", "+141555500075", 0),
    ("2019 - 2023", "", "20192023", 0),
    ("12345 678", "", "12345678", 0),
    ("1234567 8901234567 and 415-555-1234", "", "", 0),
    ("tel 415.555.1234", "", "", 0),
    ("5+ years", "", "", 5),
    ("10 years of experience", "", "", 10),
    ("Experience: 7 yrs", "", "", 7),
    ("3 Years Experience and 8+ yrs", "", "", 8),
    ("20 years old", "", "", 0),
    ("5 YEARS   of\nexperience", "", "", 5),
    ("experience 4+years", "", "", 4),
    ("99999999999 years experience", "", "99999999999", 99999999999),
    ("99999999999999999999 years experience, 3+ yrs", "", "", 2 ** 63 - 1),
]


def _one(spark, text, col):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(col("t").alias("v")).first()["v"]


@pytest.mark.parametrize("text,email,phone,years", EXTRACTION_CASES)
def test_extraction_golden(spark, text, email, phone, years):
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(tx.extract_email("t").alias("e"), tx.extract_phone("t").alias("p"),
                    tx.extract_experience("t").alias("y")).first()
    assert row["e"] == email
    assert row["p"] == phone
    assert row["y"] == years


CLEAN_CASES = [
    ("  a\t\tb\xa0\xa0c  ", "a b c"),
    ("caf\xe9 – x", "caf    x"),
    ("\xe9\xe9abc", "abc"),
    ("x\x1c\x1dy", "x y"),
]


@pytest.mark.parametrize("text,expected", CLEAN_CASES)
def test_clean_text_golden(spark, text, expected):
    assert _one(spark, text, tx.clean_text) == expected


def test_min_length_gate_counts_unicode_whitespace(spark):
    body = "x" * 49
    rows = [(body,), (" " * 10 + body + "　\x1c",), (body + "y",), ("",), (None,), ("\xa0" * 80,)]
    df = spark.createDataFrame(rows, "t string")
    got = [r[0] for r in df.select(tx.long_enough("t")).collect()]
    assert got == [False, False, True, False, False, False]


def test_skills_are_substrings_sorted_by_code_point(spark):
    text = "Expert in JavaScript, digital Excellent NoSQL and C++ and c# and ci/cd"
    got = _one(spark, text, lambda c: tx.skills_list(tx.extract_skills(c)))
    # Substring semantics: javascript also gives java, digital gives git, nosql gives sql.
    assert got == "c#, c++, ci/cd, excel, git, java, javascript, nosql, sql"


def test_skills_read_raw_text_line_breaks_block_phrases(spark):
    got = _one(spark, "machine\nlearning and machine learning", lambda c: tx.skills_list(tx.extract_skills(c)))
    assert got == "machine learning"
    got = _one(spark, "machine\nlearning", lambda c: tx.skills_list(tx.extract_skills(c)))
    assert got == ""


def test_resume_id_never_truncates(spark):
    df = spark.createDataFrame([(1,), (42,), (12345,)], "i int")
    assert [r[0] for r in df.select(tx.resume_id("i")).collect()] == ["R0001", "R0042", "R12345"]


def test_entry_selection(spark):
    names = ["a/one.pdf", "__MACOSX/x.pdf", "sub/__MACOSX/y.pdf", "two.PDF", "n.txt", "dir.pdf/"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    kept = [r[0] for r in df.where(tx.entry_selected("n")).collect()]
    assert kept == ["a/one.pdf", "sub/__MACOSX/y.pdf", "two.PDF"]


def test_split_skill_list_drops_blanks(spark):
    df = spark.createDataFrame([("",), ("Python, , SQL ",)], "s string")
    got = [r[0] for r in df.select(tx.split_skill_list("s")).collect()]
    assert got == [[], ["python", "sql"]]


def test_parse_skill_input_column(spark):
    df = spark.createDataFrame([(["!python", " sql ", "! go"],)], "s array<string>")
    req, mand = tx.parse_skill_input("s")
    row = df.select(req.alias("r"), mand.alias("m")).first()
    assert row["r"] == ["python", "sql", "go"]
    assert row["m"] == ["python", "go"]


def test_extraction_plan_has_no_python(spark):
    from shortlist.operators.extract import extract_fields
    df = spark.createDataFrame([("x" * 60,)], "raw_text string")
    plan = extract_fields(df)._jdf.queryExecution().executedPlan().toString()
    for node in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "PythonUDF"):
        assert node not in plan


TUNED_TRAPS = [
    "foo.bar@x.com", "a.b-c@d.org and e@f.gh", "x@@y.com", "...@a.bc", "abc@d.ef@g.hi",
    "mail:a@b.cd;b@c.de", "é@x.com ü.v@w.xyz", "a\xa0\xa0b　 c\x1c \x85d", "   \t\r\n",
    "caf\xe9 – x​﻿y", "",
    "emoji \U0001F600\U0001F600 x\ty \x00\x7f\x1b end", "漢字 テキスト\u3000 done",
]


def test_tuned_patterns_match_the_rule_patterns(spark):
    """The Java-tuned spellings extract exactly what the rule patterns do."""
    from paths import SF001
    from shortlist.plans import fixtures as fx
    traps = spark.createDataFrame([(i, t) for i, t in enumerate(TUNED_TRAPS)], "doc_id long, raw_text string")
    docs = fx.resumes_raw(spark, SF001).select("doc_id", "raw_text").unionByName(traps)
    rule_clean = F.trim(F.regexp_replace(F.regexp_replace("raw_text", f"[{tx.WS}]+", " "),
                                         r"[^\x20-\x7E]", " "))
    rule_email = F.lower(F.regexp_extract("raw_text", tx.EMAIL_PATTERN, 0))
    bad = docs.where(~rule_clean.eqNullSafe(tx.clean_text("raw_text"))
                     | ~rule_email.eqNullSafe(tx.extract_email("raw_text")))
    assert bad.count() == 0


def test_skills_codegen_forms_match_the_filter_form(spark):
    from paths import SF001
    from shortlist.plans import fixtures as fx
    docs = fx.resumes_raw(spark, SF001)
    entries = tx.sorted_vocab()
    by_filter = F.filter(F.array(*[F.lit(s) for s in entries]), lambda s: F.contains(F.lower("raw_text"), s))
    bad = docs.where(~by_filter.eqNullSafe(tx.extract_skills("raw_text"))
                     | ~tx.skills_list(by_filter).eqNullSafe(tx.skills_joined("raw_text")))
    assert bad.count() == 0


@pytest.mark.parametrize("vocab,expected", [
    (("", "go"), ["", "go"]),            # an empty entry is in every text
    (("", "zz"), [""]),
    (("a\x00b", "go"), ["go"]),          # contains the join character: filter form
    (("zz",), []),
    ((), []),
])
def test_skills_vocabulary_edge_cases(spark, vocab, expected):
    assert _one(spark, "Go north", lambda c: tx.extract_skills(c, vocab)) == expected


def test_skills_stay_in_codegen(spark):
    """No higher-order function (interpreted, per-entry re-lowering) in the extraction."""
    from shortlist.operators.extract import extract_fields
    df = spark.createDataFrame([("x" * 60,)], "raw_text string")
    plan = extract_fields(df)._jdf.queryExecution().executedPlan().toString()
    assert "lambdafunction" not in plan


def test_scan_patterns_equal_the_plain_ones(spark):
    texts = ["a b@c.de", "x@y z@q.com", "@ @a.bc", "é@x.de", "no at", "", "a@@b.co", "+1 (2) 345 678", "++12345678901", "1-----------2", "  a  b\t c\u2003\u2003d ",
             " ", "a \t", "12345678901234567 years experience 3+ yrs", "9" * 30 + " years experience", "999999999999999 yrs of experience 1000000000000000+ years",
             "x" * 50 + "@" + "y" * 50 + ".com tail@z.org"]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    got = df.select("t", tx.extract_email("t").alias("e"), tx.extract_phone("t").alias("p"), tx.extract_experience("t").alias("y"),
                    F.lower(F.regexp_extract("t", tx.EMAIL_PATTERN, 0)).alias("e0"), F.regexp_extract("t", tx.PHONE_PATTERN, 1).alias("p0"),
                    F.regexp_extract("t", tx.PHONE_SCAN_PATTERN, 1).alias("p1"), F.regexp_replace("t", f"[{tx.WS}]+", " ").alias("w0"),
                    F.regexp_replace("t", tx.WS_RUN_PATTERN, " ").alias("w1")).collect()
    assert all(r.e == r.e0 and r.p0 == r.p1 and r.w0 == r.w1 for r in got)
    years = {r.t: r.y for r in got}
    assert years[texts[13]] == 12345678901234567 and years[texts[14]] == 2 ** 63 - 1 and years[texts[15]] == 10 ** 15 and years[""] == years[None] == 0
    plan = df.select(tx.extract_email("t"))._jdf.queryExecution().executedPlan().toString()
    assert "substring_index" in plan
