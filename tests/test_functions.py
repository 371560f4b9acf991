"""Scalar functions and extraction against hand-computed values."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessellex.functions import extract as ex
from tessellex.functions import regexes as rx
from tessellex.functions import text as tx


def value(spark, column, **row):
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))
    return df.select(column.alias("v")).first()["v"]


def test_stem(spark):
    cases = dict(
        ties="ty", penalties="penalty", classes="class", visas="visa", being="being",
        entering="enter", entered="enter", act="act",
    )
    cases["class"] = "class"
    df = spark.createDataFrame(list(cases), "string").toDF("w")
    rows = df.select("w", tx.stem(F.col("w")).alias("s"), tx.has_stem(F.col("w")).alias("h")).collect()
    assert {r.w: r.s for r in rows} == cases
    assert all(r.h == (r.s != r.w) for r in rows)


def test_tokens_and_jaccard(spark):
    assert value(spark, tx.search_tokens(F.col("t")), t="The Acts a") == ["the", "acts", "act"]
    assert value(spark, tx.search_tokens(F.col("t")), t=" ! ") == []
    sim = tx.jaccard(tx.token_set(F.col("a")), tx.token_set(F.col("b")))
    assert value(spark, sim, a="a b c", b="B c d") == 0.5
    assert value(spark, sim, a="", b="x") == 0.0


@pytest.mark.parametrize("raw, expected", [("Section 12A", "12A"), ("E5", "5"), ("  ", None), ("3(1)(a)", "3(1)(A)")])
def test_section_normaliser(spark, raw, expected):
    assert value(spark, tx.normalise_section(F.col("t")), t=raw) == expected


def test_highlight_marks_whole_words_once(spark):
    out = value(spark, tx.highlight(F.col("t"), F.col("q")), t="Mark the marks, MARK!", q="mark mark an")
    assert out.count("<mark") == 2 and ">MARK</mark>" in out and "marks" in out
    assert value(spark, tx.highlight(F.col("t"), F.col("q")), t="abc", q="ab") == "abc"


def test_small_text_functions(spark):
    assert value(spark, tx.snippet(F.col("t"), 3), t=" abcd") == "ab..."
    assert value(spark, tx.title_from_stem(F.col("t")), t="/x/the_act_12a.v2.pdf") == "The Act 12A.V2"
    assert value(spark, tx.word_count(F.col("t")), t=" one two\tthree\nfour  five ") == 5
    assert value(spark, tx.section_label(F.lit(None), F.lit(None), F.lit(None), F.lit(None)), t="") == "Unknown Section"
    assert value(spark, tx.penalty_summary(F.lit(3.0), F.lit(10000.0), F.lit("")), t="") == (
        "imprisonment up to 3.0 year(s) and/or fine up to ₹10,000"
    )
    assert value(spark, tx.is_devanagari_page(F.col("t")), t="ab नागरिकता") is True
    assert value(spark, tx.is_devanagari_page(F.col("t")), t="") is False


def test_find_spans_are_regex_positions(spark):
    import re

    text = "x1 22\nabc 333 é4"
    got = value(spark, rx.find_spans(F.col("t"), r"\d+"), t=text)
    assert [(s["start"], s["match"]) for s in got] == [(m.start(), m.group()) for m in re.finditer(r"\d+", text)]


PENALTIES = [
    ("shall be punishable with imprisonment up to 3 years and fine of Rs. 10,000", ("both", 3.0, 10000.0)),
    ("liable to imprisonment of 6 months", ("imprisonment", 0.5, None)),
    ("liable to a fine of five thousand rupees", ("fine", None, None)),
    ("liable to be deported", ("deportation", None, None)),
    ("liable to have it cancelled", ("cancellation", None, None)),
    ("liable to nothing in particular", ("unknown", None, None)),
]


@pytest.mark.parametrize("text, expected", PENALTIES)
def test_penalty_precedence(spark, text, expected):
    p = value(spark, ex.penalty(F.col("t")), t=text)
    assert (p.penalty_type, p.imprisonment_years, p.fine_amount) == expected


def test_no_penalty(spark):
    assert value(spark, ex.penalty(F.col("t")), t="nothing here") is None


def test_section_metadata(spark):
    text = (
        "The Passports Act, 1967\nAct No. 15 of 1967\nCHAPTER II - OFFENCES\n12A. Offences and penalties.— "
        "(1) Whoever contravenes section 5 of this Act, or section 5, shall be punishable with fine.\n"
        "The central government or the Central Government may act under section 3 of the Foreigners Act, 1946 "
        "and the First Schedule."
    )
    m = value(spark, ex.section_metadata(F.col("t")), t=text)
    assert (m.act_name, m.act_year, m.chapter_number, m.section_number) == ("Passports Act", 1967, "II", "12A")
    assert m.section_title == "Offences and penalties"
    assert [a.name for a in m.authorities] == ["central government"]
    assert m.related_sections == ["5", "3"]
    assert [c.ref_text for c in m.cross_references] == ["section 3 of the Foreigners Act, 1946", "First Schedule"]
    assert "fine" in m.keywords and "passport" not in m.keywords
    assert value(spark, ex.act_number(F.col("t")), t=text) == "Act No. 15 of 1967"


def test_context_hint_serves_act_and_chapter_only(spark):
    m = value(spark, ex.section_metadata(F.col("t"), context_hint=F.lit("The Visa Act, 1950")), t="plain text")
    assert (m.act_name, m.act_year, m.section_number, m.keywords) == ("Visa Act", 1950, None, [])


def test_year_before_1947_is_null(spark):
    m = value(spark, ex.act_name_year(F.col("t")), t="The Foreigners Act, 1946")
    assert (m.act_name, m.act_year) == ("Foreigners Act", None)


def test_definition_first_term_wins(spark):
    text = '"Visa" means a stamp in a travel document;\n(a) "visa" means another thing entirely; (b) "alien" means a foreign person;'
    got = value(spark, ex.definitions(F.col("t")), t=text)
    assert [(d.term, d.section_ref) for d in got] == [("Visa", None), ("alien", "b")]


def test_domain_and_type(spark):
    assert value(spark, ex.domain(F.lit(None), F.col("t")), t="the secretary") == "emigration"
    assert value(spark, ex.domain(F.lit(None), F.col("t")), t="nothing") == "unknown"
    assert value(spark, ex.document_type(F.lit("X Rules"), F.col("t")), t="contract") == "rule"
    assert value(spark, ex.document_type(F.lit(None), F.col("t")), t="contract") == "act"


def test_spans_of_texts_with_marks_and_of_many_matches(spark):
    texts = ["\x1ea1\x1f b22 \x1e\x1f c333", "none", "", "".join(f"n{i}\x1e " for i in range(500)), "".join(f"n{i} " for i in range(64)), "n1" * 65]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    rows = df.select("id", rx.find_spans(F.col("text"), "[a-z][0-9]+").alias("s")).collect()
    for r in rows:
        assert [(x["start"], x["match"]) for x in r["s"]] == [(m.start(), m.group()) for m in re.finditer("[a-z][0-9]+", texts[r["id"]])]


def test_keywords_in_one_pass_equal_a_search_for_each_phrase(spark):
    rng = random.Random(8)
    joints = [" ", " ", "-", "", "\n", ", ", "s ", "É", "_", "  "]
    words = list(ex.KEYWORDS) + [w for k in ex.KEYWORDS for w in k.split()] + ["of", "X"]
    texts = ["".join(rng.choice((str.lower, str.title, str.upper))(rng.choice(words)) + rng.choice(joints) for _ in range(rng.randrange(12))) for _ in range(600)]
    texts += ["", "e-visa extension", "visa on arrival cards", "citizenship-certificate", "Registration of Citizenship certificate"]
    got = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string").select("text", ex.keywords(F.col("text")).alias("k")).collect()
    for r in got:
        expected = [k for k in ex.KEYWORDS if re.search(rf"\b{re.escape(k)}\b", r["text"].lower())] if r["text"] else []
        assert r["k"] == expected, r["text"]
    assert any(len(r["k"]) > 3 for r in got)
