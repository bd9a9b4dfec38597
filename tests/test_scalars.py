import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import scalars as s
from ledgerlens.functions.jaro import jaro, jaro_distance

D = dt.date


def ask(spark, values, kind, f):
    """f of a column with these values, in order."""
    df = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], f"i int, {kind}")
    cols = [F.col(c) for c in df.columns[1:]]
    return [r.r for r in df.select("i", f(*cols).alias("r")).orderBy("i").collect()]


def test_dates(spark):
    got = ask(spark, ["January 5, 2025", "01/05/2025", "2025-01-05", "3/1/2025", "2025-06-30T00:00:00", None, "", "soon", "13/13/2025"], "x string", s.parse_date)
    assert got == [D(2025, 1, 5), D(2025, 1, 5), D(2025, 1, 5), D(2025, 3, 1), D(2025, 6, 30), None, None, None, None]


def test_amounts(spark):
    assert ask(spark, ["$44,434,393 ", "$1,200", '"$5,000"', "-$500", "$0.00", "", None, "N/A", "TBD"], "x string", s.parse_amount) == [44434393, 1200, 5000, -500, 0, None, None, None, None]
    assert ask(spark, ["1.5", "null", None, "x"], "x string", s.to_number) == [1.5, None, None, None]


def test_ratios_and_membership(spark):
    assert ask(spark, [(250.0, 1000.0), (1.0, 0.0), (1.0, None), (None, 2.0), (1.0, -1.0)], "a double, b double", s.safe_ratio) == [0.25, None, None, None, None]
    assert ask(spark, ["a", "b", None], "x string", lambda x: s.member(x, ["a"])) == [True, False, False]


@pytest.mark.parametrize(("raw", "plain"), [
    ("ARIZONA STATE UNIVERSITY-TEMPE CAMPUS", "ARIZONA STATE UNIVERSITY"), ("CARNEGIE-MELLON UNIVERSITY", "CARNEGIE MELLON UNIVERSITY"), ("THE BROAD INSTITUTE, INC.", "BROAD INSTITUTE"),
    ("BOSTON UNIVERSITY (CHARLES RIVER CAMPUS)", "BOSTON UNIVERSITY"), ("AUBURN UNIVERSITY AT AUBURN", "AUBURN UNIVERSITY"), ("University of  New Mexico", "UNIVERSITY OF NEW MEXI")])
def test_organisations(spark, raw, plain):
    assert ask(spark, [raw, None], "x string", s.normalise_org) == [plain, None]


def test_tokens(spark):
    pairs = [("HARVARD UNIVERSITY", "HARVARD"), ("UNIVERSITY OF CHICAGO", "UNIVERSITY OF UTAH"), ("UNIVERSITY", "UNIVERSITY"), (None, "X")]
    assert ask(spark, pairs, "a string, b string", s.share_distinctive_token) == [True, False, False, False]


def test_text_and_ids(spark):
    assert ask(spark, ["DESCRIPTION:THIS AWARD", "<![CDATA[MATCH INITIATIVE]]>", "<b>BOLD</b> text"], "x string", s.clean_description) == ["THIS AWARD", "MATCH INITIATIVE", "BOLD text"]
    assert ask(spark, [("X1", "National Science Foundation"), ("X1", "Elsewhere"), (None, "National Science Foundation"), ("", "National Science Foundation")], "a string, b string", s.internal_id) == ["ASST_NON_X1_049", None, None, None]
    hhs, nsf = "Department of Health and Human Services", "National Science Foundation"
    assert ask(spark, [("93.395", nsf), ("47.041", hhs), ("93.395", hhs), (None, hhs), ("99.999", hhs), ("93.1", None)], "a string, b string", s.cfda_mismatch) == [True, True, False, False, False, False]
    assert ask(spark, ["L,M", "Q", "Q; N", None, ""], "x string", s.emergency_codes) == [True, False, True, False, False]
    assert ask(spark, ["Smith's   Inst., Inc"], "x string", s.recipient_key) == ["SMITH S INST   INC"]


def test_period_text(spark):
    text = "- Oct/Nov 2024: $5,834,240\n- Dec 2024: $1,142,547\n- Jan 2025: -$5\nnothing"
    got = ask(spark, [text, "", None], "x string", s.parse_period_outlays)
    assert [tuple(r) for r in got[0]] == [("Oct/Nov 2024", 5834240.0, D(2024, 10, 1)), ("Dec 2024", 1142547.0, D(2024, 12, 1))]
    assert got[1] == [] and got[2] is None


def test_fiscal_dates(spark):
    assert ask(spark, [(2025, 1), (2025, 3), (2025, 4), (2025, 12)], "y int, m int", s.fiscal_to_calendar) == [D(2024, 10, 1), D(2024, 12, 1), D(2025, 1, 1), D(2025, 9, 1)]
    assert ask(spark, [D(2024, 9, 30), D(2024, 10, 1)], "d date", s.fiscal_year) == [2024, 2025]
    assert ask(spark, [D(2024, 9, 30), D(2024, 10, 1)], "d date", s.fiscal_month) == [12, 1]


def test_elapsed(spark):
    now = F.lit(D(2025, 1, 1))
    spans = [(D(2024, 7, 1), D(2025, 7, 4)), (None, D(2025, 1, 1)), (D(2020, 1, 1), D(2021, 1, 1)), (D(2026, 1, 1), D(2027, 1, 1)), (D(2025, 1, 1), D(2025, 1, 1)), (D(2025, 2, 1), D(2025, 1, 1))]
    got = ask(spark, spans, "a date, b date", lambda a, b: s.elapsed_ratio(a, b, now))
    assert got[0] == 0.5 and got[1:] == [None, 1.0, 0.0, None, None]


def test_groups_and_confidence(spark):
    assert ask(spark, ["R01", "T32", "F31", "K99", "P30", "U01", "X", None], "x string", s.activity_group) == ["R", "T", "F", "K", "P", "U", "Other", "Other"]
    assert ask(spark, [181, 180, 91, 90, None], "x int", s.gap_confidence) == ["high", "medium", "medium", "low", "low"]


def test_jaro(spark):
    import random

    import duckdb

    rng = random.Random(1)
    pairs = [("UNIVERSITY OF CHICAGO", "UNIVERSITY OF UTAH"), ("MARTHA", "MARHTA"), ("DWAYNE", "DUANE"), ("A", "B"), ("", "A"), ("AB", "BA"), ("ABCVWXYZ", "CABVWXYZ"), ("SAME", "SAME")]
    pairs += [tuple("".join(rng.choice("ABCD ") for _ in range(rng.randrange(1, 15))) for _ in range(2)) for _ in range(500)]
    got = jaro(*map(list, zip(*pairs, strict=True)))
    for (a, b), x in zip(pairs, got, strict=True):
        assert x == pytest.approx(duckdb.execute("SELECT jaro_similarity(?, ?)", [a, b]).fetchall()[0][0])
    assert (jaro(*map(list, zip(*pairs, strict=True)), 0.1) >= got).all() and len(jaro([], [])) == 0
    assert jaro(["DIXON"], ["DICKSONX"], 0.1)[0] == pytest.approx(0.8133333)
    assert ask(spark, pairs[:2], "a string, b string", jaro_distance) == pytest.approx((1 - got[:2]).tolist())


def test_letters_in_common_are_bounded_from_above(spark):
    import random
    from collections import Counter

    from pyspark.sql import functions as F

    from ledgerlens.operators.matching import common_letters, letter_profile

    rng = random.Random(2)
    pairs = [tuple("".join(rng.choice("AAABCé𝔘 ") for _ in range(rng.randrange(0, 20))) for _ in range(2)) for _ in range(200)]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", common_letters(letter_profile(F.col("a")), letter_profile(F.col("b"))).alias("n")).collect()
    for r in rows:
        assert r.n >= sum((Counter(r.a) & Counter(r.b)).values())
