import datetime as dt
import math

import duckdb
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerlens.operators import calibration, charts, matching, outlays, spending, subawards, transactions, validate
from ledgerlens.plans import enrichment
from ledgerlens.schemas import NOTICES, ensure_columns

D = dt.date
NOW = "2025-06-01"
NOTICE = "agency_name string, notice_date date, source_url string, raw_text_snippet string, grant_number string, org_name string, award_amount double"
AWARD = "agency_name string, award_amount double, action_date date, grant_number string, org_name string, total_outlays double, end_date date, sub_agency string"


def notices(spark, *rows):
    return spark.createDataFrame([("NSF", d, "u", None, g, o, a) for g, o, d, a in rows], NOTICE)


def awards(spark, *rows):
    return spark.createDataFrame([("NSF", a, start, g, o, out, end, sub) for g, o, a, out, start, end, sub in rows], AWARD)


LATER, PAST = D(2025, 12, 1), D(2025, 4, 1)
START = D(2025, 1, 15)


def test_every_award_comes_out_and_unmatched_notices_do_not(spark):
    n = notices(spark, ("gr-1 ", "X", D(2025, 2, 1), None), ("B", "Y", D(2025, 2, 1), None), ("C", None, D(2025, 2, 1), None))
    a = awards(spark, ("GR-1", "Q", 1e6, 75e3, START, LATER, None), ("B", "Q", 1e6, 0.0, START, PAST, None), ("D", "Z", 1e6, 9e5, START, PAST, None))
    got = {r.grant_number: (r.match_method, r.discrepancy_type) for r in matching.join_and_flag(n, a, NOW).collect()}
    assert got == {"GR-1": ("exact", "active_despite_terminated"), "B": ("exact", "normal"), "D": ("unmatched_award", "untracked")}


def test_classification(spark):
    a = awards(spark, ("F", "Q", 1e6, 0.0, START, LATER, None), ("N", "Q", 1e6, None, START, LATER, None), ("L", "Q", 1e6, 5e4, START, LATER, None), ("O", "Q", 1e6, 2e5, START, LATER, None),
               ("H", "Q", 1e6, 0.0, START, LATER, "Administration for Children and Families"), ("Z", "Q", 0.0, 10.0, START, LATER, None), ("U", "Q", 2e9, 1.9e9, START, PAST, None))
    got = {r.grant_number: r for r in matching.join_and_flag(notices(spark), a, NOW).collect()}
    assert {g: r.discrepancy_type for g, r in got.items()} == {"F": "possible_freeze", "N": "possible_freeze_no_data", "L": "possible_freeze", "O": "untracked", "H": "normal", "Z": "untracked", "U": "untracked"}
    assert got["Z"].outlay_ratio is None and got["U"].flag_umbrella_award and not got["F"].flag_umbrella_award
    assert got["N"].flag_missing_outlay_data and not got["F"].flag_missing_outlay_data


def test_amount_flag_is_for_exact_matches(spark):
    n = notices(spark, ("A", None, None, 1e6), ("B", None, None, 5e5), (None, "Acme Labs", D(2025, 2, 1), 5e6))
    a = awards(spark, ("A", "x", 3e5, 1.0, START, PAST, None), ("B", "x", 5.1e5, 1.0, START, PAST, None), (None, "ACME LABS", 1e5, 1.0, START, PAST, None))
    got = {(r.grant_number, r.match_method): r.flag_amount_mismatch for r in matching.join_and_flag(n, a, NOW).collect()}
    assert got == {("A", "exact"): True, ("B", "exact"): False, (None, "fuzzy"): False}


def test_fuzzy_window_cap_and_copies(spark):
    n = notices(spark, (None, "Acme Labs", D(2025, 4, 15), None), (None, "Acme Labs", D(2025, 4, 15), None), (None, None, D(2025, 4, 15), None), (None, "Acme Labs", None, None))
    a = awards(spark, *[(f"A{i}", "ACME LABS", 1.0, 1.0, D(2025, 1, 15) + dt.timedelta(i), PAST, None) for i in range(8)], ("far", "ACME LABS", 1.0, 1.0, D(2025, 1, 14), PAST, None), ("other", "UNIVERSITY OF UTAH", 1.0, 1.0, START, PAST, None))
    rows = matching.join_and_flag(n, a, NOW).collect()
    fuzzy = sorted(r.grant_number for r in rows if r.match_method == "fuzzy")
    assert fuzzy == sorted(["A0", "A1", "A2", "A3", "A4"] * 2)
    assert {r.grant_number for r in rows if r.match_method == "unmatched_award"} == {"A5", "A6", "A7", "FAR", "OTHER"}


def test_repeated_awards_are_ranked_each_time(spark):
    """Seven equal awards: five are the nearest to the notice, and two come out alone; equal rows that match by number all do."""
    same = [("A1", "ACME LABS", 1.0, 1.0, START, PAST, None)] * 7
    n = notices(spark, (None, "Acme Labs", D(2025, 2, 1), None), ("B", "x", D(2025, 2, 1), None), ("B", "x", D(2025, 2, 1), None))
    rows = matching.join_and_flag(n, awards(spark, *same, *[("B", "Other", 1.0, 1.0, START, PAST, None)] * 3), NOW).collect()
    assert sorted((r.grant_number, r.match_method) for r in rows) == [("A1", "fuzzy")] * 5 + [("A1", "unmatched_award")] * 2 + [("B", "exact")] * 6


def test_awards_that_differ_in_where_a_null_stands(spark):
    """Both come out: one matches by its name, the other alone."""
    schema = "agency_name string, award_amount double, recipient_name string, org_name string, action_date date, end_date date, total_outlays double, sub_agency string, grant_number string"
    a = spark.createDataFrame([("NSF", 1.0, None, "ACME LABS", START, PAST, 1.0, None, None), ("NSF", 1.0, "ACME LABS", None, START, PAST, 1.0, None, None)], schema)
    rows = matching.join_and_flag(notices(spark, (None, "Acme Labs", D(2025, 2, 1), None)), a, NOW).collect()
    assert sorted((r.match_method, r.org_name) for r in rows) == [("fuzzy", "ACME LABS"), ("unmatched_award", None)]


def test_row_numbers(spark):
    """1 to n, distinct for repeated rows and for rows that differ in where a null stands; one hot row is no load of a window."""
    from ledgerlens.operators.numbering import number_rows

    rows = [(None, "x", 1.0), ("x", None, 1.0), (None, None, None), (None, None, None)] + [("hot", "hot", 2.0)] * 300 + [(str(i), None, float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "a string, b string, c double").repartition(7)
    for buckets in (1, 3, 64):
        got = number_rows(df, "id", buckets=buckets).collect()
        assert sorted(r.id for r in got) == list(range(1, len(rows) + 1))
        assert sorted((r.a, r.b, r.c) for r in got if r.c != 2.0 and r.a and r.b) == [] and sorted(map(str, [(r.a, r.b, r.c) for r in got])) == sorted(map(str, rows))
    one, two = ({(r.a, r.b, r.c): r.id for r in number_rows(d, "id").where("c <> 2.0").collect()} for d in (df, df.coalesce(1)))
    assert one == two
    assert number_rows(df.limit(0), "id").count() == 0


def jaro_pairs(left, right, most=0.08):
    from ledgerlens import constants
    from ledgerlens.functions.jaro import jaro

    words = lambda x: set(x.split()) - set(constants.ORG_STOPWORDS)
    both = [(x, y) for x in set(left) for y in set(right) if words(x) & words(y)]
    return {(x, y) for (x, y), s in zip(both, jaro([x for x, _ in both], [y for _, y in both])) if round(1 - s, 9) <= most}


def test_a_word_that_most_names_hold(spark):
    """Its names meet in blocks: the same pairs as all against all, and no key with more than a few blocks' pairs."""
    import random

    rng = random.Random(3)
    noise = lambda: "".join(rng.choice("ABCDE") for _ in range(3))
    names = [[f"COMMONWORD {noise()} {noise()}" if rng.random() < 0.7 else f"{noise()} RARE{rng.randrange(30)} INSTITUTION" for _ in range(160)] for _ in range(2)]
    left, right = (spark.createDataFrame([(x,) for x in side], "org_name string") for side in names)
    for block in (7, 2000):
        got = {(r.left_name, r.right_name) for r in matching.similar_names(left, right, block=block).collect()}
        assert got == jaro_pairs(*names)
    sides = [spark.createDataFrame([(w, x) for x in set(side) for w in set(x.split())], f"_w string, {n} string") for side, n in zip(names, ("left_name", "right_name"))]
    dealt = matching.dealt_words(*sides, 7)
    per_key = dealt[0].groupBy("_w", "_lb", "_rb").count().withColumnRenamed("count", "l").join(dealt[1].groupBy("_w", "_lb", "_rb").count().withColumnRenamed("count", "r"), ["_w", "_lb", "_rb"])
    assert per_key.selectExpr("max(l * r)").first()[0] <= (3 * 7) ** 2
    met = dealt[0].join(dealt[1], ["_w", "_lb", "_rb"]).groupBy("_w", "left_name", "right_name").count()
    plain = sides[0].join(sides[1], "_w")
    assert met.count() == plain.count() and met.selectExpr("max(count)").first()[0] == 1


def test_a_name_with_very_many_awards(spark):
    """At most five a day reach the join by dates, and the result is that of ranking all."""
    days = [START + dt.timedelta(i % 4) for i in range(3000)]
    a = awards(spark, *[(f"A{(i * 7919) % 3000:04}", "ACME LABS", float(i % 3), 1.0, d, PAST, None) for i, d in enumerate(days)])
    n = notices(spark, (None, "Acme Labs", D(2025, 2, 1), None), (None, "Acme Lab", D(2025, 4, 17), None), (None, "Acme Labs", D(2025, 2, 1), None))
    rows = matching.join_and_flag(n, a, NOW).collect()
    near = sorted((r.org_name_notice, r.grant_number) for r in rows if r.match_method == "fuzzy")
    # of the second notice only two days are within reach
    late = sorted(f"A{(i * 7919) % 3000:04}" for i, d in enumerate(days) if (D(2025, 4, 17) - d).days <= 90)[:5]
    assert near == sorted([("ACME LABS", f"A{i:04}") for i in range(5)] * 2 + [("ACME LAB", g) for g in late])
    assert len(rows) == 15 + 3000 - len({f"A{i:04}" for i in range(5)} | set(late))
    numbered = matching.normalise_awards(a).withColumnRenamed("org_name", "right_name").withColumn("award_row_id", F.monotonically_increasing_id())
    kept = matching.least_per_day(numbered, 5)
    assert kept.groupBy("right_name", "action_date").count().selectExpr("max(count)", "count(*)").first()[:] == (5, 4)
    assert "WindowGroupLimit" in kept._jdf.queryExecution().executedPlan().toString()


def test_dates_meet_lists_of_awards(spark):
    """F1 to F3: as ranking all awards in reach does, with nulls, ties and days on a block's edge; no more than five awards a name leave the join for a date."""
    import random

    rng = random.Random(5)
    day = lambda: dt.date(1970, 1, 1) + dt.timedelta(rng.choice((-181, -180, -91, -90, -1, 0, 89, 90, 179, 180, rng.randrange(-400, 400))))
    a = [(i, rng.choice("RSU"), day(), rng.choice((None, "1", "2", "10", f"G{i}")), rng.choice((None, 1.0, 2.0))) for i in range(900)]
    dates = sorted({(rng.choice("LM"), day()) for _ in range(300)})
    similar = [("L", "R", 0.0), ("L", "S", 0.05), ("M", "S", 0.0), ("M", "T", 0.0)]
    frames = (spark.createDataFrame(rows, schema) for rows, schema in ((dates, "org_name string, notice_date date"), (a, "award_row_id long, org_name string, action_date date, grant_number string, award_amount double"), (similar, "left_name string, right_name string, org_name_dist double")))
    out = matching.nearest_awards(*frames)
    low = lambda x: (x is not None, x or 0 if not isinstance(x, str) else x)
    want = set()
    for name, d in dates:
        met = sorted((dist, low(g), low(v), t, i) for left, right, dist in similar if left == name for i, r, t, g, v in a if r == right and abs((t - d).days) <= 90)
        want |= {(name, d, x[-1]) for x in met[:5]}
    assert {tuple(r) for r in out.collect()} == want and out.count() == len(want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "inline(slice(filter(" in plan


def test_ids_of_rows(spark):
    """No two rows share one, be they equal or different only in where a null stands, and a row has the same when it is computed again."""
    from ledgerlens.operators.numbering import identify_rows

    df = spark.createDataFrame([("x", None, 1.0), (None, "x", 1.0), ("x", "x", None), (None, None, None)] + [("h", "h", 2.0)] * 50, "a string, b string, c double")
    got = identify_rows(df, "id").collect()
    assert len({r.id for r in got}) == len(got) == 54
    assert {tuple(r) for r in identify_rows(df.repartition(7), "id").collect()} == {tuple(r) for r in got}


def test_names_are_compared_once_in_the_plan(spark):
    n = notices(spark, (None, "Acme Labs", D(2025, 2, 1), None))
    a = awards(spark, ("A", "ACME LABS", 1.0, 1.0, START, PAST, None))
    plan = matching.join_and_flag(n, a, NOW)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_null_numbers_and_empty_tables(spark):
    a = awards(spark, (None, None, 1.0, 1.0, None, None, None), (None, None, 1.0, 1.0, None, None, None))
    rows = matching.join_and_flag(notices(spark, (None, None, None, None)), a, NOW).collect()
    assert [r.match_method for r in rows] == ["unmatched_award"] * 2
    assert matching.join_and_flag(notices(spark, ("A", "x", PAST, 1.0)), awards(spark), NOW).count() == 0


def test_org_source(spark):
    a = spark.createDataFrame([("Acme University", 1.0)], "recipient_name string, award_amount double")
    assert matching.normalise_awards(a).first().org_name == "ACME UNIVERSITY"
    b = spark.createDataFrame([(None, "Acme", 1.0)], "org_name string, recipient_name string, award_amount double")
    assert matching.normalise_awards(b).first().org_name is None
    assert matching.normalise_awards(spark.createDataFrame([(1.0,)], "award_amount double")).first().org_name is None


def test_summary(spark):
    rows = [("NIH", 1e6, 5e4, "active_despite_terminated"), ("NSF", None, None, "untracked"), ("NSF", 2.0, 1.0, "normal")]
    got = matching.summarise_discrepancies(spark.createDataFrame(rows, "agency_name string, award_amount double, total_outlays double, discrepancy_type string")).collect()
    assert [tuple(r) for r in got] == [("NIH", "active_despite_terminated", 1, 1e6, 5e4), ("NSF", "untracked", 1, 0.0, 0.0)]


def test_checks(spark):
    good = notices(spark, ("1", "o", None, None))
    validate.check_notices(good)
    for bad in (good.drop("agency_name"), good.withColumn("notice_date", F.lit("x"))):
        with pytest.raises((ValueError, TypeError)):
            validate.check_notices(bad)
    for column, value in (("source_url", F.lit("")), ("agency_name", F.lit(None).cast("string"))):
        bad = validate.check_notices(good.union(good.withColumn(column, value)))
        for use in (bad, bad.select("grant_number"), bad.groupBy().count()):  # also where the column isn't asked for
            with pytest.raises(PySparkException, match=f"empty values: {column}"):
                use.collect()
    assert validate.check_notices(good).count() == 1
    a = awards(spark, ("1", "o", None, 1.0, START, LATER, None))
    validate.check_awards(a)
    for bad in (a.drop("award_amount"), a.withColumn("award_amount", F.lit("x")), a.withColumn("grant_number", F.lit(5))):
        with pytest.raises((ValueError, TypeError)):
            validate.check_awards(bad)


def test_profile_of_what_is_written(spark, tmp_path):
    rows = [(i, None if i % 3 else "x", i % 7 == 0, None if i % 2 else i % 5 == 0) for i in range(41)]
    df = spark.createDataFrame(rows, "`odd.name` int, name string, flag_a boolean, flag_b boolean").repartition(3)
    written = validate.write_with_profile(df, f"{tmp_path}/t")
    plain = validate.profile(df.withColumnRenamed("odd.name", "n1")).collect()
    assert [tuple(r)[1:] for r in written.collect()] == [tuple(r)[1:] for r in plain] and written.first()[0] == "odd.name"
    assert spark.read.parquet(f"{tmp_path}/t").count() == 41
    none = validate.write_with_profile(df.limit(0), f"{tmp_path}/u").collect()
    assert [(r.pct_null, r.high_null, r.n_flagged) for r in none] == [(None, False, None), (None, False, None), (None, False, 0), (None, False, 0)]


def test_names_are_listed_as_first_seen(spark):
    rows = [("P", "r2", "b", 1.0, 3, "s3"), ("P", "r2", "a", 2.0, 5, "s2"), ("P", "r2", "b", 4.0, 9, "s9"), ("P", "r2", None, 8.0, 1, "s1"), ("P", "r2", "z", 1.0, None, "s0"), ("Q", "r1", "b", 1.0, 2, "s8")]
    schema = "prime_award_id string, prime_recipient string, subawardee_name string, subaward_amount double, day int, subaward_id string"
    j = spark.createDataFrame(rows, schema).withColumn("subaward_date", F.make_date(F.lit(2025), F.lit(1), "day")).withColumn("discrepancy_type", F.when(F.col("prime_award_id") == "P", "untracked").otherwise("possible_freeze"))
    got = {r.prime_award_id: (r.n_subawards, r.total_subaward_amount, r.subawardees) for r in subawards.by_prime(j, ("untracked", "possible_freeze")).collect()}
    assert got == {"P": (5, 16.0, "NA; b; a; z"), "Q": (1, 1.0, "b")}
    down = {r.subawardee_name: tuple(r)[1:] for r in subawards.downstream(j).collect()}
    assert down["b"] == (2, 6.0, "possible_freeze, untracked", "r1; r2") and down[None] == (1, 8.0, "untracked", "r2")


def test_names_without_ids_are_listed_as_by_sql(spark):
    """A row without an id doesn't tell when its name is first seen, so names that have no other come last, these by date."""
    rows = [("P", "late", 9, "s9"), ("P", "late", 1, None), ("P", "b", 2, None), ("P", "z", 1, None), ("P", "early", 5, "s5"), ("P", "undated", None, "s0")]
    schema = "prime_award_id string, subawardee_name string, day int, subaward_id string"
    j = spark.createDataFrame(rows, schema).withColumns({"subaward_date": F.make_date(F.lit(2025), F.lit(1), "day"), "subaward_amount": F.lit(1.0), "prime_recipient": F.lit("r"), "discrepancy_type": F.lit("possible_freeze")})
    assert subawards.frozen(j).first().subawardees == "early; late; undated; z; b"
    con = duckdb.connect()
    con.execute("CREATE TABLE sf (prime_award_id VARCHAR, subawardee_name VARCHAR, subaward_date DATE, subaward_id VARCHAR)")
    con.executemany("INSERT INTO sf VALUES (?, ?, make_date(2025, 1, ?), ?)", rows)
    listed = con.execute(enrichment.names("subawardee_name", "; ", "listed", "prime_award_id", "true")[1:-1]).fetchone()[1].split("; ")
    # z and b, which have no id at all, are a tie to the SQL
    assert listed[:3] == ["early", "late", "undated"] and set(listed[3:]) == {"b", "z"}


def test_award_and_notice_flags(spark):
    a = awards(spark, ("1", "o", 500.0, 1000.0, START, PAST, None), ("2", "o", 1000.0, -100.0, LATER, START, None), ("3", "o", 0.0, None, None, None, None))
    got = {r.grant_number: r for r in validate.flag_awards(a, F.lit(NOW).cast("date")).collect()}
    assert got["1"].flag_over_disbursed and got["2"].flag_negative_outlay and got["2"].flag_date_inverted and got["2"].flag_future_date and got["3"].flag_zero_award
    assert not any(got["3"][f] for f in ("flag_over_disbursed", "flag_negative_outlay", "flag_date_inverted", "flag_future_date", "flag_cfda_mismatch"))
    n = spark.createDataFrame([("NSF", "CA", "2301234"), ("NSF", "XX", "ABC"), ("NIH", "ON", "1R01AI123456-01"), ("NIH", None, None), ("EPA", "PR", "?")], "agency_name string, org_state string, grant_number string")
    flags = [(r.flag_international, r.flag_invalid_state, r.flag_bad_grant_number) for r in validate.flag_notices(n).collect()]
    assert flags == [(False, False, False), (False, True, True), (True, False, False), (False, False, False), (False, False, False)]
    assert not any(validate.flag_notices(n.select("agency_name")).first()[1:])


def test_profile_and_duplicates(spark):
    df = spark.createDataFrame([("a", True), (None, False), (None, None), ("a", True)], "g string, flag_x boolean")
    got = {r.column: tuple(r)[1:] for r in validate.profile(df).collect()}
    assert got == {"g": (50.0, True, None, None), "flag_x": (25.0, True, 2, 50.0)}
    assert validate.duplicate_count(df, "g", True).first()[0] == 2 and validate.duplicate_count(df, "g", False).first()[0] == 1
    assert validate.profile(df.where("false")).count() == 2


TXN = "grant_number string, transaction_date date, obligation_amount double, transaction_desc string, action_type string, modification_number string"


def txns(spark, *rows):
    return spark.createDataFrame([(g, d, a, None, t, m) for g, d, a, t, m in rows], TXN)


def test_transactions(spark):
    t = txns(spark, ("A", D(2025, 1, 1), 5.0, "A", "1"), ("A", None, 7.0, "A", "2"), ("B", D(2025, 3, 3), None, "A", "1"))
    got = {r.grant_number: tuple(r)[1:] for r in transactions.summarise(t, NOW).collect()}
    assert got == {"A": (D(2025, 1, 1), 1, 5.0, 151, "medium"), "B": (D(2025, 3, 3), 1, 0.0, 90, "low")}
    d = txns(spark, ("A", START, -5000.0, "A", "1"), ("A", PAST, -3000.0, "A", "2"), ("A", PAST, 1000.0, "A", "3"), ("B", START, -2000.0, "A", "1"), ("C", START, -1000.0, "A", "1"))
    assert {r.grant_number: (r.n_deobligations, r.total_deobligated, r.deobligation_flag) for r in transactions.deobligations(d).collect()} == {"A": (2, -8000.0, True), "B": (1, -2000.0, False)}
    assert transactions.enrich(spark.createDataFrame([("Z",)], "grant_number string"), t, NOW).first().freeze_confidence is None


def test_terminations_and_reinstatements(spark):
    t = txns(spark, ("A", D(2025, 1, 15), 0.0, "E", "2"), ("A", D(2025, 3, 10), 0.0, "E", "3"), ("A", D(2025, 3, 10), 0.0, "A", "4"), ("A", D(2025, 4, 1), 0.0, "A", "5"), ("A", D(2025, 5, 1), 0.0, "B", "6"), ("B", D(2025, 1, 1), 0.0, "F", "1"), ("C", None, 0.0, "E", "1"))
    assert {r.grant_number: tuple(r)[1:] for r in transactions.terminations(t).collect()} == {"A": (D(2025, 3, 10), "E", "3"), "B": (D(2025, 1, 1), "F", "1")}
    assert [tuple(r) for r in transactions.reinstatements(t).collect()] == [("A", D(2025, 3, 10), D(2025, 4, 1), "A")]


def test_spikes(spark):
    months = [(f"G{i}", D(2025, m, 1), -1.0, "A", "1") for m, n in ((1, 1), (2, 1), (3, 5)) for i in range(n)]
    d = spark.createDataFrame([(f"G{i}", "NIH") for i in range(5)], "grant_number string, agency_name string")
    assert {r.year_month: r.spike_flag for r in transactions.deobligation_months(txns(spark, *months), d).collect()} == {"2025-01": False, "2025-02": False, "2025-03": True}


FILE_C = "grant_number string, reporting_date date, reporting_year int, reporting_month int, outlay_amount double, obligated_amount double"


def file_c(spark, *rows):
    return spark.createDataFrame([(g, d, 2025, 1, a, None) for g, d, a in rows], FILE_C)


def test_period_features(spark):
    m = [D(2025, i, 1) for i in range(1, 6)]
    rows = [("A", m[0], 5.0), ("A", m[1], 0.0), ("A", m[2], None), ("A", m[3], -2.0), ("B", m[0], 0.0), ("B", m[1], None), ("C", m[0], 0.0), ("C", m[1], 1.0), ("D", m[0], 3.0), ("D", None, 0.0)]
    got = {r.grant_number: (r.file_c_last_outlay_date, r.file_c_months_zero, r.file_c_total_periods, r.file_c_periods_with_outlays, r.file_c_total_outlays) for r in outlays.features(file_c(spark, *rows)).collect()}
    assert got == {"A": (m[0], 3, 4, 1, 3.0), "B": (None, 2, 2, 0, 0.0), "C": (m[1], 0, 2, 1, 1.0), "D": (m[0], 1, 2, 1, 3.0)}


def test_targeting_windows(spark):
    labels = spark.createDataFrame([("Duke", D(2025, 2, 1), D(2025, 3, 1)), ("Duke", D(2025, 2, 5), None), (None, D(2025, 1, 1), None)], "org_name string, targeted_start_date date, targeted_end_date date")
    look = outlays.targeting_lookup(labels, NOW)
    assert [tuple(r) for r in look.collect()] == [("Duke", D(2025, 2, 1), D(2025, 6, 1), 2)]
    fc = file_c(spark, ("A", D(2025, 1, 31), 10.0), ("A", D(2025, 2, 1), 20.0), ("A", D(2025, 6, 1), 0.0), ("A", D(2025, 6, 2), 99.0), ("Z", D(2025, 2, 1), 1.0))
    d = spark.createDataFrame([("A", "DUKE", 100.0), ("Z", "Else", 1.0)], "grant_number string, recipient_name string, award_amount double")
    got = {r.grant_number: (r.outlays_before_targeting, r.outlays_during_targeting, r.months_zero_during_freeze, r.pct_outlaid_at_targeting) for r in outlays.temporal_features(outlays.features(fc), fc, look, d).collect()}
    assert got == {"A": (10.0, 20.0, 1, 0.1), "Z": (None, None, None, None)}


def test_post_termination(spark):
    ended = spark.createDataFrame([("A", D(2025, 1, 1)), ("B", D(2025, 1, 1)), ("N", None)], "grant_number string, notice_date date")
    fc = file_c(spark, ("A", D(2025, 3, 1), 500.0), ("A", D(2025, 7, 1), 5000.0), ("A", D(2025, 8, 1), 99.0), ("B", D(2025, 3, 1), 500.0), ("N", D(2025, 8, 1), 500.0))
    got = {r.grant_number: tuple(r)[1:] for r in outlays.post_termination(fc, ended).collect()}
    assert got == {"A": (True, 1, 5000.0, D(2025, 7, 1), D(2025, 7, 1)), "B": (False, 0, 0.0, None, None)}


def test_evidence(spark):
    rows = [("possible_freeze", None, None, None, None), ("untracked", None, None, None, None), ("x", 3, 181, 5, 1), ("x", 1, 91, 5, 1), ("x", 0, 500, 5, 5), ("x", 0, None, 5, 4), ("x", 3, 90, 5, 1), ("x", 3, None, 5, 1)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, discrepancy_type string, file_c_months_zero int, days_since_last_transaction int, file_c_total_periods int, file_c_periods_with_outlays int")
    got = [r.e for r in df.select("i", outlays.freeze_evidence().alias("e")).orderBy("i").collect()]
    assert got == ["possible_freeze", None, "confirmed_freeze", "likely_freeze", "confirmed_not_frozen", "likely_not_frozen", "possible_freeze", "possible_freeze"]


def test_subawards_and_emergency(spark):
    s = spark.createDataFrame([("1", "X", START, 5.0, "P", "Prime"), ("2", None, None, 7.0, "P", "Prime"), ("3", "X", None, 1.0, "T", None)], "subaward_id string, subawardee_name string, subaward_date date, subaward_amount double, prime_award_id string, prime_recipient string")
    d = spark.createDataFrame([("P", "possible_freeze", "Q"), ("T", "active_despite_terminated", None), ("N", "normal", "L")], "grant_number string, discrepancy_type string, def_codes string")
    j = subawards.flow(s, d)
    assert [tuple(r) for r in subawards.frozen(j).collect()] == [("P", "Prime", 2, 12.0, "X; NA", START)]
    assert [tuple(r) for r in subawards.terminated(j).collect()] == [("T", None, 1, 1.0, "X", None)]
    assert {r.subawardee_name: tuple(r)[1:] for r in subawards.downstream(j).collect()} == {"X": (2, 6.0, "possible_freeze, active_despite_terminated", "Prime; NA"), None: (1, 7.0, "possible_freeze", "Prime")}
    assert {r.grant_number: r.flag_emergency_exempt for r in subawards.emergency_flags(d).collect()} == {"P": False, "T": False, "N": False}
    codes = spark.createDataFrame([("P", "L,M"), ("P", None), ("N", "N")], "grant_number string, def_codes string")
    assert {r.grant_number: (r.def_codes, r.flag_emergency_exempt) for r in subawards.emergency_flags(d, codes).collect()} == {"P": ("L,M", True), "T": (None, False), "N": ("N", False)}
    assert subawards.emergency_flags(d.drop("def_codes")).first().flag_emergency_exempt is None


def test_compression(spark):
    schema = "recipient_id string, recipient_name string, amount_M double"
    base = spark.createDataFrame([("1", "A", 100.0), ("1", "A", 50.0), ("2", "Be-ta, Inc", 10.0), (None, "C", 5.0), (None, "Gone", 4.0), ("9", "Zero", 0.0)], schema)
    now = spark.createDataFrame([("1", "A", 60.0), ("7", "BE TA  INC", 20.0), (None, "c", 2.5), ("9", "Zero", 3.0)], schema)
    got = {r.recipient_name: (r.current_M, r.yoy_pct, r.drop_M, r.below_cutoff, r.cutoff_floor_M, r.join_method) for r in spending.compression(base, now).collect()}
    assert got == {"A": (60.0, -40.0, 40.0, False, 2.5, "recipient_id"), "C": (2.5, -50.0, 2.5, False, 2.5, "name"), "Gone": (None, None, None, True, 2.5, "none"), "Zero": (3.0, None, -3.0, False, 2.5, "recipient_id"), "Be-ta, Inc": (None, None, None, True, 2.5, "none")}
    assert spending.dedup_recipients(base).where("recipient_id is null").count() == 2


def test_auc(spark):
    ask = lambda rows: calibration.auc(spark.createDataFrame(rows, "prediction double, label int")).first().auc
    assert ask([(0.9, 1), (0.8, 1), (0.1, 0), (0.2, 0)]) == 1.0
    assert ask([(0.5, 1), (0.5, 0)]) == 0.5
    assert ask([(0.5, 1)]) is None


def test_auc_of_many_ranges_is_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [(float(np.round(rng.normal(i % 2 * 0.5), 2)), int(i % 2)) for i in range(600)]
    pos, neg = ([s for s, y in rows if y == v] for v in (1, 0))
    want = np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg])
    df = spark.createDataFrame(rows, "prediction double, label int")
    assert calibration.auc(df).first().auc == pytest.approx(want) == calibration.auc(df, parts=3).first().auc


def test_results_are_ordered(spark):
    t = spark.createDataFrame([("A", dt.date(2025, 2, 1), -2000.0), ("B", dt.date(2025, 1, 1), -9000.0), ("C", dt.date(2025, 1, 2), -2000.0), ("B", dt.date(2025, 3, 1), -5000.0)], "grant_number string, transaction_date date, obligation_amount double")
    assert [r.grant_number for r in transactions.deobligations(t).collect()] == ["B", "A", "C"]
    agencies = spark.createDataFrame([("A", "Z"), ("B", "Y"), ("C", "Z")], "grant_number string, agency_name string")
    assert [(r.agency_name, r.year_month) for r in transactions.deobligation_months(t, agencies).collect()] == [("Y", "2025-01"), ("Y", "2025-03"), ("Z", "2025-01"), ("Z", "2025-02")]
    j = spark.createDataFrame([("P", "r", "x", 1.0, "possible_freeze"), ("Q", "r", "x", 5.0, "possible_freeze"), ("Q", "r", "y", None, "possible_freeze"), ("N", "r", "y", 1.0, "active_despite_terminated"), ("M", "r", "y", 9.0, "active_despite_terminated")], "prime_award_id string, prime_recipient string, subawardee_name string, subaward_amount double, discrepancy_type string").withColumn("subaward_date", F.lit(None).cast("date"))
    assert [r.prime_award_id for r in subawards.frozen(j).collect()] == ["Q", "P"]
    assert [r.prime_award_id for r in subawards.terminated(j).collect()] == ["M", "N"]
    assert [r.subawardee_name for r in subawards.downstream(j).collect()] == ["y", "x"]
    base = spark.createDataFrame([("1", "A", 10.0), ("2", "B", 10.0), ("3", "C", 10.0), ("4", "D", 10.0)], "recipient_id string, recipient_name string, amount_M double")
    now = spark.createDataFrame([("1", "A", 9.0), ("2", "B", 2.0), ("4", "D", 12.0)], "recipient_id string, recipient_name string, amount_M double")
    assert [r.recipient_name for r in spending.compression(base, now).collect()] == ["B", "A", "D", "C"]


def test_classifier_is_newton_on_the_same_rows(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        ratio, elapsed, days = rng.random(), rng.random(), int(rng.integers(0, 400))
        frozen = bool(rng.random() < 1 / (1 + np.exp(2 * ratio - elapsed)))
        rows.append((f"g{i}", frozen, ratio, elapsed, days if i % 5 else None, "RTFKX"[i % 5]))
    df = spark.createDataFrame(rows, "gw_award_id string, gw_frozen boolean, our_outlay_ratio double, our_elapsed_ratio double, days_since_last_transaction int, activity_code_group string")
    found = calibration.classifier(df)
    x = np.array([[1, r[2], r[3], r[4] if r[4] is not None else 365, *(float(r[5] == c) for c in "RTFK")] for r in rows])
    y, w = np.array([float(r[1]) for r in rows]), np.zeros(8)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]), x.T @ (y - p))
    got = {r.feature: r.coefficient for r in found["coefficients"].collect()}
    assert [got[f] for f in calibration.MODEL_FEATURES] == pytest.approx(w[1:].tolist(), abs=1e-6)
    predicted = {r.gw_award_id: (r.fold, r.prediction) for r in found["predictions"].collect()}
    for fold in range(5):  # each fold by the model of the others
        rest = np.array([predicted[r[0]][0] != fold for r in rows])
        v = np.zeros(8)
        for _ in range(50):
            p = 1 / (1 + np.exp(-x[rest] @ v))
            v += np.linalg.solve(x[rest].T @ (x[rest] * (p * (1 - p))[:, None]), x[rest].T @ (y[rest] - p))
        want = 1 / (1 + np.exp(-x[~rest] @ v))
        assert [predicted[r[0]][1] for r, out in zip(rows, ~rest, strict=True) if out] == pytest.approx(want.tolist(), abs=1e-6)
    folds = [f for f, _ in predicted.values()]
    assert {folds.count(i) for i in range(5)} == {60}
    error = np.sqrt(np.diag(np.linalg.inv(x.T @ (x * (p_ := 1 / (1 + np.exp(-x @ w)))[:, None] * (1 - p_)[:, None]))))[1:]
    assert [r.std_error for r in sorted(found["coefficients"].collect(), key=lambda r: calibration.MODEL_FEATURES.index(r.feature))] == pytest.approx(error.tolist(), rel=1e-6)
    assert all(r.p_value == pytest.approx(math.erfc(abs(r.coefficient / r.std_error) / 2**0.5)) for r in found["coefficients"].collect())
    totals = {(r.model, r.feature): r.total for r in calibration.fitted_totals(df).collect()}
    assert len(totals) == 6 * 8 and totals[5, "intercept"] == pytest.approx(y.sum()) and totals[5, "our_outlay_ratio"] == pytest.approx((y * x[:, 1]).sum())
    few = df.limit(20)
    assert calibration.predictions(few).count() == calibration.thresholds(calibration.predictions(few)).count() == 0
    assert [r.coefficient for r in calibration.coefficients(few).collect()] == [None] * 7
    assert found["predictions"].count() == 300 and 0.4 < found["auc"].first().auc < 0.9
    assert calibration.classifier(df.limit(20)) is None


def test_charts(spark):
    n = spark.createDataFrame([("NIH", f"I{i}", 1.0) for i in range(20) for _ in range(2 if i < 5 else 1)], "agency_name string, institute string, award_amount double")
    assert charts.institute_bars(n, 3).count() == 5 and charts.institute_bars(n, 6).count() == 20
    status = spark.createDataFrame([("🧊 Frozen Funding",), ("💧 Possibly Unfrozen Funding",), ("Terminated",), (None,)], "s string")
    assert [r.x for r in status.select(charts.status_label(F.col("s")).alias("x")).collect()] == ["Frozen", "Unfrozen", "Terminated", "Other"]
    assert set(NOTICES.fieldNames()) <= set(ensure_columns(n, NOTICES).columns)
