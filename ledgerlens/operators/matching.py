"""Joining notices with awards: by grant number, then by name and date, then awards alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens import constants as k
from ledgerlens.functions.jaro import jaro_distance
from ledgerlens.functions.scalars import distinctive_tokens, elapsed_ratio, holds, member, normalise_org, normalise_text, safe_ratio
from ledgerlens.operators.numbering import identify_rows
from ledgerlens.schemas import ensure_columns, fields

AWARD_OPTIONAL = fields("grant_number string, total_outlays double, end_date date, sub_agency string, award_amount double, action_date date")
NOTICE_OPTIONAL = fields("grant_number string, org_name string, notice_date date, award_amount double")


def _numbered_notices(notices: DataFrame) -> DataFrame:
    return ensure_columns(notices, NOTICE_OPTIONAL).withColumn("grant_number", normalise_text(F.col("grant_number")))


def _numbered_awards(awards: DataFrame) -> DataFrame:
    a = ensure_columns(awards, AWARD_OPTIONAL)
    org = "org_name" if "org_name" in awards.columns else "recipient_name" if "recipient_name" in awards.columns else None
    return a.withColumns({"grant_number": normalise_text(F.col("grant_number")), "org_name": F.col(org) if org else F.lit(None).cast("string")})


def _named(df: DataFrame, *columns: str) -> DataFrame:
    """The names' rules are the dearest of the columns, so they are applied once, after rows were told apart by number."""
    return df.withColumns({c: normalise_org(F.col(c)) for c in columns})


def normalise_notices(notices: DataFrame) -> DataFrame:
    return _named(_numbered_notices(notices), "org_name")


def normalise_awards(awards: DataFrame) -> DataFrame:
    """recipient_name serves as org_name only where that column is absent."""
    return _named(_numbered_awards(awards), "org_name")


#: How often a letter is counted in a name's profile; what is beyond is only counted together.
PLANES = 3


def letter_profile(name: Column) -> Column:
    """A name's letters as bits: plane p<k> has a bit for each letter that occurs k times or more, and `more` counts the rest."""
    planes = [f"p{i}" for i in range(1, PLANES + 1)]

    def add(profile: Column, letter: Column) -> Column:
        carry, fields_ = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.ascii(letter), F.lit(64))), []
        for p in planes:
            fields_.append(profile[p].bitwiseOR(carry).alias(p))
            carry = carry.bitwiseAND(profile[p])
        return F.struct(*fields_, (profile["more"] + F.when(carry != 0, 1).otherwise(0)).alias("more"))

    return F.aggregate(F.split(name, ""), F.struct(*[F.lit(0).cast("long").alias(p) for p in planes], F.lit(0).alias("more")), add)


def common_letters(a: Column, b: Column) -> Column:
    """At least as many as the letters that two names of these profiles have in common."""
    shared = [F.bit_count(a[f"p{i}"].bitwiseAND(b[f"p{i}"])) for i in range(1, PLANES + 1)]
    return sum(shared, F.least(a["more"], b["more"]))


#: Names of a side that share a word and are compared by one task, at most about.
WORD_BLOCK = 2000


def dealt_words(left: DataFrame, right: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides' words (_w, name) with the blocks (_lb, _rb) in which their names meet.

    A word that more than `block` names of a side hold is cut into blocks of names; every
    block of the one side meets every block of the other as a key of its own. A
    rarer word is a single key.
    """
    counts = [side.groupBy("_w").agg(F.count(F.lit(1)).alias(n)) for side, n in ((left, "_nl"), (right, "_nr"))]
    often = counts[0].join(counts[1], "_w").where((F.col("_nl") > block) | (F.col("_nr") > block))
    often = often.select("_w", F.ceil(F.col("_nl") / block).alias("_gl"), F.ceil(F.col("_nr") / block).alias("_gr"))
    out = []
    for side, name, own, other in ((left, "left_name", "_lb", "_rb"), (right, "right_name", "_rb", "_lb")):
        mine, theirs = ("_gl", "_gr") if own == "_lb" else ("_gr", "_gl")
        dealt = side.join(often, "_w", "left").withColumn(own, F.coalesce(F.pmod(F.xxhash64(name), F.col(mine)), F.lit(0)))
        out.append(dealt.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(theirs), F.lit(1)) - 1))).drop("_gl", "_gr"))
    return out[0], out[1]


def similar_names(left: DataFrame, right: DataFrame, most: float = k.FUZZY_DISTANCE, block: int = WORD_BLOCK) -> DataFrame:
    """(left_name, right_name, org_name_dist) of distinct names that share a distinctive word, within the Jaro distance.

    A shared word is required anyway, so the join on words loses nothing, and
    only distinct names are compared; words that many names hold are dealt out in blocks. The
    distance can't be met without so many letters in common; pairs that have fewer, by the
    names' profiles, never leave the join, and only the others reach the Python function.
    """
    sides = []
    for df, name in ((left, "left"), (right, "right")):
        named = df.select(F.col("org_name").alias(f"{name}_name")).where(F.col(f"{name}_name").isNotNull()).distinct()
        named = named.withColumns({f"_{name}_n": F.length(f"{name}_name"), f"_{name}_p": letter_profile(F.col(f"{name}_name"))})
        sides.append(named.withColumn("_w", F.explode(distinctive_tokens(F.col(f"{name}_name")))))
    enough = common_letters(F.col("_left_p"), F.col("_right_p")) * (1 / F.col("_left_n") + 1 / F.col("_right_n")) >= 2 - 3 * most - 1e-6
    words = dealt_words(*sides, block)
    pairs = words[0].join(words[1], ["_w", "_lb", "_rb"]).where((F.col("left_name") == F.col("right_name")) | enough).select("left_name", "right_name")
    # few bytes, but much to do with each: a number of partitions that adaptive execution leaves alone
    pairs = pairs.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), "left_name", "right_name").distinct()
    return pairs.withColumn("org_name_dist", F.round(jaro_distance("left_name", "right_name"), 9)).where(F.col("org_name_dist") <= most)


def least_per_day(awards: DataFrame, most: int) -> DataFrame:
    """Of the awards of a name on a day, the `most` least by number, amount and id.

    What comes first for a notice among these doesn't depend on the notice, so no other can be
    needed. Tasks keep as many a key before the shuffle.
    """
    order = Window.partitionBy("right_name", "action_date").orderBy("grant_number", "award_amount", "award_row_id")
    return awards.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r")


def awards_in_reach(awards: DataFrame, days: int) -> DataFrame:
    """(right_name, _b, _near): a name's awards that dates of block _b, of 2 `days` each, can have within `days`, least first.

    An award stands in two blocks. A list holds no more than a few awards for each of its
    4 `days`, whatever the input, if the awards come from least_per_day.
    """
    blocks = F.array(*[block_of(F.date_add("action_date", i), days) for i in (-days, days)])
    award = F.struct("grant_number", "award_amount", "action_date", "award_row_id")
    return awards.withColumn("_b", F.explode(blocks)).groupBy("right_name", "_b").agg(F.array_sort(F.collect_list(award)).alias("_near"))


def block_of(date: Column, days: int) -> Column:
    return F.floor(F.date_diff(date, F.lit("1970-01-01")) / (2 * days))


def nearest_awards(notices: DataFrame, awards: DataFrame, names: DataFrame, days: int = k.FUZZY_DAYS, per_notice: int = k.FUZZY_PER_NOTICE) -> DataFrame:
    """(left_name, notice_date, award_row_id): for each name and date of a notice the nearest `per_notice` awards of similar names within `days`.

    A date meets a list of a name's awards, not their rows, and only the first `per_notice` of it
    that are within `days` leave the join: of awards of one name, which are as distant, no other can be needed. Ties in the
    distance go by the award's number, amount, date and id, so an award that repeats is ranked each time.
    """
    n = notices.select(F.col("org_name").alias("left_name"), "notice_date").where("left_name is not null and notice_date is not null").distinct()
    a = awards.select("award_row_id", F.col("org_name").alias("right_name"), "action_date", "grant_number", "award_amount").where("right_name is not null and action_date is not null")
    n = n.withColumn("_b", block_of(F.col("notice_date"), days)).join(names, "left_name")
    met = n.join(awards_in_reach(least_per_day(a, per_notice), days), ["right_name", "_b"])
    near = F.filter("_near", lambda x: F.abs(F.date_diff(x["action_date"], F.col("notice_date"))) <= days)
    met = met.select("left_name", "notice_date", "org_name_dist", F.inline(F.slice(near, 1, per_notice)))
    order = Window.partitionBy("left_name", "notice_date").orderBy("org_name_dist", "grant_number", "award_amount", "action_date", "award_row_id")
    return met.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= per_notice).select("left_name", "notice_date", "award_row_id")


def classify(active_despite_terminated: Column, no_recent_activity: Column, missing_outlays: Column, not_tracked: Column, sub_agency: Column, non_research=k.NON_RESEARCH_SUB_AGENCIES) -> Column:
    return (
        F.when(active_despite_terminated, "active_despite_terminated")
        .when(member(sub_agency, non_research), "normal")
        .when(no_recent_activity & ~missing_outlays, "possible_freeze")
        .when(no_recent_activity & missing_outlays, "possible_freeze_no_data")
        .when(not_tracked, "untracked")
        .otherwise("normal")
    )


def add_flags(joined: DataFrame, as_of, non_research=k.NON_RESEARCH_SUB_AGENCIES) -> DataFrame:
    """Ratios, flags and the discrepancy type of joined rows."""
    c = F.col
    today = F.lit(as_of).cast("date")
    open_ = holds(c("end_date") > today)
    notice_amount = c("award_amount_notice") if "award_amount_notice" in joined.columns else F.lit(None).cast("double")
    rows = joined.withColumns({"outlay_ratio": safe_ratio(c("total_outlays"), c("award_amount")), "elapsed_ratio": elapsed_ratio(c("action_date"), c("end_date"), today)})
    rows = rows.withColumns({
        "flag_amount_mismatch": holds((c("match_method") == "exact") & F.when(c("award_amount") > 0, F.abs(notice_amount / c("award_amount") - 1) > k.AMOUNT_MISMATCH)),
        "flag_umbrella_award": holds(c("award_amount") > k.UMBRELLA_AMOUNT),
        "flag_active_despite_terminated": c("notice_date").isNotNull() & holds(c("total_outlays") > 0) & open_,
        "flag_no_recent_activity": open_ & (c("total_outlays").isNull() | (c("total_outlays") == 0) | holds(c("outlay_ratio") < k.FREEZE_RATIO)),
        "flag_not_in_gw": c("match_method") == "unmatched_award",
    })
    rows = rows.withColumn("flag_missing_outlay_data", c("flag_no_recent_activity") & c("total_outlays").isNull())
    return rows.withColumn("discrepancy_type", classify(c("flag_active_despite_terminated"), c("flag_no_recent_activity"), c("flag_missing_outlay_data"), c("flag_not_in_gw"), c("sub_agency"), non_research))


def join_and_flag(notices: DataFrame, awards: DataFrame, as_of, fuzzy: bool = True, non_research=k.NON_RESEARCH_SUB_AGENCIES) -> DataFrame:
    """Every award, with the notices that match it: exactly, or else by name and date, or with none.

    What matched exactly on either side isn't offered to the fuzzy match. Notices
    that match nothing are dropped. Empty tables need no branch: all awards come
    out alone. Null notice dates are never terminated and never match by name. Awards that
    repeat are awards each: those that no notice takes come out alone, beside copies that match.
    """
    n, a = _numbered_notices(notices), _numbered_awards(awards)
    told = n.withColumnsRenamed({c: f"{c}_notice" for c in n.columns if c in a.columns})
    by_number = F.col("grant_number") == F.col("grant_number_notice")
    alone = F.lit("unmatched_award")
    if not fuzzy:  # one join says all
        rows = _named(a.join(told.withColumn("match_method", F.lit("exact")), by_number, "left").drop("grant_number_notice"), "org_name", "org_name_notice")
        return add_flags(rows.withColumn("match_method", F.coalesce("match_method", alone)), as_of, non_research)
    exact = _named(a.join(told, by_number), "org_name", "org_name_notice").withColumns({"grant_number_notice": F.lit(None).cast("string"), "match_method": F.lit("exact")})
    left_n = _named(told.join(a.select("grant_number").where("grant_number is not null").distinct(), by_number, "left_anti"), "org_name_notice")
    left_a = identify_rows(_named(a.join(n.select(F.col("grant_number").alias("grant_number_notice")).where("grant_number_notice is not null").distinct(), by_number, "left_anti"), "org_name"), "award_row_id")
    dated = left_n.select(F.col("org_name_notice").alias("org_name"), "notice_date").where("org_name is not null and notice_date is not null").distinct()
    best = nearest_awards(dated, left_a, similar_names(dated, left_a.where("action_date is not null"))).withColumnRenamed("notice_date", "_date")
    # notices are joined first, so that the awards, which are wide and many, are sent once
    met = left_n.join(best, (F.col("org_name_notice") == F.col("left_name")) & (F.col("notice_date") == F.col("_date"))).drop("left_name", "_date")
    near = left_a.join(met.withColumn("match_method", F.lit("fuzzy")), "award_row_id", "left").drop("award_row_id").withColumn("match_method", F.coalesce("match_method", alone))
    return add_flags(exact.unionByName(near), as_of, non_research)


def sort_discrepancies(df: DataFrame) -> DataFrame:
    return df.orderBy(F.asc_nulls_last("discrepancy_type"), F.desc_nulls_last("award_amount"), F.asc_nulls_last("notice_date"))


def summarise_discrepancies(df: DataFrame) -> DataFrame:
    """Counts and sums by agency and type, without what is normal, the largest first."""
    out = df.where("discrepancy_type <> 'normal'").groupBy("agency_name", "discrepancy_type").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("award_amount"), F.lit(0.0)).alias("total_award_amount"), F.coalesce(F.sum("total_outlays"), F.lit(0.0)).alias("total_outlays"))
    return out.orderBy(F.asc_nulls_last("agency_name"), F.desc_nulls_last("total_award_amount"))
