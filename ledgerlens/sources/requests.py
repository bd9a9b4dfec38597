"""Bodies of the requests to the award interfaces, and the requests that a table of awards needs."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import internal_id

#: Kinds of assistance awards, and the fields that the parsers in tables.py read.
GRANT_TYPES = ("02", "03", "04", "05")
AWARD_FIELDS = ("Award ID", "Recipient Name", "Recipient UEI", "Awarding Agency", "Awarding Sub Agency", "Award Amount", "Total Outlays", "Start Date", "End Date", "Last Modified Date", "Description", "CFDA Number", "def_codes", "generated_internal_id")
TRANSACTION_FIELDS = ("Award ID", "Action Date", "Transaction Amount", "Transaction Description", "Action Type", "Mod")
SUBAWARD_FIELDS = ("Sub-Award ID", "Sub-Awardee Name", "Sub-Award Date", "Sub-Award Amount", "Prime Award ID", "Prime Recipient Name", "Awarding Agency", "Awarding Sub Agency")


def _search(fields: Sequence[str], sort: str, filters: dict, **more) -> str:
    return json.dumps({"filters": {"award_type_codes": list(GRANT_TYPES)} | filters, "fields": list(fields), "sort": sort, "order": "desc"} | more)


def _filters(agencies: Sequence[str], start: str | None, end: str | None, ids: Sequence[str]) -> dict:
    out: dict = {}
    if agencies:
        out["agencies"] = [{"type": "awarding", "tier": "toptier", "name": a} for a in agencies]
    if start or end:
        out["time_period"] = [{"start_date": start, "end_date": end}]
    if ids:
        out["award_ids"] = list(ids)
    return out


def awards(agencies: Sequence[str], start: str, end: str) -> str:
    """Option body of the awards of some agencies in a time window: the server filters, not Spark."""
    return _search(AWARD_FIELDS, "Award Amount", _filters(agencies, start, end, ()))


def transactions(ids: Sequence[str]) -> str:
    return _search(TRANSACTION_FIELDS, "Action Date", _filters((), None, None, ids))


def subawards(agencies: Sequence[str], start: str, end: str) -> str:
    return _search(SUBAWARD_FIELDS, "Sub-Award Amount", _filters(agencies, start, end, ()), subawards=True)


def funding_plan(awards_: DataFrame) -> DataFrame:
    """(grant_number, award_id): the requests for periods, one for each award whose agency has a code."""
    plan = awards_.select("grant_number", internal_id(F.col("grant_number"), F.col("agency_name")).alias("award_id"))
    return plan.where("award_id is not null").distinct()


def id_batches(ids: DataFrame, size: int = 50) -> DataFrame:
    """(batch, ids): known distinct ids of a column grant_number in lists of about `size`, by a hash, so that no task has them all."""
    known = ids.select("grant_number").where("grant_number is not null").distinct()
    batch = F.pmod(F.xxhash64("grant_number"), F.lit(max(1, known.count() // size)))
    return known.groupBy(batch.alias("batch")).agg(F.array_sort(F.collect_list("grant_number")).alias("ids"))


def funding_requests(awards_: DataFrame) -> DataFrame:
    """(key, body) of funding_plan(): an award's number and what to ask for."""
    return funding_plan(awards_).groupBy("grant_number").agg(F.min("award_id").alias("award_id")).select(F.col("grant_number").alias("key"), F.to_json(F.struct("award_id")).alias("body"))


def transaction_requests(ids: DataFrame, size: int = 25) -> DataFrame:
    """(key, body) of id_batches(): a batch's number and what to ask for."""
    filters = F.struct(F.array(*[F.lit(t) for t in GRANT_TYPES]).alias("award_type_codes"), F.col("ids").alias("award_ids"))
    body = F.struct(filters.alias("filters"), F.array(*[F.lit(f) for f in TRANSACTION_FIELDS]).alias("fields"), F.lit("Action Date").alias("sort"), F.lit("desc").alias("order"))
    return id_batches(ids, size).select(F.col("batch").cast("string").alias("key"), F.to_json(body).alias("body"))
