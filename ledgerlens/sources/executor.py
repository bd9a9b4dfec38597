"""Requests of a table sent by a few tasks: one row of answer for every page, failures named."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ledgerlens.operators.outlays import roll_up
from ledgerlens.sources import requests, tables
from ledgerlens.sources.pages import INTERVAL, Client, has_more, records

ANSWERS = "key string, page int, payload string, error string"


def send(plan: DataFrame, url: str, pages: int = 5, size: int = 100, streams: int = 1, interval: float = INTERVAL, tries: int = 3, wait: float = 2, agent: str = "ledgerlens") -> DataFrame:
    """(key, page, payload, error): the answers to the requests of plan (key, body: JSON text), page by page.

    A request's pages are asked for one after the other, while the answer says that there are more, up to
    `pages`. `streams` tasks share one bound of a request every `interval` seconds: each waits streams x
    interval between its own, and they start one interval apart. A page that fails every time is a row with
    its error and without a payload, and ends its request; the others go on. Nothing is
    sent before the rows are asked for, and a task that is lost sends its requests again.
    """
    client = Client(url, "POST", tries, wait, agent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pause, first = TaskContext.get().partitionId() * interval, True
        for b in batches:
            for key, body in zip(b.column("key").to_pylist(), b.column("body").to_pylist(), strict=True):
                for page in range(1, pages + 1):
                    time.sleep(pause)
                    pause = streams * interval
                    payload, error = client.ask(json.loads(body) | {"page": page, "limit": size})
                    yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.string()), "page": pa.array([page], pa.int32()), "payload": pa.array([payload], pa.string()), "error": pa.array([error], pa.string())})
                    if payload is None or not has_more(payload):
                        break

    return plan.select(F.col("key").cast("string").alias("key"), "body").repartition(streams).mapInArrow(run, ANSWERS)


def available(plan: DataFrame, url: str, **how) -> bool:
    """Whether the interface answers one request of the plan with records: the probe before a long read."""
    one: Row | None = send(plan.limit(1), url, pages=1, size=5, **how).first()
    return bool(one and one.payload and records(one.payload))


def fetch_file_c(awards: DataFrame, url: str, probe: bool = True, **how) -> tuple[DataFrame, DataFrame]:
    """Sums by grant and period of what the funding interface says of the awards, at most five pages each, and (grant_number, page, error) of what failed.

    Awards without a known agency aren't asked for; each number is asked for once. Where the probe fails there are no rows.
    Both tables send the requests when they are read, so write the answers first if both are needed: see answers_of().
    """
    plan = requests.funding_requests(awards)
    if probe and not available(plan, url, **{k: v for k, v in how.items() if k not in ("pages", "size", "streams")}):
        plan = plan.limit(0)
    return answers_of(send(plan, url, **how))


def answers_of(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Period sums and failures of answers to funding requests."""
    payloads = answers.where("payload is not null").select(F.col("key").alias("grant_number"), "payload")
    return roll_up(tables.file_c(payloads)), answers.where("error is not null").select(F.col("key").alias("grant_number"), "page", "error")


def fetch_transactions(ids: DataFrame, url: str, batch: int = 25, pages: int = 10, **how) -> tuple[DataFrame, DataFrame]:
    """Transactions of the known, distinct numbers of ids, asked for in batches, and (batch, page, error) of what failed."""
    answers = send(requests.transaction_requests(ids, batch), url, pages=pages, **how)
    return tables.transactions(answers.where("payload is not null")), answers.where("error is not null").select(F.col("key").alias("batch"), "page", "error")
