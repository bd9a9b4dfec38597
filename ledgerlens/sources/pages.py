"""Data sources of paged HTTP payloads, read by a few tasks that wait between requests."""

from __future__ import annotations

import datetime as dt
import json
import time
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: The last offset that the notices' interface answers, and seconds between two requests to one server.
MAX_OFFSET, INTERVAL = 14_999, 2.0


class Client:
    """Asks one URL for JSON; retries wait longer each time."""

    def __init__(self, url: str, method: str = "POST", tries: int = 3, wait: float = 2, agent: str = "ledgerlens"):
        self.url, self.method, self.tries, self.wait, self.agent = url, method, tries, wait, agent

    def _request(self, asked: dict) -> urllib.request.Request:
        head = {"User-Agent": self.agent, "Accept": "application/json"}
        if self.method == "GET":
            return urllib.request.Request(f"{self.url}?{urllib.parse.urlencode(asked)}", headers=head)
        return urllib.request.Request(self.url, json.dumps(asked).encode(), head | {"Content-Type": "application/json"})

    def ask(self, asked: dict) -> tuple[str | None, str | None]:
        """(answer, None), or (None, why not) after every try has failed."""
        error = "not asked"
        for n in range(self.tries):
            if n:
                time.sleep(min(60, self.wait * 2 ** (n - 1)))
            try:
                with urllib.request.urlopen(self._request(asked), timeout=60) as answer:
                    return answer.read().decode("utf-8", "replace"), None
            except OSError as e:  # no connection, or a status of an error
                error = f"{type(e).__name__}: {e}"
        return None, error


def _parsed(payload: str) -> dict:
    try:
        found = json.loads(payload)
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def records(payload: str) -> list:
    found = _parsed(payload).get("results")
    return found if isinstance(found, list) else []


def has_more(payload: str) -> bool:
    """Whether an answer has records and says, or doesn't deny, that a page follows it."""
    told = _parsed(payload)
    following = (told.get("page_metadata") or {}).get("hasNext", told.get("has_next"))
    return bool(records(payload)) and following is not False


def total_of(payload: str) -> int | None:
    """How many records there are over all pages, if an answer says so."""
    told = _parsed(payload)
    for place in (told.get("meta"), told.get("page_metadata")):
        if isinstance(place, dict) and isinstance(place.get("total"), int):
            return place["total"]
    return None


class Pages(InputPartition):
    """Pages of one task; `first` is the answer to the first of them, if it is there already."""

    def __init__(self, offsets: range, first: str | None = None):
        self.offsets, self.first = offsets, first


class PagesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.body = json.loads(options.get("body", "{}"))
        self.size, self.most = int(options.get("pagesize", 500)), int(options.get("maxrecords", 10_000))
        self.by_page = options.get("paging", "offset") == "page"
        self.client = Client(options["url"], options.get("method", "POST").upper(), int(options.get("tries", 3)), float(options.get("wait", 2)), options.get("useragent", "ledgerlens"))
        self.interval, self.streams = float(options.get("interval", INTERVAL)), int(options.get("streams", 1))

    def partitions(self) -> list[Pages]:
        """`streams` tasks, each with every so-many-th page: requests a second are bounded by streams / interval.

        With several, the first page is asked for here: its total says which pages there are. Without
        a total the end is only known from the page before it, so one task follows the pages.
        """
        offsets = range(0, min(self.most, self.most if self.by_page else MAX_OFFSET + 1), self.size)
        if self.streams == 1 or len(offsets) < 2:
            return [Pages(offsets)]
        first, _ = self.client.ask(self._asked(0))
        total = total_of(first) if first else None
        if total is None:
            return [Pages(offsets, first)]
        offsets = offsets[: max(1, -(-total // self.size))]
        return [Pages(offsets[i :: self.streams], None if i else first) for i in range(min(self.streams, len(offsets)))]

    def _asked(self, offset: int) -> dict:
        return self.body | {"limit": self.size} | ({"page": offset // self.size + 1} if self.by_page else {"offset": offset})

    def read(self, partition: Pages) -> Iterator[tuple]:
        """(offset, payload); a page that fails every time gives no row. A page without results, or which says that none follows it, ends the task."""
        for k, offset in enumerate(partition.offsets):
            if k:
                time.sleep(self.interval)
            payload = partition.first if not k and partition.first is not None else self.client.ask(self._asked(offset))[0]
            if payload is None:
                continue
            yield from self.rows(offset, payload)
            if _parsed(payload) and not has_more(payload):
                return

    def rows(self, offset: int, payload: str) -> Iterator[tuple]:
        yield offset, payload


class PagesSource(DataSource):
    """spark.read.format("pages").option("url", ...).option("body", json): register with spark.dataSource.register(PagesSource).

    Options: method (POST, GET), paging (offset, page), pagesize, maxrecords, tries, wait, interval, streams, useragent.
    """

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "offset long, payload string"

    def reader(self, schema) -> PagesReader:
        return PagesReader(self.options)


def _day(value) -> dt.date | None:
    if isinstance(value, dt.date) or value is None:
        return value
    try:
        return dt.date.fromisoformat(str(value)[:10])
    except ValueError:
        return None


class AwardsReader(PagesReader):
    """Awards by agency and date: comparisons of these two columns become the body, so that the server leaves the others out."""

    def __init__(self, options: dict):
        super().__init__({"paging": "page", "pagesize": "100", **options})
        self.agencies: list[str] | None = None
        self.start = self.end = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        self.agencies = self.start = self.end = None  # of an earlier query over the same table
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column == "agency_name" and isinstance(f, EqualTo | In) and None not in (names := list(f.value) if isinstance(f, In) else [f.value]):
                self.agencies = names if self.agencies is None else [a for a in self.agencies if a in names]
            elif column == "action_date" and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and isinstance(f.value, dt.date):
                one = dt.timedelta(days=1)
                if not isinstance(f, LessThan | LessThanOrEqual):
                    low = f.value + one * isinstance(f, GreaterThan)
                    self.start = low if self.start is None else max(self.start, low)
                if not isinstance(f, GreaterThan | GreaterThanOrEqual):
                    high = f.value - one * isinstance(f, LessThan)
                    self.end = high if self.end is None else min(self.end, high)
            else:
                yield f

    def partitions(self) -> list[Pages]:
        nothing = self.agencies == [] or (self.start and self.end and self.start > self.end)
        return [Pages(range(0))] if nothing else super().partitions()

    def _asked(self, offset: int) -> dict:
        filters = dict(self.body.get("filters", {}))
        if self.agencies is not None:
            filters["agencies"] = [{"type": "awarding", "tier": "toptier", "name": a} for a in self.agencies]
        if self.start or self.end:
            filters["time_period"] = [{"start_date": self.start and self.start.isoformat(), "end_date": self.end and self.end.isoformat()}]
        return super()._asked(offset) | {"filters": filters}

    def rows(self, offset: int, payload: str) -> Iterator[tuple]:
        """A row for each award that the filters hold for, whatever the server makes of them."""
        for record in records(payload):
            agency, day = record.get("Awarding Agency"), _day(record.get("Start Date"))
            known = (self.agencies is None or agency in self.agencies) and (self.start is None or day and day >= self.start) and (self.end is None or day and day <= self.end)
            if known:
                yield agency, day, json.dumps({"results": [record]})


class AwardsSource(DataSource):
    """spark.read.format("award_pages"): agency_name, action_date and payload (one award, for tables.awards()).

    `where` on the two columns goes to the server: Spark asks for spark.sql.python.filterPushdown.enabled = true. It keeps what was pushed
    with the table that was loaded, so each filtered query must load() its own. The option body has what else is
    asked for, see requests.awards(); further options as of PagesSource.
    """

    @classmethod
    def name(cls) -> str:
        return "award_pages"

    def schema(self) -> str:
        return "agency_name string, action_date date, payload string"

    def reader(self, schema) -> AwardsReader:
        return AwardsReader(dict(self.options))
