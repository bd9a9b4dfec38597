import datetime as dt
import http.server
import json
import threading
import time
import urllib.parse

import pytest

from ledgerlens.sources import executor, requests, tables
from ledgerlens.sources.pages import AwardsSource, PagesReader, PagesSource
from ledgerlens.streaming import rollups

D = dt.date


def pages(spark, *payloads, **more):
    rows = [(*more.values(), json.dumps(p) if not isinstance(p, str) else p) for p in payloads]
    return spark.createDataFrame(rows, ", ".join([*(f"{k} string" for k in more), "payload string"]))


def test_nih(spark):
    r = {"appl_id": 7, "project_title": "T", "project_num": "VA1", "project_end_date": "2025-06-30T00:00:00", "award_amount": 5.0, "organization": {"org_name": "O", "org_state": "CA"}, "agency_ic_fundings": [], "ic_name": None}
    page = {"results": [r, r | {"appl_id": 8, "project_num": "X2", "agency_ic_fundings": [{"abbreviation": "NCI"}], "is_active": False}, r | {"project_num": "X3", "is_active": True, "ic_name": "N"}, r | {"appl_id": 9, "project_end_date": "2024-01-01"}]}
    got = {x.grant_number: x for x in tables.nih_notices(pages(spark, page, {"results": []}, "broken")).collect()}
    assert set(got) == {"VA1", "X2"} and got["VA1"].institute == "VA" and got["VA1"].notice_date == D(2025, 6, 30) and got["VA1"].source_url.endswith("/7")
    assert got["X2"].institute == "NCI" and tables.nih_notices(pages(spark, page), 1).count() == 1


def test_awards_and_others(spark):
    a = tables.awards(pages(spark, {"results": [{"Award ID": "A", "Award Amount": 5, "Start Date": "2025-01-02", "Description": "DESCRIPTION: <b>x</b>", "def_codes": ["L", "M"]}, {"Award ID": "B", "def_codes": []}]})).collect()
    assert (a[0].award_amount, a[0].action_date, a[0].description, a[0].def_codes) == (5.0, D(2025, 1, 2), "x", "L,M") and a[1].def_codes is None
    f = tables.file_c(pages(spark, {"results": [{"reporting_fiscal_year": 2025, "reporting_fiscal_month": 1, "gross_outlay_amount": 2.5}]}, grant_number="G")).first()
    assert (f.grant_number, f.reporting_date, f.outlay_amount, f.obligated_amount) == ("G", D(2024, 10, 1), 2.5, None)
    assert tables.file_c_if_available(pages(spark, "no json", grant_number="G")).count() == 0
    m = tables.spending_over_time(pages(spark, {"results": [{"time_period": {"fiscal_year": "2026", "month": "1"}, "Grant_Obligations": 0.0}, {"time_period": {"fiscal_year": "2026", "month": "2"}, "Grant_Obligations": None}]}, agency="X")).collect()
    assert [tuple(x) for x in m] == [("X", 2026, 1, 0.0), ("X", 2026, 2, None)]
    i = tables.subaward_impact(pages(spark, {"results": [{"award_id": "A"}]})).first()
    assert tuple(i) == ("A", None, None, None)
    b = tables.agency_obligations(pages(spark, {"agency_data_by_year": [{"fiscal_year": 2025, "agency_budgetary_resources": 10, "agency_obligation_by_period": [{"period": 1, "obligated": 5}]}, {"fiscal_year": 2026, "agency_obligation_by_period": []}]}, agency="X")).collect()
    assert [(x.fiscal_year, x.fiscal_period, x.obligation_rate) for x in b] == [(2025, 1, 0.5)]
    t = tables.transactions(pages(spark, {"results": [{"Award ID": "A", "Action Date": "2025-01-02", "Transaction Amount": -5, "Action Type": "E", "Mod": "3"}]})).first()
    assert (t.transaction_date, t.obligation_amount, t.action_type) == (D(2025, 1, 2), -5.0, "E")
    s = tables.subawards(pages(spark, {"results": [{"Sub-Award ID": "S", "Sub-Award Amount": 1.5, "Prime Award ID": "P"}]})).first()
    assert (s.subaward_id, s.subaward_amount, s.prime_award_id) == ("S", 1.5, "P")


def test_csv_files(spark, tmp_path):
    nsf = tmp_path / "nsf.csv"
    nsf.write_bytes('Award ID,Directorate,Recipient,Title,Obligated,,Date of export: 03/07/2025\n2301234,BIO,"Universit\xe9, X",T,"$1,200 ",,\n,,,,,,\n'.encode("latin-1"))
    rows = tables.nsf_notices(spark, str(nsf)).collect()
    assert [(r.grant_number, r.org_name, r.award_amount, r.notice_date) for r in rows] == [("2301234", "Université, X", 1200.0, None)]
    assert tables.export_date(spark, str(nsf)).first()[0] == D(2025, 3, 7)
    nih = tmp_path / "nih.csv"
    header = "core_award_number,status,ever_frozen,targeted_start_date,targeted_end_date,frozen_date,unfrozen_date,file_c_outlays,total_award,total_estimated_outlays,total_estimated_remaining,org_name,org_state,activity_code,reinstatement_indicator,last_payment_date,last_payment_month"
    nih.write_text(header + '\nR01,Frozen,TRUE,2025-03-01,,,,"- Dec 2024: $5\n- Jan 2025: $6",100,x,,Duke,NC,R01,,01/05/2025,\nR02,,,,,,,,,,,,,,,,\n')
    got = tables.nih_labels(spark, str(nih)).collect()
    assert got[0].ever_frozen and got[0].targeted_start_date == D(2025, 3, 1) and got[0].gw_total_award == 100 and got[0].gw_total_outlays is None and "\n" in got[0].file_c_outlays_raw and got[0].last_payment_date == D(2025, 1, 5)
    assert got[1].ever_frozen is False
    other = tmp_path / "o.csv"
    other.write_text("award_id,status,termination_date,reinstatement_date,usasp_outlaid,usasp_total_obligated,estimated_remaining,usasp_obligation_hist,directorate,division\n1,T,2025-04-01,,5,6,1,h,BIO,DEB\n")
    assert tables.nsf_labels(spark, str(other)).first().termination_date == D(2025, 4, 1)


def test_snapshot(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    path = f"{tmp_path}/s"
    assert tables.snapshot(spark, path, make).count() == 3 and tables.snapshot(spark, path, make).count() == 3 and len(calls) == 1


def test_pages_fail_without_rows():
    reader = PagesReader({"url": "http://127.0.0.1:9/none", "pagesize": "100", "maxrecords": "250", "tries": "2", "wait": "0", "interval": "0"})
    assert [list(p.offsets) for p in reader.partitions()] == [[0, 100, 200]]
    assert list(reader.read(reader.partitions()[0])) == []
    one = PagesReader({"url": "x", "maxrecords": "100000"}).partitions()
    assert len(one) == 1 and list(one[0].offsets) == list(range(0, 15_000, 500))  # the server's last offset
    assert len(PagesReader({"url": "x", "maxrecords": "100000", "paging": "page"}).partitions()[0].offsets) == 200


class Answers(http.server.BaseHTTPRequestHandler):
    """Three pages of records; the first request of every page fails."""

    seen: list = []

    def answer(self, asked: dict) -> None:
        Answers.seen.append((self.command, asked, self.headers["User-Agent"], time.time()))
        first = sum(a["page"] == asked["page"] for _, a, *_ in Answers.seen) == 1
        self.send_response(500 if first else 200)
        self.end_headers()
        n = int(asked["page"])
        self.wfile.write(json.dumps({"results": [{"award_id": f"{n}-{i}"} for i in range(2)] if n <= 2 else []}).encode())

    def do_GET(self):  # noqa: N802
        self.answer({k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query).items()})

    def do_POST(self):  # noqa: N802
        self.answer(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))

    def log_message(self, *args):
        pass


@pytest.mark.parametrize("method", ["GET", "POST"])
def test_pages_are_read_with_waits_and_retries(spark, method):
    Answers.seen = []
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(PagesSource)
    reader = spark.read.format("pages").option("url", f"http://127.0.0.1:{server.server_port}/x").option("method", method).option("paging", "page").option("pagesize", "2").option("maxrecords", "20")
    rows = reader.option("body", '{"fiscal_year": 2025}').option("wait", "0").option("interval", "0.2").option("useragent", "test").load().collect()
    server.shutdown()
    assert [r.offset for r in rows] == [0, 2, 4]  # the third is empty and the last
    assert sorted(r.award_id for r in tables.subaward_impact(spark.createDataFrame(rows)).collect()) == ["1-0", "1-1", "2-0", "2-1"]
    assert len(Answers.seen) == 6 and {(m, a, str(b["fiscal_year"])) for m, b, a, _ in Answers.seen} == {(method, "test", "2025")}
    times = [t for *_, t in Answers.seen]
    assert times[2] - times[1] >= 0.2


class Awards(http.server.BaseHTTPRequestHandler):
    """Answers by the body: pages of awards with a total or hasNext, pages of an award's periods; some fail."""

    seen: list = []
    told = "total"

    def do_POST(self):  # noqa: N802
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Awards.seen.append((asked, time.time()))
        number, page, size = asked.get("award_id", ""), asked.get("page", 1), asked["limit"]
        if number.startswith("ASST_NON_BAD"):
            self.send_response(503)
            self.end_headers()
            return
        if number:
            many = {"ASST_NON_LONG_049": 99, "ASST_NON_NONE_049": 0}.get(number, 2)
            answer = {"results": [{"reporting_fiscal_year": 2025, "reporting_fiscal_month": page, "gross_outlay_amount": 1.0}] if page <= many else [], "page_metadata": {"hasNext": page < many}}
        elif "award_ids" in asked.get("filters", {}):
            ids = asked["filters"]["award_ids"]
            answer = {"results": [{"Award ID": i, "Transaction Amount": 1.0, "Action Date": "2025-01-01"} for i in ids], "page_metadata": {"hasNext": False}}
        else:
            first = asked["offset"] if "offset" in asked else (page - 1) * size
            rows = [{"Award ID": f"A{i}", "Awarding Agency": f"Agency {i % 3}", "Start Date": f"2025-01-{1 + i % 28:02}"} for i in range(first, min(first + size, 70))]
            answer = {"results": rows} | ({"meta": {"total": 70}} if Awards.told == "total" else {"page_metadata": {"hasNext": first + size < 70}})
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(answer).encode())

    def log_message(self, *args):
        pass


@pytest.fixture
def awards_url():
    Awards.seen, Awards.told = [], "total"
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Awards)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/x"
    server.shutdown()


@pytest.mark.parametrize(("told", "streams"), [("total", 3), ("next", 3), ("next", 1)])
def test_no_request_beyond_the_last_page(spark, awards_url, told, streams):
    """Seven pages of ten: planned from the first answer's total, or followed while the answer says that there are more."""
    Awards.told = told
    spark.dataSource.register(PagesSource)
    rows = spark.read.format("pages").option("url", awards_url).option("pagesize", "10").option("streams", str(streams)).option("interval", "0").load()
    assert sorted(r.offset for r in rows.collect()) == list(range(0, 70, 10))
    asked = [a["offset"] for a, _ in Awards.seen]
    assert sorted(asked) == list(range(0, 70, 10))
    assert tables.awards(rows).count() == 70


def test_filters_reach_the_server(spark, awards_url):
    spark.dataSource.register(AwardsSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        load = spark.read.format("award_pages").option("url", awards_url).option("interval", "0").option("body", requests.awards([], None, None)).load
        asked = load().where("agency_name in ('Agency 0', 'Agency 1') and action_date >= date'2025-01-05' and action_date < date'2025-01-20' and length(payload) > 5")
        plan = asked._jdf.queryExecution().executedPlan().toString()
        rows = tables.awards(asked).collect()
        two = load().where("agency_name = 'Agency 2'").union(load().where("agency_name = 'Agency 1' and action_date = date'2025-01-02'"))
        assert two.count() == 23 + 1 and load().where("action_date > date'2026-01-01' and action_date < date'2025-01-01'").count() == 0
        assert load().where("agency_name is not null").count() == 70 and "agencies" not in Awards.seen[-1][0]["filters"]
        Awards.seen = [x for x in Awards.seen if len(x[0]["filters"].get("agencies", "")) == 2]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    filters = Awards.seen[-1][0]["filters"]
    assert [a["name"] for a in filters["agencies"]] == ["Agency 0", "Agency 1"] and filters["time_period"] == [{"start_date": "2025-01-05", "end_date": "2025-01-19"}]
    assert "award_type_codes" in filters
    # the columns are compared by the source alone; what it doesn't know stays a filter of Spark's
    assert "length(payload" in plan and "2025-01-20" not in plan.split("BatchScan")[0]
    expected = {f"A{i}" for i in range(70) if i % 3 < 2 and 5 <= 1 + i % 28 <= 19}
    assert {r.grant_number for r in rows} == expected and len(rows) == len(expected)


def test_requests_of_a_table(spark, awards_url):
    """Ids in, payloads out, five pages an award at most, one bound on the rate, failures named."""
    numbers = ["A", "B", "A", "LONG", "NONE", "BAD", None, "ELSE"]
    awards = spark.createDataFrame([(g, "Other" if g == "ELSE" else "National Science Foundation") for g in numbers], "grant_number string, agency_name string")
    periods, failed = executor.fetch_file_c(awards, awards_url, probe=False, streams=2, interval=0.05, tries=2, wait=0)
    got = {}
    for r in periods.collect():
        got.setdefault(r.grant_number, []).append(r.outlay_amount)
    assert {g: len(x) for g, x in got.items()} == {"A": 2, "B": 2, "LONG": 5}
    times = [t for _, t in Awards.seen]
    assert len(times) == 2 + 2 + 5 + 1 + 2 and times[-1] - times[0] >= 0.05 * (len(times) - 4)
    bad = failed.collect()
    assert [(r.grant_number, r.page) for r in bad] == [("BAD", 1)] and "503" in bad[0].error


def test_probe(spark, awards_url):
    plan = lambda g: spark.createDataFrame([(g, "National Science Foundation")], "grant_number string, agency_name string")
    quick = {"interval": 0, "tries": 1, "wait": 0}
    assert executor.available(requests.funding_requests(plan("A")), awards_url, **quick)
    for g in ("NONE", "BAD"):
        assert not executor.available(requests.funding_requests(plan(g)), awards_url, **quick)
        n = len(Awards.seen)
        assert executor.fetch_file_c(plan(g), awards_url, **quick)[0].count() == 0 and len(Awards.seen) == n + 1
    assert not executor.available(requests.funding_requests(plan("A")).limit(0), awards_url, **quick)
    assert executor.fetch_file_c(plan("A"), awards_url, **quick)[0].count() == 2


def test_one_bad_page_voids_no_other(spark):
    good = [{"results": [{"reporting_fiscal_year": 2025, "reporting_fiscal_month": 1, "gross_outlay_amount": 2.5}]}] * 20
    for bad in ("no json", {"results": []}, {"detail": "error"}):
        assert tables.file_c_if_available(pages(spark, bad, *good, grant_number="G")).count() == 20
    assert tables.file_c_if_available(pages(spark, "no json", {"results": []}, grant_number="G")).count() == 0


def test_batches_of_transactions(spark, awards_url):
    ids = spark.range(60).selectExpr("if(id % 7 = 0, null, cast(id % 50 as string)) grant_number")
    known = {str(i % 50) for i in range(60) if i % 7}
    rows, failed = executor.fetch_transactions(ids, awards_url, batch=10, interval=0)
    assert sorted(r.grant_number for r in rows.collect()) == sorted(known) and failed.count() == 0
    body = Awards.seen[0][0]
    assert body["sort"] == "Action Date" and body["filters"]["award_type_codes"] == list(requests.GRANT_TYPES) and set(body["fields"]) == set(requests.TRANSACTION_FIELDS)
    none, _ = executor.fetch_transactions(ids.limit(0), awards_url)
    assert none.count() == 0 and none.columns == rows.columns


def test_request_bodies(spark):
    body = json.loads(requests.awards(["Department of Health and Human Services"], "2024-10-01", "2025-09-30"))
    assert body["filters"]["agencies"][0]["name"].startswith("Department") and body["filters"]["time_period"] == [{"start_date": "2024-10-01", "end_date": "2025-09-30"}] and "Total Outlays" in body["fields"]
    assert json.loads(requests.transactions(["A", "B"]))["filters"]["award_ids"] == ["A", "B"]
    assert json.loads(requests.subawards(["X"], "a", "b"))["subawards"] is True
    awards = spark.createDataFrame([("A", "National Science Foundation"), ("A", "National Science Foundation"), ("B", "Other"), (None, "National Science Foundation")], "grant_number string, agency_name string")
    assert [tuple(r) for r in requests.funding_plan(awards).collect()] == [("A", "ASST_NON_A_049")]
    ids = spark.range(120).selectExpr("cast(id % 100 as string) grant_number")
    batches = requests.id_batches(ids, 10).collect()
    assert sorted(i for b in batches for i in b.ids) == sorted(map(str, range(100))) and len(batches) > 5


def test_streams(spark, tmp_path):
    ts = lambda d: dt.datetime(2025, 1, d, 12)
    spark.createDataFrame([("A", ts(1), -5.0, 2.0), ("B", ts(2), -7.0, None), ("A", ts(2), 3.0, 4.0)], "grant_number string, ts timestamp, obligation_amount double, outlay_amount double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    for name, f in (("months", rollups.deobligation_months), ("periods", rollups.period_outlays)):
        q = f(stream).writeStream.outputMode("complete").format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
    assert [tuple(r)[1:] for r in spark.table("months").collect()] == [(2, 2, -12.0)]
    assert sorted((r.grant_number, r.outlay_amount) for r in spark.table("periods").collect()) == [("A", 2.0), ("A", 4.0), ("B", 0.0)]
