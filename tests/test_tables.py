"""Files, the store, the daily run, the service and the command line, on folders of their own."""

from __future__ import annotations

import datetime as dt
import io
import json
import threading
import urllib.error
import urllib.request
import zipfile
from email.message import Message

import pytest
from pyspark.sql import functions as F

from barscreen import cli, web
from barscreen.config import Universe, load
from barscreen.plans import daily, report
from barscreen.sources.calendar import weekdays
from barscreen.sources.fetch import Fetcher, chunks
from barscreen.sources.files import ParseError, read_actions, read_bars
from barscreen.sources.store import Store, logged
from barscreen.streaming.ingest import follow

DAY = dt.date(2024, 3, 1)
UDIFF = "TradDt,TckrSymb,SctySrs,FinInstrmTp,ISIN,OpnPric,HghPric,LwPric,ClsPric,PrvsClsgPric,TtlTradgVol,TtlTrfVal,TtlNbOfTxsExctd"
LEGACY = "SYMBOL,SERIES,OPEN,HIGH,LOW,CLOSE,LAST,PREVCLOSE,TOTTRDQTY,TOTTRDVAL,TIMESTAMP,TOTALTRADES,ISIN,"


def udiff(*rows):
    return "\n".join([UDIFF, *rows]) + "\n"


ROWS = ("2024-03-01,AAA,EQ,STK,IN1,10,11,9,10.5,10,1000,10500.5,12", "2024-03-01,BBB,EQ,STK,IN2,20,-,19,20.5, ,2000,41000,")


def put(path, text):
    path.write_text(text)
    return str(path)


def test_both_layouts_give_the_same_bars(spark, tmp_path):
    a = read_bars(spark, put(tmp_path / "u.csv", udiff(*ROWS, "2024-03-01,CCC,BE,STK,IN3,1,1,1,1,1,1,1,1", "2024-03-01,DDD-RE,EQ,STK,IN4,1,1,1,1,1,1,1,1", "2024-03-01,EEE,EQ,IDX,IN5,1,1,1,1,1,1,1,1")), "udiff", Universe(), DAY)
    old = [LEGACY, "AAA,EQ,10,11,9,10.5,10.4,10,1000,10500.5,01-MAR-2024,12,IN1,", "BBB,EQ,20,-,19,20.5,20,,2000,41000,01-Mar-24,,IN2,"]
    b = read_bars(spark, put(tmp_path / "l.csv", "\n".join(old) + "\n"), "legacy", Universe(), DAY)
    one, two = (sorted(map(tuple, x.collect())) for x in (a, b))
    assert one == two and len(one) == 2
    assert one[1][5] is None and one[1][8] is None and one[1][11] is None


def test_zipped_files_and_doubtful_sessions(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.csv", udiff(*ROWS))
    assert read_bars(spark, str(tmp_path / "a.zip"), "udiff", Universe(), DAY).count() == 2
    with pytest.raises(ParseError, match="rows of 2024-03-01"):
        read_bars(spark, str(tmp_path / "a.zip"), "udiff", Universe(), dt.date(2024, 3, 4))
    with pytest.raises(ParseError, match="columns missing"):
        read_bars(spark, put(tmp_path / "m.csv", "TradDt,TckrSymb\n2024-03-01,A\n"), "udiff", Universe())
    with pytest.raises(ParseError, match="no rows"):
        read_bars(spark, put(tmp_path / "n.csv", udiff("2024-03-01,CCC,BE,STK,IN3,1,1,1,1,1,1,1,1")), "udiff", Universe())
    with pytest.raises(ParseError, match="can't be read"):
        read_bars(spark, put(tmp_path / "d.csv", LEGACY + "\nAAA,EQ,1,1,1,1,1,1,1,1,2020/07/13,1,I,\n"), "legacy", Universe())
    with pytest.raises(ParseError, match="no layout"):
        read_bars(spark, str(tmp_path / "m.csv"), "other", Universe())


def test_blank_closes_stay_and_short_rows_go(spark, tmp_path):
    rows = ("2024-03-01,AAA,EQ,STK,IN1,10,11,9,,10,1000,10500.5,12", "2024-03-01,BBB,EQ,STK,IN2,20,21,19", '2024-03-01,CCC,EQ,STK,"I,\nN",1,2,1,-,1,5,5')
    got = {r["symbol"]: r for r in read_bars(spark, put(tmp_path / "b.csv", udiff(*rows)), "udiff", Universe(), DAY).collect()}
    assert set(got) == {"AAA", "CCC"} and got["AAA"]["close"] is None and got["AAA"]["volume"] == 1000
    assert got["CCC"]["close"] is None and got["CCC"]["isin"] == "I,\nN" and got["CCC"]["trades"] is None


def test_the_last_of_repeated_actions_counts(spark, tmp_path):
    rows = [{"symbol": "AAA", "series": "EQ", "exDate": "16-Jun-2025", "subject": f"Bonus {k}:1", "isin": "I", "faceVal": "2"} for k in (4, 1)]
    store = Store(spark, str(tmp_path))
    actions = read_actions(spark, put(tmp_path / "a.json", json.dumps(rows)), Universe())
    same = actions.withColumn("subject", F.lit("Bonus"))
    store.add_actions(same)
    kept = store.table("corporate_actions").collect()
    assert len(kept) == 1 and kept[0]["adj_factor"] == 2.0


def test_action_files(spark, tmp_path):
    rows = [
        {"symbol": "AAA", "series": "EQ", "exDate": "16-Jun-2025", "subject": "Bonus 4:1", "isin": "I", "faceVal": "2"},
        {"symbol": "AAA", "series": "EQ", "exDate": "?", "subject": "Bonus 4:1", "isin": "I", "faceVal": "x"},
        {"symbol": "BBB", "series": "GB", "exDate": "16-Jun-2025", "subject": "Bonus 4:1"},
    ]
    (got,) = read_actions(spark, put(tmp_path / "a.json", json.dumps(rows)), Universe()).collect()
    assert (got["symbol"], got["ex_date"], got["adj_factor"], got["face_value"]) == ("AAA", dt.date(2025, 6, 16), 5.0, 2.0)
    assert read_actions(spark, put(tmp_path / "b.json", "<html>"), Universe()).count() == 0


def bars(spark, days, symbols=("AAA", "BBB"), close=10.0):
    rows = [(s, d, None, "EQ", close, close + 1, close - 1, close, close, 1000, close * 1000, 5) for d in days for s in symbols]
    return spark.createDataFrame(rows, "symbol string, trade_date date, isin string, series string, open double, high double, low double, close double, prev_close double, volume bigint, turnover double, trades bigint")


def test_a_session_is_replaced_and_its_neighbours_stay(spark, tmp_path):
    store, days = Store(spark, str(tmp_path)), [DAY, DAY + dt.timedelta(3)]
    for d in days:
        assert store.write_day(d, "udiff", bars(spark, [d])) == 2
    assert store.write_day(DAY, "udiff", bars(spark, [DAY], ("AAA",), 12.0)) == 1
    assert sorted((r["trade_date"], r["close"]) for r in store.prices().collect()) == [(DAY, 12.0), (days[1], 10.0), (days[1], 10.0)]
    store.mark(DAY + dt.timedelta(1), "pending")
    store.mark(DAY + dt.timedelta(2), "holiday")
    store.mark(DAY + dt.timedelta(4), "failed", note="x")
    assert store.settled_dates() == {*days, DAY + dt.timedelta(2)}
    assert report.recent_failures(store.table("ingest_log")).count() == 1
    with pytest.raises(report.HealthError, match="failed"):
        report.check_health(store.prices(), store.table("ingest_log"), store.table("corporate_actions"), days[1])


def test_thin_and_missing_sessions_are_refused(spark):
    log, actions = (spark.createDataFrame([], s) for s in ("trade_date date, status string", "symbol string, verification string"))
    days = [DAY - dt.timedelta(k) for k in range(1, 6)]
    prices = bars(spark, days, [f"S{k}" for k in range(10)]).unionByName(bars(spark, [DAY], ["S1"]))
    with pytest.raises(report.HealthError, match="not complete"):
        report.check_health(prices, log, actions, DAY)
    with pytest.raises(report.HealthError, match="no bars"):
        report.check_health(prices, log, actions, DAY + dt.timedelta(9))
    report.check_health(prices, log, actions, days[0])


class Reply(io.BytesIO):
    pass


def archive(day, n=3):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("x.csv", udiff(*(f"{day},S{k},EQ,STK,IN{k},10,11,9,{10 + k},10,1000,10500,12" for k in range(n))))
    return out.getvalue()


def fetcher(config, broken=()):
    calls = []

    def opener(request, timeout):
        url = request.full_url
        calls.append(url)
        day = next((d for d in (DAY, DAY + dt.timedelta(3), DAY + dt.timedelta(4)) if f"{d:%Y%m%d}" in url), None)
        if day in broken:
            return Reply(b"no archive")
        if day is None or day == DAY + dt.timedelta(3):
            raise urllib.error.HTTPError(url, 404, "", Message(), None)
        return Reply(archive(day))

    return Fetcher(config.ingest, opener, sleep=lambda s: None), calls


def test_gaps_are_filled_once(spark, tmp_path):
    config, store = load(), Store(spark, str(tmp_path / "s"))
    get, calls = fetcher(config, broken={DAY + dt.timedelta(4)})
    tally = daily.fill_gaps(store, config, get, DAY, DAY + dt.timedelta(4), today=DAY + dt.timedelta(30))
    assert (tally.stored, tally.rows, tally.holidays, tally.failed) == (1, 3, 1, 1)
    again, _ = fetcher(config)
    tally = daily.fill_gaps(store, config, again, DAY, DAY + dt.timedelta(4), today=DAY + dt.timedelta(30))
    assert (tally.skipped, tally.stored) == (2, 1)
    assert store.prices().count() == 6


def test_requests_are_retried_but_absences_are_not():
    config, seen = load(), []

    def opener(request, timeout):
        seen.append(1)
        raise urllib.error.HTTPError("u", 503 if len(seen) < 3 else 404, "", Message(), None)

    assert Fetcher(config.ingest, opener, sleep=lambda s: None).fetch("http://x").status == "not_found"
    assert len(seen) == 3
    assert list(chunks(DAY, DAY + dt.timedelta(70))) == [(DAY, DAY + dt.timedelta(59)), (DAY + dt.timedelta(60), DAY + dt.timedelta(70))]


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    store, config = Store(spark, str(tmp_path_factory.mktemp("store"))), load()
    days = [DAY + dt.timedelta(k) for k in range(230)]
    rows = [(s, d, None, "EQ", p, p * 1.01, p * 0.99, p, p, 100_000, p * 2e6, 5) for s, base, drift in (("UP", 100, 1.0), ("FLAT", 100, 0.01)) for k, d in enumerate(days) for p in [float(base + drift * k + (k % 7) * 0.1)]]
    schema = "symbol string, trade_date date, isin string, series string, open double, high double, low double, close double, prev_close double, volume bigint, turnover double, trades bigint"
    commit = store.stage(spark.createDataFrame(rows, schema))
    store.versions("ingest_log").append([logged(d, "ok", "udiff", 2, "", None, commit) for d in days])
    store.adjust(config.actions)
    assert store.rebuild_indicators(config.indicators) == 460
    return store, config, days


def test_shortlists_keep_their_columns_and_log_once(spark, filled):
    store, config, days = filled
    for preset in config.presets.values():
        found = report.shortlist(store.table("indicators"), store.table("quarantine"), preset, config.rules, 200, days[-1])
        assert tuple(found.columns) == report.SHORTLIST_COLUMNS
        assert found.count() <= 2
    one = store.table("indicators").filter(F.col("trade_date") == F.lit(days[-1])).withColumn("rank", F.lit(1)).select("rank", "symbol", "close")
    for _ in range(2):
        store.log_shortlist(one, "trend", days[-1])
    assert store.table("shortlist_log").count() == 2
    assert json.loads(store.table("shortlist_log").first()["payload"])["rank"] == 1


def test_positions_and_their_status(spark, filled):
    store, config, days = filled
    bar = {r["trade_date"]: r["close"] for r in store.table("indicators").filter("symbol = 'UP'").collect()}
    ids = [store.add_position("UP", days[100], bar[days[100]], 5), store.add_position("UP", days[-1], bar[days[-1]], 5), store.add_position("UP", days[100], bar[days[100]] * 10, 5)]
    status = {r["position_id"]: r for r in report.position_status(store.table("positions"), store.table("indicators"), config.rules, 50, days[-1]).collect()}
    assert status[ids[0]]["action"] == "EXIT: time stop" and status[ids[0]]["bars_held"] == 130
    assert status[ids[1]]["action"] == "HOLD" and status[ids[1]]["bars_held"] == 1
    assert status[ids[2]]["action"] == "EXIT: initial stop"
    assert store.close_position(ids[0], days[-1], 1.0) and not store.close_position(ids[0], days[-1], 2.0) and store.close_position(ids[0], days[-1], 2.0, again=True)
    assert report.closed_positions(store.table("positions")).first()["exit_price"] == 2.0
    assert store.delete_position(ids[2]) and not store.delete_position(ids[2])


def test_the_service(filled):
    store, config, days = filled
    server = web.server(store, config)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    root = f"http://127.0.0.1:{server.server_port}"

    def ask(path, body=None):
        request = urllib.request.Request(root + path, data=None if body is None else json.dumps(body).encode())
        try:
            with urllib.request.urlopen(request) as reply:
                return reply.status, json.load(reply)
        except urllib.error.HTTPError as error:
            return error.code, json.load(error)

    assert ask("/api/meta")[1]["symbols"] == 2
    assert len(ask("/api/dates?limit=5")[1]) == 5
    assert ask("/api/shortlist?preset=none")[0] == 400
    assert ask("/api/shortlist?preset=trend")[1]["columns"] == list(report.SHORTLIST_COLUMNS)
    assert [r["symbol"] for r in ask("/api/symbols?q=up")[1]] == ["UP"]
    assert len(ask("/api/symbol/UP?days=40")[1]["bars"]) == 40
    assert ask("/api/symbol/NONE")[0] == 404 and ask("/api/symbol/..%2F..")[0] == 400 and ask("/etc/passwd")[0] == 404
    good = {"symbol": "up", "entry_price": 10, "quantity": 1, "entry_date": str(days[50])}
    code, made = ask("/api/positions", good)
    assert code == 200
    for bad in ({"quantity": 0}, {"entry_price": "x"}, {"symbol": "a b"}, {"entry_date": "2001-01-01"}):
        assert ask("/api/positions", good | bad)[0] == 400
    assert ask("/api/positions/close", {"position_id": made["position_id"], "exit_price": 11})[0] == 200
    assert ask("/api/positions/close", {"position_id": made["position_id"], "exit_price": 11})[0] == 404
    assert ask("/api/positions/delete", {"position_id": made["position_id"]})[0] == 200
    assert set(ask("/api/positions")[1]) == {"as_of", "open", "closed"}
    server.shutdown()


def test_the_command_line(spark, filled, capsys):
    store, _, _ = filled
    for command in (["status"], ["position", "list"], ["screen", "--preset", "baseline"], ["backtest", "--preset", "baseline"], ["compact"]):
        assert cli.main(["--root", store.root, *command], spark) == 0
    assert "sessions" in capsys.readouterr().out
    assert cli.main(["--root", store.root, "position", "add"], spark) == 2


def test_streamed_files_are_stored_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    store = Store(spark, str(tmp_path / "s"))
    put(tmp_path / "in/a.csv", udiff(*ROWS))
    for _ in range(2):
        follow(store, str(tmp_path / "in"), "udiff", Universe(), str(tmp_path / "c")).awaitTermination()
    put(tmp_path / "in/b.csv", udiff("2024-03-04,AAA,EQ,STK,IN1,10,11,9,10.5,10,1000,10500.5,12"))
    follow(store, str(tmp_path / "in"), "udiff", Universe(), str(tmp_path / "c")).awaitTermination()
    assert store.prices().count() == 3 and len(store.settled_dates()) == 2


def test_weekdays_and_missing_files(spark, tmp_path):
    assert [r[0].day for r in weekdays(spark, "2024-03-01", "2024-03-05").orderBy("day").collect()] == [1, 4, 5]
    assert weekdays(spark, "2024-03-05", "2024-03-01").count() == 0
    store = Store(spark, str(tmp_path))
    assert [store.missing_file_status(DAY, DAY + dt.timedelta(k), 2) for k in (1, 2)] == ["pending", "holiday"]


def test_rendering(spark):
    df = spark.createDataFrame([("A", 1234.5, 7, None)], "s string, d double, n bigint, x double")
    assert "1,234.50" in daily.rendered(df) and daily.rendered(df).endswith("-")
    assert daily.rendered(df.limit(0)) == "  (none)"
