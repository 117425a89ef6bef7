"""The store's promises: commits that appear whole, appends that don't rewrite, writers side by side, files by month."""

from __future__ import annotations

import datetime as dt
import json
import re
import threading
import urllib.request
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from barscreen import web
from barscreen.config import Universe, load
from barscreen.plans import daily
from barscreen.schemas import TABLES
from barscreen.sources.files import file_report, landed_at, parsed
from barscreen.sources.store import Store, logged
from barscreen.sources.versions import Lost, Versions

DAY = dt.date(2024, 3, 1)
BARS = "symbol string, trade_date date, isin string, series string, open double, high double, low double, close double, prev_close double, volume bigint, turnover double, trades bigint"
UDIFF = "TradDt,TckrSymb,SctySrs,FinInstrmTp,ISIN,OpnPric,HghPric,LwPric,ClsPric,PrvsClsgPric,TtlTradgVol,TtlTrfVal,TtlNbOfTxsExctd"
LEGACY = "SYMBOL,SERIES,OPEN,HIGH,LOW,CLOSE,LAST,PREVCLOSE,TOTTRDQTY,TOTTRDVAL,TIMESTAMP,TOTALTRADES,ISIN,"


def bars(spark, days, symbols=("AAA", "BBB"), close=10.0):
    rows = [(s, d, None, "EQ", close, close + 1, close - 1, close, close, 1000, close * 1000, 5) for d in days for s in symbols]
    return spark.createDataFrame(rows, BARS)


def put(path, text, encoding="utf-8"):
    path.write_text(text, encoding=encoding)
    return str(path)


def zipped(path, *texts):
    with zipfile.ZipFile(path, "w") as z:
        for k, text in enumerate(texts):
            z.writestr(f"{k}.csv", text)
    return str(path)


# -- files ------------------------------------------------------------------------------------------------------------


def shuffled(header, row, order):
    names, fields = header.split(","), row.split(",")
    return ",".join(names[k] for k in order), ",".join(fields[k] for k in order)


def many_files(folder):
    """Files of both layouts, each with an order of columns of its own, and what is wrong with some."""
    u = lambda day, s, close: f"{day},{s},EQ,STK,IN1,10,11,9,{close},10,1000,10500.5,12"
    head, row = shuffled(UDIFF, u("2024-03-04", "AAA", 7), [5, 4, 3, 2, 1, 0, 12, 11, 10, 9, 8, 7, 6])
    put(folder / "20240304.csv", f"﻿{head}\r\n\r\n{row}\r\n")
    zipped(folder / "20240305.csv.zip", f"{LEGACY}\nAAA,EQ,10,11,9,8,10.4,10,1000,10500.5,05-MAR-2024,12,IN1,\nBBB,EQ,1,2\n")
    put(folder / "20240306.csv", f'{UDIFF},"Note, long"\n{u("2024-03-06", "AAA", 9)},"a ""b"", c"\n"2024-03-06"," BBB ",EQ,STK,"I,2",1,1,1,-,,5,5,5,x\n')
    put(folder / "20240307.csv", f"{UDIFF}\n{u('2024-03-08', 'AAA', 9)}\n")
    put(folder / "20240311.csv", "\n \r\n")
    put(folder / "20240312.csv", f"{UDIFF.replace('ClsPric,', '')}\n{u('2024-03-12', 'AAA', 9)}\n")
    put(folder / "20240313.csv", f"{UDIFF}\n2024-03-13,AAA,BE,STK,I,1,1,1,1,1,1,1,1\n")
    (folder / "20240314.csv.zip").write_bytes(b"no archive")
    zipped(folder / "20240315.csv.zip", "a", "b")
    put(folder / "20240318.csv", f"{LEGACY}\nAAA,EQ,1,1,1,1,1,1,1,1,2024/03/18,1,I,\n")
    put(folder / "20240319.csv", "a,b\n1,2\n")
    return {4: 1, 5: 1, 6: 2}


PROBLEMS = {7: "has rows of 2024-03-08", 11: "is empty", 12: "udiff: columns missing: ClsPric", 13: "no rows are left", 14: "can't be read", 15: "found 2", 18: "1 dates can't be read", 19: "no known layout"}


def expected_of(spark, folder):
    name = F.element_at(F.split("path", "/"), -1)
    return landed_at(spark, str(folder)).withColumn("expected", F.to_date(F.substring(name, 1, 8), "yyyyMMdd"))


def test_many_files_of_both_layouts_in_one_job(spark, tmp_path):
    (tmp_path / "in").mkdir()
    good, store = many_files(tmp_path / "in"), Store(spark, str(tmp_path / "s"))
    report = {r["expected"].day: r for r in store.take_in(expected_of(spark, tmp_path / "in"), Universe())}
    assert {d: sum(r["stored"].values()) for d, r in report.items() if r["stored"]} == good
    assert set(report) == {*good, *PROBLEMS}
    for day, said in PROBLEMS.items():
        assert said in report[day]["problem"], day
    got = {(r["trade_date"].day, r["symbol"]): r for r in store.prices().collect()}
    assert {k: r["close"] for k, r in got.items()} == {(4, "AAA"): 7.0, (5, "AAA"): 8.0, (6, "AAA"): 9.0, (6, "BBB"): None}
    assert got[6, "BBB"]["isin"] == "I,2" and got[4, "AAA"]["turnover"] == 10500.5 and got[4, "AAA"]["volume"] == 1000
    log = {r["trade_date"].day: r["status"] for r in store.table("ingest_log").collect()}
    assert log == {**dict.fromkeys(good, "ok"), **dict.fromkeys(PROBLEMS, "failed")}
    assert store.table("rejects").count() == len(PROBLEMS) and store.versions("ingest_log").last() == 1
    assert store.files.names("staging") == [] and len(store.files.names("prices")) == 1


def test_of_two_files_for_a_day_the_last_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, close in (("b", 5), ("a", 6)):
        put(tmp_path / f"in/{name}.csv", f"{UDIFF}\n2024-03-04,AAA,EQ,STK,IN1,10,11,9,{close},10,1000,10500.5,12\n")
    files = landed_at(spark, str(tmp_path / "in")).withColumn("arrived", F.when(F.col("path").endswith("b.csv"), F.lit("2024-01-02")).otherwise(F.lit("2024-01-01")).cast("timestamp"))
    store = Store(spark, str(tmp_path / "s"))
    store.take_in(files, Universe())
    assert [r["close"] for r in store.prices().collect()] == [5.0]


def test_nothing_landed_or_nothing_fit(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in/a.csv", "x")
    store = Store(spark, str(tmp_path / "s"))
    files = landed_at(spark, str(tmp_path / "in"))
    assert store.take_in(files.limit(0), Universe()) == [] and store.prices().count() == 0
    (only,) = store.take_in(files, Universe())
    assert "no known layout" in only["problem"] and store.prices().count() == 0
    assert file_report(parsed(files.limit(0), Universe())).count() == 0


def test_a_failed_file_does_not_stop_a_batch_of_gaps(spark, tmp_path):
    config, store = load(), Store(spark, str(tmp_path))
    day = [DAY + dt.timedelta(k) for k in (0, 3, 4, 5)]
    for d in day[:3]:
        store.land(f"{d:%Y%m%d}.csv", f"{UDIFF}\n{d},AAA,EQ,STK,IN1,10,11,9,10,10,1000,10500.5,12\n".encode() if d != day[1] else b"bad")
    store.land(f"{day[3]:%Y%m%d}.csv", b"")
    assert daily.taken(store, config, [(f"{day[3]:%Y%m%d}.csv", day[3], "udiff")]) == [(day[3], "udiff", "the file is empty", 0)]
    taken = daily.taken(store, config, [(f"{d:%Y%m%d}.csv", d, "udiff") for d in day[:3]])
    assert [(d, n, bool(p)) for d, _, p, n in taken] == [(day[0], 1, False), (day[1], 0, True), (day[2], 1, False)]
    assert store.settled_dates() == {day[0], day[2]}
    plan = daily.gap_plan(store, config.ingest.sources_table(spark), DAY - dt.timedelta(1), DAY + dt.timedelta(6), DAY + dt.timedelta(6), 2)
    assert [(r["day"], r["absent"]) for r in plan.orderBy("day").collect()] == [(DAY - dt.timedelta(1), True), (day[1], True), (day[3], False), (DAY + dt.timedelta(6), False)]
    assert {r["day"]: r["source"] for r in plan.collect()} == {r["day"]: config.ingest.source_for(r["day"]).name for r in plan.collect()}


# -- commits ----------------------------------------------------------------------------------------------------------


def test_a_session_that_breaks_off_shows_no_bars(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    store.write_day(DAY, "udiff", bars(spark, [DAY]))
    monkeypatch.setattr(Versions, "append", lambda *a, **b: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        store.write_day(DAY, "udiff", bars(spark, [DAY], ("CCC",)))
    with pytest.raises(KeyboardInterrupt):
        store.write_day(DAY + dt.timedelta(3), "udiff", bars(spark, [DAY + dt.timedelta(3)]))
    monkeypatch.undo()
    assert len(store.files.names("prices")) == 3
    assert sorted(r["symbol"] for r in store.prices().collect()) == ["AAA", "BBB"] and store.settled_dates() == {DAY}
    store.compact_prices(grace=dt.timedelta(0))
    assert len(store.files.names("prices")) == 1 and store.prices().count() == 2


def test_a_failed_attempt_leaves_the_bars_of_before(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.write_day(DAY, "udiff", bars(spark, [DAY]))
    store.mark(DAY, "failed", note="x")
    assert store.prices().count() == 2 and store.settled_dates() == set()
    store.versions("ingest_log").fold()
    assert store.prices().count() == 2


def test_readers_that_have_begun_keep_their_bars(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for k in range(3):
        store.write_day(DAY + dt.timedelta(k), "udiff", bars(spark, [DAY + dt.timedelta(k)]))
    begun = store.prices()
    store.write_day(DAY, "udiff", bars(spark, [DAY], ("AAA",), 12.0))
    assert store.compact_prices() == 3
    assert begun.count() == 6 and store.prices().count() == 5
    assert len(store.files.names("prices")) == 5 and store.compact_prices() == 0
    store.compact_prices(grace=dt.timedelta(0))
    assert len(store.files.names("prices")) == 1 and store.prices().count() == 5


def test_sessions_written_while_prices_are_compacted_stay(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    days = [DAY + dt.timedelta(k) for k in range(3)]
    for d in days:
        store.write_day(d, "udiff", bars(spark, [d]))
    other, staged = Store(spark, store.root), store.stage

    def stage(rows, per_file=None):
        commit = staged(rows, per_file)
        monkeypatch.undo()
        other.write_day(days[0], "udiff", bars(spark, [days[0]], ("NEW",), 99.0))
        return commit

    monkeypatch.setattr(store, "stage", stage)
    assert store.compact_prices(grace=dt.timedelta(0)) == 2
    got = Counter((r["trade_date"], r["symbol"]) for r in store.prices().collect())
    assert got == Counter([(days[0], "NEW"), *((d, s) for d in days[1:] for s in ("AAA", "BBB"))])


def test_many_sessions_become_a_file_a_month(spark, tmp_path):
    store, days = Store(spark, str(tmp_path)), [d for d in (DAY + dt.timedelta(k) for k in range(420)) if d.weekday() < 5]
    for part in range(0, len(days), 60):  # several commits
        commit = store.stage(bars(spark, days[part : part + 60], [f"S{k:02}" for k in range(20)]))
        store.versions("ingest_log").append([logged(d, "ok", "udiff", 20, "", None, commit) for d in days[part : part + 60]])
    before = sorted(map(tuple, store.prices().collect()))
    months = len({(d.year, d.month) for d in days})
    assert store.compact_prices(grace=dt.timedelta(0)) == len(days)
    files = store.prices().inputFiles()
    assert len(files) == months and sorted(map(tuple, store.prices().collect())) == before
    commit = store.stage(store.prices(), bars_per_file=100)  # large months: files with ranges of symbols that don't overlap
    ranges = spark.read.parquet(f"{store.root}/prices/commit_id={commit}").groupBy("month", "slice").agg(F.min("symbol"), F.max("symbol"), F.count("*")).orderBy("month", "slice").collect()
    assert len(ranges) > 3 * months
    for a, b in zip(ranges, ranges[1:], strict=False):
        assert a[0] != b[0] or a[3] < b[2]
    some = store.prices(dt.date(2024, 5, 1), dt.date(2024, 5, 31))
    assert some.count() == 23 * 20 and re.search(r"PartitionFilters: \[[^]]*month#\d+ >= 2024-05", some._jdf.queryExecution().executedPlan().toString())


# -- versions ---------------------------------------------------------------------------------------------------------

SCHEMA = "k int, day date, at timestamp_ntz, x double, note string"


def test_appends_are_small_and_fold_now_and_then(spark, tmp_path):
    table = Versions(spark, f"{tmp_path}/t", SCHEMA, ("k",), fold=40)
    expected = {}
    for n in range(1, 121):
        expected[n % 50] = n
        table.append([{"k": n % 50, "day": DAY, "at": dt.datetime(2024, 1, 1, 2, 3, 4, 567), "x": n / 3, "note": f"é {n}"}])
    got = {r["k"]: r for r in table.read().collect()}
    assert {k: r["note"] for k, r in got.items()} == {k: f"é {n}" for k, n in expected.items()}
    assert got[20]["at"] == dt.datetime(2024, 1, 1, 2, 3, 4, 567) and got[20]["day"] == DAY and got[20]["x"] == 120 / 3
    assert len(table.files.names("data")) <= 3 and table.last() >= 122


def test_tables_of_rows_tombstones_and_order(spark, tmp_path):
    table = Versions(spark, f"{tmp_path}/t", SCHEMA, ("k",))
    assert table.read().count() == 0 and table.last() == 0
    rows = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, "x", 3), (None, "null key", 4)], "k int, note string, arrived int").repartition(4)
    table.append_table(rows)
    assert {(r["k"], r["note"]) for r in table.read().collect()} == {(1, "b"), (2, "x"), (None, "null key")}
    table.remove([{"k": 1}])
    table.append([{"k": 3, "note": None}])
    assert {r["k"] for r in table.read().collect()} == {2, 3, None}
    begun = table.read()
    assert table.fold() and begun.count() == 3
    assert table.fold() and {r["k"] for r in table.read().collect()} == {2, 3, None} and len(table.numbers()) == 2
    table.append([{"k": 1, "note": "again"}])
    assert table.read().count() == 4


def test_out_of_date_writers_lose(spark, tmp_path):
    table = Versions(spark, f"{tmp_path}/t", SCHEMA, ("k",))
    last, _ = table.snapshot()
    table.append([{"k": 1}], at=last + 1)
    with pytest.raises(Lost):
        table.append([{"k": 2}], at=last + 1)
    with pytest.raises(Lost):
        table.replace(spark.createDataFrame([(9, None, None, None, None)], SCHEMA), at=last + 1)
    assert [r["k"] for r in table.read().collect()] == [1]
    tries = []

    def change(found):
        tries.append(1)
        if len(tries) == 1:
            table.append([{"k": 5}])
        return found.withColumn("note", F.lit("changed"))

    table.update(change)
    assert len(tries) == 2 and {(r["k"], r["note"]) for r in table.read().collect()} == {(1, "changed"), (5, "changed")}


def test_appends_side_by_side_lose_nothing(spark, tmp_path):
    tables = [Versions(spark, f"{tmp_path}/t", SCHEMA, ("k",), fold=16) for _ in range(6)]
    threads = [threading.Thread(target=lambda n=n, t=t: [t.append([{"k": 10 * n + i}]) for i in range(10)]) for n, t in enumerate(tables)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(r["k"] for r in tables[0].read().collect()) == list(range(60))


def test_positions_posted_at_one_time_get_ids_of_their_own(spark, tmp_path):
    store, config = Store(spark, str(tmp_path)), load()
    store.replace("indicators", bars(spark, [DAY]))
    server = web.server(store, config)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    answers = []

    def post(k):
        body = json.dumps({"symbol": "AAA", "entry_price": 10 + k, "quantity": 1, "entry_date": str(DAY)}).encode()
        with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{server.server_port}/api/positions", data=body)) as reply:
            answers.append(json.load(reply)["position_id"])

    for first in range(0, 50, 10):
        threads = [threading.Thread(target=post, args=(k,)) for k in range(first, first + 10)]
        [t.start() for t in threads]
        [t.join() for t in threads]
    server.shutdown()
    held = store.table("positions").collect()
    assert sorted(answers) == list(range(1, 51)) == sorted(r["position_id"] for r in held)
    assert {r["entry_price"] for r in held} == {10.0 + k for k in range(50)}


def test_every_table_has_a_key():
    for schema, key in TABLES.values():
        assert key and set(key) <= {c.split()[0] for c in schema.split(", ")}


def test_one_symbol_is_one_file(spark, tmp_path, monkeypatch):
    store, config = Store(spark, str(tmp_path)), load()
    days = [DAY + dt.timedelta(k) for k in range(30)]
    commit = store.stage(bars(spark, days, [f"S{k:02}" for k in range(40)]))
    store.versions("ingest_log").append([logged(d, "ok", "udiff", 40, "", None, commit) for d in days])
    assert store.rebuild_indicators(config.indicators, bars_per_file=150) == 1200
    found = store.symbol_indicators("S07")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 30 and re.search(r"PartitionFilters: \[[^]]*bucket#", plan)
    assert found.select(F.input_file_name()).distinct().count() == 1
    columns = store.table("indicators").columns
    assert found.columns == columns and sorted(map(str, found.collect())) == sorted(map(str, store.table("indicators").filter("symbol = 'S07'").collect()))
    ranges = store.table("indicators").groupBy(F.input_file_name()).agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("b")).orderBy("a").collect()
    assert len(ranges) > 5 and all(x["b"] < y["a"] for x, y in zip(ranges, ranges[1:], strict=False))
    store.compact(grace=dt.timedelta(0))
    assert store.symbol_indicators("S07").count() == 30 and store.symbol_indicators("none").count() == 0
    store.replace("indicators", store.table("indicators"), files=1)  # without the other layout
    assert store.symbol_indicators("S07").count() == 30


def test_a_root_that_only_hadoop_reaches(spark, tmp_path):
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.bars.link./in", f"file://{tmp_path}")
    store = Store(spark, "viewfs://bars/in/s")
    assert store.files.local("x") is None
    for k in range(3):
        store.write_day(DAY + dt.timedelta(k), "udiff", bars(spark, [DAY + dt.timedelta(k)]))
    assert store.add_position("AAA", DAY, 1.0, 1) == 1 and store.add_position("BBB", DAY, 1.0, 1) == 2
    assert not store.versions("positions").files.publish("entries/000000000001.json", b"{}")
    name = store.land("20240306.csv", f"{UDIFF}\n2024-03-06,AAA,EQ,STK,IN1,10,11,9,10,10,1000,10500.5,12\n".encode())
    assert [r["stored"] for r in store.take_in(landed_at(spark, name), Universe())] == [{dt.date(2024, 3, 6): 1}]
    assert store.compact_prices(grace=dt.timedelta(0)) == 4 and len(store.files.names("prices")) == 1
    assert store.prices().count() == 7 and store.table("positions").count() == 2
    assert daily.write_csv(store.table("positions"), store.files, "held", DAY) == "viewfs://bars/in/s/held_2024-03-01.csv"
    assert (tmp_path / "s/held_2024-03-01.csv").read_text().startswith("position_id,")
