"""Control table, run log, the daily load, and the same on Structured Streaming."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from rows import HEADER, quote_line, values, write_zip

from quoteflow import audit, control
from quoteflow.operators import quality
from quoteflow.plans import serving
from quoteflow.plans.bronze import append_bronze, file_outcomes
from quoteflow.plans.daily import Tables, run_daily
from quoteflow.plans.gold import build_ema
from quoteflow.schema import CONTROL_SCHEMA
from quoteflow.streaming.dedup import dedup_into, dedup_stream, dedup_within
from quoteflow.streaming.ema import keyed_ema, running_ema
from quoteflow.streaming.ingest import ingest_files

DATES = [dt.date(2026, 9, d) for d in (1, 2, 3)]


def land(folder, date, *lines):
    write_zip(folder / f"quotes_{date:%Y%m%d}.zip", q__csv="\n".join([HEADER, *lines]) + "\n")


def land_day(folder, n, codes="ABC"):
    land(folder, DATES[n], *[quote_line(f"IN{c}", DATES[n], c, "EQ", 10 + n + ord(c) % 5, 10 + n) for c in codes])


def tables_for(database):
    return Tables(**{f: f"{database('db')}.{f}" for f in ("bronze", "rejects", "silver", "silver_rejects", "ema", "gold", "control", "runs", "checks", "catalog")})


def test_watermarks(spark, database):
    table = f"{database('c')}.state"
    assert control.get_watermark(spark, table, "silver", "q") is None
    control.create_control(spark, table)
    control.put_watermark(spark, table, "silver", "q", None)
    assert control.get_watermark(spark, table, "silver", "q") is None
    for date in (DATES[1], DATES[0]):  # the second is a step back
        control.put_watermark(spark, table, "silver", "q", date)
    control.put_watermark(spark, table, "bronze", "q", DATES[2])
    control.put_watermark(spark, table, "silver", "q", DATES[2], cycle="weekly")
    assert control.get_watermark(spark, table, "silver", "q") == DATES[1]
    assert values(control.watermarks(spark, table), *CONTROL_SCHEMA.names) == [
        ("bronze", "q", "daily", DATES[2]), ("silver", "q", "daily", DATES[1]), ("silver", "q", "weekly", DATES[2])]


def test_run_step_logs_success_and_failure(spark, database):
    table = f"{database('r')}.runs"
    assert audit.run_step(spark, table, "1", "a", lambda: {"rows_read": 3, "rows_written": 2})["rows_read"] == 3
    with pytest.raises(KeyError):
        audit.run_step(spark, table, "1", "b", lambda: {}["x"])
    assert values(spark.table(table), "step", "status", "rows_read", "rows_written", "error") == [
        ("a", "succeeded", 3, 2, None), ("b", "failed", None, None, "KeyError: 'x'")]


def test_append_bronze_twice_adds_nothing(spark, database):
    table, rejects = f"{database('b')}.q", f"{database('b')}.rejected"
    batch = spark.createDataFrame(
        [("I1", "2026-09-01", "EQ", "1"), ("I1", "2026-09-01", "BE", "2"), (None, "2026-09-01", "EQ", "3"),
         ("I2", None, "EQ", "4"), ("I2", None, "EQ", "4")],
        "ISIN string, BizDt string, SctySrs string, TtlTrfVal string")
    first = append_bronze(batch, table, rejects)
    assert first == {"rows_read": 5, "rows_written": 1}
    assert append_bronze(batch, table, rejects)["rows_written"] == 0
    assert values(spark.table(table), "ISIN", "BizDt", "SctySrs") == [("I1", "2026-09-01", "EQ")]
    assert spark.table(rejects).count() == 2


def test_append_bronze_without_rejects_is_null_safe(spark, database):
    table = f"{database('b')}.q"
    batch = spark.createDataFrame([(None, "2026-09-01", "EQ", "3"), ("I2", None, "EQ", "4")],
                                  "ISIN string, BizDt string, SctySrs string, TtlTrfVal string")
    assert append_bronze(batch, table)["rows_written"] == 2
    assert append_bronze(batch, table)["rows_written"] == 0
    assert spark.table(table).count() == 2


def snapshot_of(spark, names):
    gold = spark.table(names.gold).withColumn("mean", F.round("avg_pnl_percentage", 9))
    return values(gold, "ISIN", "stock_code", "business_date", "closing_price", "mean", "ema_7", "hash_key")


@pytest.mark.parametrize("incremental", [False, True])
def test_daily_load(spark, database, tmp_path, incremental):
    names = tables_for(database)
    land_day(tmp_path, 0)
    first = run_daily(spark, str(tmp_path), names, incremental=incremental)
    assert [first[s]["rows_written"] for s in ("bronze", "silver", "gold")] == [3, 3, 3]

    land_day(tmp_path, 1, "ABCD")
    land_day(tmp_path, 2, "AB")
    second = run_daily(spark, str(tmp_path), names, incremental=incremental)
    assert second["bronze"] == {"rows_read": 6, "rows_written": 6, "files": 2, "files_skipped": 0}
    assert spark.table(names.gold).count() == 9
    assert control.get_watermark(spark, names.control, *names.gold.split(".")) == DATES[2]
    assert values(spark.table(names.ema), "hash_key", "ema_7") == values(
        build_ema(spark.table(names.silver)), "hash_key", "ema_7")
    assert spark.table(names.runs).filter("status = 'succeeded'").count() == (8 if incremental else 10)
    assert spark.table(names.checks).filter("check = 'duplicate_rows' and findings = 0").count() == 2
    a = {r["business_date"]: r["ema_7"] for r in spark.table(names.gold).filter("stock_code = 'A'").collect()}
    assert a[DATES[1]] == 0.25 * 11.0 + 0.75 * 10.0

    # a file for a day already passed is left out and nothing changes, unless its day is asked for
    before = snapshot_of(spark, names)
    land(tmp_path, DATES[1], quote_line("INZ", DATES[1], "Z", "EQ", 5, 4))
    third = run_daily(spark, str(tmp_path), names, incremental=incremental)
    assert third["bronze"]["files"] == 0 and third["silver"]["rows_written"] == 0
    assert third["bronze"]["files_skipped"] == 1  # the file of that day has another time now
    log = file_outcomes(spark, f"{names.bronze}_files")
    assert values(log.filter("outcome = 'skipped'"), "file_name", "reason") == [
        ("quotes_20260902.zip", "dated 2026-09-02, loaded up to 2026-09-03")]
    assert run_daily(spark, str(tmp_path), names, incremental=incremental)["bronze"]["files_skipped"] == 0
    assert snapshot_of(spark, names) == before
    late = run_daily(spark, str(tmp_path), names, incremental=incremental, reprocess_dates=[DATES[1]])
    assert late["bronze"]["rows_written"] == 1 and late["silver"]["rows_written"] == 1
    assert values(file_outcomes(spark, f"{names.bronze}_files"), "outcome") == [("loaded",)] * 4
    assert spark.table(names.gold).filter("stock_code = 'Z'").count() == 1
    assert values(serving.stock_catalog(spark.table(names.catalog)), "stock_code", "isin") == values(
        serving.stock_catalog(spark.table(names.gold)), "stock_code", "isin") == [(c, f"IN{c}") for c in "ABCDZ"]
    assert not [t.name for t in spark.catalog.listTables(names.bronze.split(".")[0]) if "unpacked" in t.name]


def test_days_one_by_one_equal_all_at_once(spark, database, tmp_path):
    """Also: a gold load that breaks off after writing rows and state is repaired by the next."""
    from quoteflow.plans import incremental as module

    one, all_at_once = tmp_path / "one", tmp_path / "all"
    one.mkdir(), all_at_once.mkdir()
    a, b = tables_for(lambda x: database("x")), tables_for(lambda x: database("y"))
    for n in range(2):
        land_day(one, n)
        land_day(all_at_once, n)
    (one / "quotes_20260902.zip").rename(tmp_path / "later.zip")
    run_daily(spark, str(one), a, incremental=True)
    before = snapshot_of(spark, a)

    (tmp_path / "later.zip").rename(one / "quotes_20260902.zip")
    create_views, module._create_views = module._create_views, lambda *args: 1 / 0
    try:
        with pytest.raises(ZeroDivisionError):
            run_daily(spark, str(one), a, incremental=True)
    finally:
        module._create_views = create_views
    assert snapshot_of(spark, a) == before
    run_daily(spark, str(one), a, incremental=True)

    run_daily(spark, str(all_at_once), b)
    assert snapshot_of(spark, a) == snapshot_of(spark, b) and len(snapshot_of(spark, a)) == 6
    plan = spark.table(a.gold).select("stock_code", "ema_7")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan  # the average return is not asked for


def test_failing_load_stops_and_keeps_the_watermark(spark, database, tmp_path):
    names = tables_for(database)
    (tmp_path / "quotes_20260901.zip").write_bytes(b"broken")
    with pytest.raises(Exception):
        run_daily(spark, str(tmp_path), names)
    assert control.get_watermark(spark, names.control, *names.bronze.split(".")) is None
    assert values(spark.table(names.runs), "step", "status") == [("bronze", "failed")]


# --- streaming ---


def test_streamed_files_equal_the_batch_load(spark, database, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    names = tables_for(database)

    def ingest(**options):
        ingest_files(spark, str(landing), names.bronze, names.control, str(tmp_path / "checkpoint"),
                     names.rejects, files_per_batch=1, **options).awaitTermination()

    land_day(landing, 0)
    land_day(landing, 1)
    ingest()
    assert spark.table(names.bronze).count() == 6
    land_day(landing, 2)
    ingest()
    ingest()
    assert spark.table(names.bronze).count() == 9
    assert control.get_watermark(spark, names.control, *names.bronze.split(".")) == DATES[2]

    land(landing, dt.date(2026, 8, 1), quote_line("INZ", "2026-08-01", "Z", "EQ", 5, 4))
    ingest()
    assert spark.table(names.bronze).filter("ISIN = 'INZ'").count() == 0
    log = file_outcomes(spark, f"{names.bronze}_files")
    assert values(log, "file_name", "outcome")[0] == ("quotes_20260801.zip", "skipped") and log.count() == 4
    land(landing, dt.date(2026, 8, 2), quote_line("INZ", "2026-08-02", "Z", "EQ", 5, 4))
    ingest(late_files="reprocess")
    assert spark.table(names.bronze).filter("ISIN = 'INZ'").count() == 1


def feed(spark, folder, rows):
    spark.createDataFrame(rows, "k string, t timestamp, v double, i bigint").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema("k string, t timestamp, v double, i bigint").option(
        "maxFilesPerTrigger", 1).parquet(folder)


def at(minute):
    return dt.datetime(2026, 9, 1, 9, minute)


def test_running_averages_equal_the_batch_and_set_late_rows_aside(spark, tmp_path):
    from quoteflow.operators.ema import ema_series

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    columns = dict(group_col="k", target_col="t", value_col="v", row_id="i")
    batches = [[("a", at(1), 1.0, 1), ("a", at(3), 5.0, 2), ("b", at(1), 2.0, 3)],
               [("a", at(5), 9.0, 4), ("c", at(1), 7.0, 5)],
               [("b", at(6), 4.0, 6), ("a", at(6), None, 7)]]
    for rows in batches:
        running_ema(feed(spark, source, rows), out, **columns).awaitTermination()
    every = spark.createDataFrame([r for b in batches for r in b], "k string, t timestamp, v double, i bigint")
    got = spark.read.parquet(f"{out}/averages")
    assert values(got, "i", "ema_7") == values(ema_series(every, **columns), "i", "ema_7")

    running_ema(feed(spark, source, [("a", at(2), 3.0, 8), ("b", at(7), 8.0, 9)]), out, **columns).awaitTermination()
    assert [r["i"] for r in spark.read.parquet(f"{out}/late").collect()] == [8]
    got = {r["i"]: r["ema_7"] for r in spark.read.parquet(f"{out}/averages").collect()}
    assert 8 not in got and got[9] == 0.25 * 8.0 + 0.75 * (0.25 * 4.0 + 0.75 * 2.0)


def test_averages_in_the_state_store(spark, tmp_path):
    """Equal to the batch; a micro-batch updates the state of the series it touches; late and undated rows are marked."""
    from quoteflow.operators.ema import ema_series

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    columns = dict(group_col="k", target_col="t", value_col="v", row_id="i")
    batches = [[("a", at(1), 1.0, 1), ("a", at(3), 5.0, 2), ("b", at(1), 2.0, 3), (None, at(1), 2.0, 20)],
               [("a", at(5), 9.0, 4), ("c", at(1), None, 5), ("a", at(5), 8.0, 10)],
               [("b", at(6), 4.0, 6), ("b", at(7), None, 7), ("c", at(2), 3.0, 11)]]
    updated = []
    for rows in [*batches, [("a", at(2), 3.0, 8), ("b", at(8), 8.0, 9), ("b", None, 1.0, 12), ("c", at(2), 9.0, 13)]]:
        stream = keyed_ema(feed(spark, source, rows), **columns)
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
        updated.append(max(p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["numInputRows"]))
    assert updated == [2, 2, 2, 1]
    got = {r["i"]: (r["ema_7"], r["late"]) for r in spark.read.parquet(out).collect()}
    on_time = [r for b in batches for r in b] + [("b", at(8), 8.0, 9)]
    every = spark.createDataFrame(on_time, "k string, t timestamp, v double, i bigint")
    assert {r["i"]: (r["ema_7"], False) for r in ema_series(every, **columns).collect()} == {i: x for i, x in got.items() if i not in (8, 12, 13)}
    assert [got[i] for i in (8, 12, 13)] == [(None, True)] * 3


def test_snapshot_tables(spark, database, tmp_path):
    import json

    from quoteflow.plans.snapshot import load_snapshot

    (tmp_path / "p.json").write_text(json.dumps({"data": [{"symbol": "X", "change": 1, "meta": {"isin": "I"}}]}))
    bronze, clean = f"{database('s')}.raw", f"{database('s')}.clean"
    for _ in range(2):
        load_snapshot(spark, str(tmp_path / "p.json"), bronze, clean, "SYN")
    assert values(spark.table(clean), "stock_name", "ISIN", "source_system") == [("X", "I", "SYN")]
    assert "change" in spark.table(bronze).columns and "change" not in spark.table(clean).columns


def test_stream_dedup(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    feed(spark, source, [("a", at(1), 1.0, 1), ("a", at(1), 1.0, 1), ("b", at(2), 1.0, 2)])
    stream = feed(spark, source, [("a", at(3), 1.0, 1), ("c", at(3), 1.0, 3)])
    unique = dedup_stream(stream, ["i"], "t", "1 hour")
    unique.writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["i"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_stream_dedup_into_a_folder_keeps_late_keys(spark, tmp_path):
    """Unseen keys months behind the newest stay, copies go, in whatever batch; rows without a day are keys too."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [[("a", DATES[2]), ("a", DATES[2]), ("n", None)], [("b", dt.date(2026, 1, 5)), ("a", DATES[2])],
               [("b", dt.date(2026, 1, 5)), ("n", None), ("a", DATES[1])], [("c", None), ("a", DATES[1])]]
    for rows in batches:
        spark.createDataFrame(rows, "k string, d date").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("k string, d date").parquet(source)
        dedup_into(stream, out, ["k", "d"], "d").awaitTermination()
    got = [(r["k"], r["d"]) for r in spark.read.parquet(f"{out}/rows").collect()]
    assert len(got) == 5
    assert set(got) == {row for rows in batches for row in rows}


def test_stream_dedup_within_seven_days_loses_none(spark, database, tmp_path, monkeypatch):
    """Rows behind the watermark and rows without a time go aside; a batch that breaks off is done again without a trace."""
    from quoteflow.streaming import dedup as module

    source, table = str(tmp_path / "in"), f"{database('d')}.events"
    t = lambda day, hour=0: dt.datetime(2026, 9, day, hour)
    batches = [
        [("a", t(1), 1.0, 1), ("a", t(1, 5), 1.0, 2), ("b", t(2), 1.0, 3), ("n", None, 1.0, 4)],
        [("a", t(7), 1.0, 5), ("c", t(10), 1.0, 6), ("b", t(12), 1.0, 7)],
        [("a", t(4), 1.0, 8), ("b", t(5), 1.0, 9), ("d", t(6), 1.0, 10), ("c", t(9), 1.0, 11), (None, t(12), 1.0, 12)],
        [(None, t(13), 1.0, 13), ("a", t(14), 1.0, 14), ("a", t(20), 1.0, 15)],
    ]
    for n, rows in enumerate(batches):
        stream = feed(spark, source, rows)
        if n == 2:
            write = module.overwrite_partitions
            monkeypatch.setattr(module, "overwrite_partitions", lambda df, name, *a: 1 / 0 if name.endswith("_counts") else write(df, name, *a))
            with pytest.raises(Exception):
                dedup_within(stream, table, ["k"], "t").awaitTermination()
            monkeypatch.setattr(module, "overwrite_partitions", write)
            stream = spark.readStream.schema("k string, t timestamp, v double, i bigint").option("maxFilesPerTrigger", 1).parquet(source)
        dedup_within(stream, table, ["k"], "t").awaitTermination()
    assert sorted(r["i"] for r in spark.table(table).collect()) == [1, 3, 6, 9, 10, 12, 14]
    assert values(spark.table(f"{table}_late"), "i", "reason") == [(4, "undated"), (8, "late")]
    counts = spark.table(f"{table}_counts").orderBy("_batch").collect()
    assert [(r["rows"], r["kept"], r["repeats"], r["late"], r["undated"]) for r in counts] == [
        (4, 2, 1, 0, 1), (3, 1, 2, 0, 0), (5, 3, 1, 1, 0), (3, 1, 2, 0, 0)]


# --- quality ---


def test_type_profile(spark, database):
    from quoteflow.plans.silver import load_silver

    df = spark.createDataFrame(
        [("1", " 2.5 ", "2026-09-01", "x", None, "1"), ("-7", "1e3", "2026-02-30", "", " ", "9" * 19), (None, ".5", None, "1", None, "2.")],
        "a string, b string, c string, `d.e` string, f string, g string")
    assert values(quality.type_profile(df), "column_name", "filled", "as_bigint", "as_double", "as_date", "narrowest") == [
        ("a", 2, 2, 2, 0, "bigint"), ("b", 3, 0, 3, 0, "double"), ("c", 2, 0, 0, 1, "string"), ("d.e", 2, 1, 1, 0, "string"),
        ("f", 0, 0, 0, 0, "void"), ("g", 3, 1, 3, 0, "double")]
    assert quality.type_profile(df.limit(0)).filter("narrowest = 'void'").count() == 6
    assert values(quality.type_misfits(df, {"a": "bigint", "c": "date", "d.e": "double", "absent": "date", "b": "timestamp"}), "column_name", "misfits") == [
        ("a", 0), ("c", 1), ("d.e", 1)]

    raw, table = f"{database('t')}.raw", f"{database('t')}.quotes"
    append_bronze(raw_quotes(spark, ("A", str(DATES[0]), "EQ", "5"), ("B", str(DATES[0]), "EQ", "five")), raw)
    load_silver(spark, raw, table, f"{database('t')}.state", type_log=f"{table}_types")
    assert values(spark.table(f"{table}_types").filter("misfits > 0"), "column_name", "expected", "filled", "misfits", "narrowest") == [
        ("TtlTrfVal", "double", 2, 1, "string")]


def test_quality_checks(spark):
    df = spark.createDataFrame(
        [("A", DATES[0], "a", "n", 1.0, 2.0, 1.0, 1.5), ("A", DATES[0], "a", " ", 1.0, 1.0, 2.0, 1.5),
         ("A", DATES[2], None, None, 0.0, 2.0, 1.0, 3.0), ("B", DATES[1], "b", "n", 1.0, 2.0, 1.0, None)],
        "ISIN string, business_date date, stock_code string, stock_name string, open_price double, high_price double, "
        "low_price double, closing_price double")
    assert values(quality.duplicates(df), "ISIN", "business_date", "row_count") == [("A", DATES[0], 2)]
    assert tuple(quality.missing_codes(df).first()) == (4, 0, 1, 2)
    assert values(quality.invalid_prices(df), "problem", "row_count") == [
        ("close_missing", 1), ("close_outside_range", 2), ("high_below_low", 1), ("not_positive", 1)]
    assert values(quality.missing_dates(df), "ISIN", "gap_after", "gap_before", "missing_days") == [
        ("A", DATES[0], DATES[2], 1), ("B", None, DATES[1], 1), ("B", DATES[1], None, 1)]


def test_row_count_alarm(spark):
    days = spark.range(10).select(F.date_add(F.lit(DATES[0]), F.col("id").cast("int")).alias("business_date"), "id")
    rows = days.select("business_date", F.explode(F.sequence(F.lit(1), F.when(F.col("id") == 7, 2).otherwise(10))))
    alarms = quality.row_count_alarms(rows, days=5).filter("unexpected").collect()
    assert [(r["business_date"].day, r["row_count"]) for r in alarms] == [(8, 2)]


# --- the log of commits ---


def raw_quotes(spark, *rows):
    columns = ("ISIN", "BizDt", "TckrSymb", "SctySrs", "Src", "ClsPric", "PrvsClsgPric", "TtlTrfVal")
    return spark.createDataFrame([(i, d, i, s, "SYN", "11", "10", t) for i, d, s, t in rows], ", ".join(f"{c} string" for c in columns))


def test_silver_looks_at_every_commit_once(spark, database, monkeypatch):
    from quoteflow.plans import bronze as bronze_plans
    from quoteflow.plans import silver as silver_plans

    raw, table, state = f"{database('c')}.raw", f"{database('c')}.quotes", f"{database('c')}.state"
    load = lambda *again: silver_plans.load_silver(spark, raw, table, state, again)
    days = [str(d) for d in DATES]
    append_bronze(raw_quotes(spark, *[(k, d, "EQ", "5") for k in "AB" for d in days]), raw)
    assert load() == {"rows_read": 6, "rows_written": 6, "rows_incomplete": 0, "rows_late": 0}
    assert load() == {"rows_read": 0, "rows_written": 0, "rows_incomplete": 0, "rows_late": 0}

    # late rows, a row of another series, and one without a date, stamped long before silver last looked
    late = raw_quotes(spark, ("C", days[0], "EQ", "6"), ("D", days[0], "BE", "6"), ("E", None, "SM", "6")).withColumn("_ingested_at", F.lit("2001-01-01").cast("timestamp"))
    append_bronze(late, raw)
    dates = bronze_plans.unseen_commits(spark, raw, table)[1]
    assert sorted(dates, key=str) == [days[0], None]
    plan = silver_plans.dated(spark.table(raw), dates, [DATES[2]])._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "BizDt" in scan.split("PartitionFilters: [")[1].split("]")[0]
    assert {f.split("BizDt=")[1].split("/")[0] for f in silver_plans.dated(spark.table(raw), [days[0]], []).inputFiles()} == {days[0]}

    # a load that breaks off before it marks the commits is repeated whole, and rejects nothing twice
    mark = silver_plans.mark_seen
    monkeypatch.setattr(silver_plans, "mark_seen", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        load()
    monkeypatch.setattr(silver_plans, "mark_seen", mark)
    assert load() == {"rows_read": 0, "rows_written": 0, "rows_incomplete": 1, "rows_late": 1}
    assert values(spark.table(f"{table}_rejected"), "ISIN", "reason") == [("C", "late"), ("E", "incomplete")]
    assert load()["rows_late"] == 0
    assert load(DATES[0])["rows_written"] == 1 and spark.table(table).count() == 7
    # a date touched again: the row that was late is in silver now
    append_bronze(raw_quotes(spark, ("F", days[0], "SM", "6")), raw)
    assert load()["rows_late"] == 1
