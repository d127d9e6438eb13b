from datetime import timedelta

import pytest
from tests.conftest import DAY0, UTC, bar, datetime, trend_bars
from pyspark.sql import functions as F

from barloom.functions.candles import SCHEMA
from barloom.operators import ingest, quality
from barloom.sources import files, store


def daily(n, start=0, change=None):
    out = []
    for i in range(start, start + n):
        o = 2500.0 + 2 * i
        close = o + 5 + (change or {}).get(i, 0)
        out.append((datetime(2026, 1, 1, 9, 15, tzinfo=UTC) + timedelta(days=i), o, o + 15, o - 10, close, 100000.0 + 1000 * i))
    return out


def csv(tmp_path, rows, name="x.csv", header="timestamp,open,high,low,close,volume"):
    path = tmp_path / name
    path.write_text(header + "\n" + "\n".join(",".join(x.isoformat() if hasattr(x, "isoformat") else str(x) for x in r) for r in rows))
    return str(path)


def read(spark, path, zone=None):
    return files.read_csv(spark, path, "abc ", "nse", "1D", zone)


def run(spark, tmp_path, rows, where="s", **more):
    return ingest.ingest(read(spark, csv(tmp_path, rows)), f"file://{tmp_path}/{where}", **more)


def only(result):
    return result.summary.first()


def test_headers(spark, tmp_path):
    df = read(spark, csv(tmp_path, daily(2), header=' Timestamp , OPEN, High,"Low ",close,Vol'))
    assert df.where(F.size("errors") == 0).count() == 2 and df.first()["symbol"] == "ABC" and df.first()["timeframe"] == "1d"
    with pytest.raises(ValueError, match="volume"):
        files.read_csv(spark, csv(tmp_path, [(1, 2, 3, 4, 5)], "y.csv", "timestamp,open,high,low,close"), "a", "b", "1d")


@pytest.mark.parametrize(
    "text,zone,want",
    [
        ("2026-01-01T09:15:00Z", None, "2026-01-01 09:15:00"),
        ("2026-01-01 09:15:00", None, None),
        ("2026-01-01 09:15:00", "Asia/Kolkata", "2026-01-01 03:45:00"),
        ("2026-01-01T09:15:00+05:30", None, "2026-01-01 03:45:00"),
        ("2026-01-01", None, None),
        ("2026-01-01", "UTC", "2026-01-01 00:00:00"),
        ("2026-03-08 02:30:00", "America/New_York", "2026-03-08 07:30:00"),
        ("2025-11-02 01:30:00", "America/New_York", "2025-11-02 05:30:00"),
        ("nonsense", "UTC", None),
    ],
)
def test_timestamps(spark, text, zone, want):
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(F.date_format(files.norm_timestamp("t", df.schema["t"].dataType, zone), "yyyy-MM-dd HH:mm:ss").alias("t")).first()["t"]
    assert got == want


@pytest.mark.parametrize("raw,want", [(" 1.5 ", 1.5), ("NaN", None), ("Infinity", None), ("-inf", None), ("x", None), ("", None)])
def test_numbers(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "v string").select(files.norm_number("v").alias("v")).first()["v"] == want


def test_success_and_idempotence(spark, tmp_path):
    r = run(spark, tmp_path, daily(10))
    assert r.status == "SUCCESS" and only(r)["records_written"] == 10
    r = run(spark, tmp_path, daily(10))
    assert (only(r)["records_written"], only(r)["records_skipped"], only(r)["duplicates"]) == (0, 10, 10)
    assert store.read_candles(spark, f"file://{tmp_path}/s").count() == 10


def test_batch_duplicate_and_conflict(spark, tmp_path):
    r = run(spark, tmp_path, [daily(1)[0]] * 2)
    assert (only(r)["records_read"], only(r)["records_written"], only(r)["duplicates"]) == (2, 1, 1)
    r = run(spark, tmp_path, daily(1) + daily(1, change={0: 10}), "t")
    assert r.status == "FAILED" and (only(r)["records_written"], only(r)["conflicts"], only(r)["records_valid"]) == (0, 1, 0)
    assert store.read_candles(spark, f"file://{tmp_path}/t").count() == 0


def test_store_conflict_keeps_the_store(spark, tmp_path):
    run(spark, tmp_path, daily(5))
    r = run(spark, tmp_path, daily(10, change={3: 1e-10}))
    assert r.status == "FAILED" and r.written == 0 and store.read_candles(spark, f"file://{tmp_path}/s").count() == 5


def test_incremental_and_range(spark, tmp_path):
    assert run(spark, tmp_path, daily(15)).written == 15
    r = run(spark, tmp_path, daily(20, 10))
    assert r.written == 15 and only(r)["records_skipped"] == 5 and store.read_candles(spark, f"file://{tmp_path}/s").count() == 30
    rows = daily(30)
    assert run(spark, tmp_path, rows, "r", start=rows[5][0], end=rows[14][0]).written == 10


def test_a_bad_row_outside_the_window_fails(spark, tmp_path):
    rows = daily(10)
    rows[9] = (*rows[9][:4], "NaN", rows[9][5])
    r = run(spark, tmp_path, rows, end=rows[4][0])
    assert r.status == "FAILED" and r.written == 0 and only(r)["validation_failures"] >= 1


def test_series_scope(spark, tmp_path):
    a, b = trend_bars(spark, 5), trend_bars(spark, 5, symbol="BBB")
    rows = files.parsed(a.unionByName(b.withColumn("close", F.lit(-1.0))).withColumn("seq", F.monotonically_increasing_id()), None)
    assert ingest.ingest(rows, f"file://{tmp_path}/a").written == 0
    assert ingest.ingest(rows, f"file://{tmp_path}/b", scope="series").written == 5


def test_store_reads_and_drops(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    a, b = trend_bars(spark, 5), trend_bars(spark, 7, symbol="BBB")
    assert store.write(a.unionByName(b), path) == 12 and store.write(a, path) == 0
    assert store.read_candles(spark, path, ["bbb"], "xnse", "1D").count() == 7
    assert store.read_candles(spark, path, start=DAY0 + timedelta(days=5)).count() == 2
    plan = store.read_candles(spark, path, ["BBB"], "XNSE")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(exchange" in plan and "PushedFilters: [In" in plan or "EqualTo(symbol" in plan
    with pytest.raises(ValueError):
        store.write(a.withColumn("close", F.col("close") + 1), path)
    assert store.read_candles(spark, path).count() == 12
    keys = spark.createDataFrame([("AAA", "XNSE", "1d")], "symbol string, exchange string, timeframe string")
    assert store.drop_series(spark, path, keys) and not store.drop_series(spark, path, keys)
    assert [(r["symbol"], r["record_count"]) for r in store.store_catalog(spark, path).collect()] == [("BBB", 7)]
    assert store.read_candles(spark, f"file://{tmp_path}/none").count() == 0


def test_write_validates(spark, tmp_path):
    path, a = f"file://{tmp_path}/s", trend_bars(spark, 5)
    for bad in (a.withColumn("close", F.lit(-1.0)), a.withColumn("volume", F.lit(float("nan"))), a.withColumn("high", F.lit(1.0)), a.withColumn("symbol", F.lit(" "))):
        with pytest.raises(ValueError, match="rules"):
            store.write(bad, path)
    assert store.read_candles(spark, path).count() == 0 and store.write(a, path) == 5


def test_no_lost_updates(spark, tmp_path):
    """A writer whose list is outdated commits nothing; what the other one added stays."""
    path, a, b = f"file://{tmp_path}/s", trend_bars(spark, 5), trend_bars(spark, 7, symbol="BBB")
    store.write(a, path)
    seen = store.committed(spark, path)
    store.write(b, path)
    with pytest.raises(store.StoreChanged):
        store.append(trend_bars(spark, 3, symbol="CCC"), path, seen=seen)
    assert {r["symbol"] for r in store.read_candles(spark, path).collect()} == {"AAA", "BBB"}
    assert store.write(trend_bars(spark, 3, symbol="CCC"), path) == 3


def test_many_batches_are_one_scan(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    for i in range(4):
        store.write(trend_bars(spark, 4, symbol=f"S{i}"), path)
    df = store.read_candles(spark, path)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Union" not in plan and df.count() == 16
    before = sorted(map(tuple, df.collect()))
    assert store.compact(spark, path) and len(store.batches(spark, path)) == 1 and store.compact(spark, path) is None
    assert sorted(map(tuple, store.read_candles(spark, path).collect())) == before and store.vacuum(spark, path) == 4
    assert store.write(trend_bars(spark, 4, symbol="S2"), path) == 0 and store.vacuum(spark, path) == 0


def test_catalog_status(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    store.write(trend_bars(spark, 5).unionByName(trend_bars(spark, 9, symbol="BBB").where("dayofmonth(timestamp) <> 4")), path)
    got = {r["symbol"]: r for r in store.store_catalog(spark, path).collect()}
    assert got["AAA"]["validation_status"] == "VALID" and got["BBB"]["validation_status"] == "WARNING" and got["AAA"]["ingested_at"] is not None
    assert store.dataset_catalog(trend_bars(spark, 3).withColumn("low", F.lit(-1.0))).first()["validation_status"] == "INVALID"


def test_error_texts_name_values(spark, tmp_path):
    rows = daily(2)
    rows[1] = (*rows[1][:4], "twelve", rows[1][5])
    assert [r["errors"] for r in read(spark, csv(tmp_path, rows)).orderBy("seq").collect()] == [[], ["bad close: twelve"]]


def test_duplicates_gaps_staleness(spark):
    at = lambda m: datetime(2026, 1, 1, 10, m, tzinfo=UTC)
    df = spark.createDataFrame([(*bar(t, 10, timeframe="5m"), i) for i, t in enumerate([at(0), at(5), at(0)])], SCHEMA.simpleString()[7:-1].replace(":", " ") + ", seq long")
    d = quality.detect_duplicates(df).collect()
    assert [(r["first_seq"], r["duplicate_seq"]) for r in d] == [(0, 2)]
    assert quality.check_ordering(df).count() == 1
    gaps = quality.detect_gaps(spark.createDataFrame([bar(t, 10, timeframe="5m") for t in (at(0), at(5), at(20))], SCHEMA))
    assert [(r["gap_start"].minute, r["gap_end"].minute) for r in gaps.collect()] == [(5, 20)]
    assert quality.detect_gaps(df, seconds=0).count() == 0
    fresh = spark.createDataFrame([bar(at(0), 10)], SCHEMA)
    got = [quality.check_staleness(fresh, at(m), 300).first()["status"] for m in (2, 5, 10)]
    assert got == ["FRESH", "FRESH", "STALE"]
    assert quality.check_staleness(fresh, at(0) - timedelta(minutes=1), 300).first()["status"] == "FUTURE"
    with pytest.raises(ValueError):
        quality.check_staleness(fresh, datetime(2026, 1, 1), 300)


def test_quality_and_coverage(spark):
    df = trend_bars(spark, 10).withColumn("seq", F.monotonically_increasing_id())
    ask = spark.createDataFrame([("AAA", "XNSE", "1d"), ("ZZZ", "XNSE", "1d")], "symbol string, exchange string, timeframe string")
    got = {r["symbol"]: r["status"] for r in quality.quality_report(df, requested=ask).collect()}
    assert got == {"AAA": "VALID", "ZZZ": "INSUFFICIENT_DATA"}
    assert quality.quality_report(df.where("seq % 3 <> 1")).first()["status"] in ("WARNING", "VALID")
    holes = df.where(~F.dayofmonth("timestamp").isin(6, 7, 8))
    assert quality.quality_report(holes).first()["status"] == "WARNING"
    assert quality.quality_report(holes, now=datetime(2027, 1, 1, tzinfo=UTC), allowed_seconds=60).first()["status"] == "STALE"
    c = quality.coverage_report(holes).first()
    assert (c["record_count"], c["potential_gap_count"], len(c["gap_details"])) == (7, 1, 1)


def test_strict_contract(spark):
    good = trend_bars(spark, 5)
    assert quality.validate_series_strict(good) is good
    for bad in (good.unionByName(good), good.withColumn("close", F.lit(float("nan"))), good.withColumn("high", F.lit(0.0)), good.withColumn("volume", F.lit(-1.0)), good.where("false")):
        with pytest.raises(ValueError):
            quality.validate_series_strict(bad)


def test_row_validators(spark):
    assert quality.validate_candles(trend_bars(spark, 1).withColumn("symbol", F.lit(" "))).first()["errors"] == ["Symbol cannot be empty"]
    q = spark.createDataFrame([("A", "X", DAY0, 10.0, 11.0, 10.5, 1.0, None, 0.0)], "symbol string, exchange string, timestamp timestamp, last_price double, bid double, ask double, bid_qty double, ask_qty double, volume double")
    assert quality.validate_quotes(q).first()["errors"] == ["bid above ask"]
    t = spark.createDataFrame([("A", "X", DAY0, 0.0, 1.0, 1.0)], "symbol string, exchange string, timestamp timestamp, last_price double, last_quantity double, total_volume double")
    assert not quality.validate_ticks(t).first()["is_valid"]
    i = spark.createDataFrame([("A", "X", None, 0.05), ("A", "X", 0, None)], "symbol string, exchange string, lot_size int, tick_size double")
    assert [r["is_valid"] for r in quality.validate_instruments(i).collect()] == [True, False]


def test_filter_range_checks(spark):
    df = trend_bars(spark, 3)
    with pytest.raises(ValueError):
        files.filter_range(df, datetime(2026, 1, 1))
    with pytest.raises(ValueError):
        files.filter_range(df, DAY0 + timedelta(days=1), DAY0)


def days(spark, *numbers, symbol="AAA"):
    return spark.createDataFrame([bar(DAY0 + timedelta(days=n), 100.0 + n, symbol=symbol) for n in numbers], SCHEMA)


def test_batches_of_one_name_are_all_kept(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    assert store.write(days(spark, 1, 2), path, name="b") == 2
    assert store.write(days(spark, 3), path, name="b") == 1 and store.read_candles(spark, path).count() == 3
    assert store.write(days(spark, 2, 1), path, name="b") == 0 and len(store.batches(spark, path)) == 2
    keys = spark.createDataFrame([("AAA", "XNSE", "1d")], "symbol string, exchange string, timeframe string")
    assert store.drop_series(spark, path, keys)
    assert store.write(days(spark, 1, 2), path, name="b") == 0 and store.read_candles(spark, path).count() == 0  # a replay brings nothing back
    assert store.write(days(spark, 1, 2), path) == 2


def test_a_known_batch_is_not_written_again(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    assert store.append(days(spark, 1), path, store.Batch("q", 4)) and store.append(days(spark, 2), path, store.Batch("q", 5))
    assert store.append(days(spark, 3), path, store.Batch("q", 5)) is None and store.append(days(spark, 3), path, store.Batch("q", 4)) is None
    assert store.append(days(spark, 3), path, store.Batch("p", 0))
    assert store.committed(spark, path).writers == {"q": 5, "p": 0} and store.read_candles(spark, path).count() == 3
    assert store.compact(spark, path) and store.committed(spark, path).writers == {"q": 5, "p": 0}
    assert store.append(days(spark, 9), path, store.Batch("q", 5)) is None


def test_a_replayed_ingestion_is_skipped(spark, tmp_path):
    first = run(spark, tmp_path, daily(4), batch="jan")
    assert (first.status, first.written) == ("SUCCESS", 4)
    again = run(spark, tmp_path, daily(4), batch="jan")
    assert (again.status, again.written, again.summary.count()) == ("SKIPPED", 0, 0)
    assert run(spark, tmp_path, daily(6), batch="jan").written == 2


def test_a_failed_attempt_leaves_no_candles(spark, tmp_path):
    """The folder of an attempt that never committed isn't read, and the next attempt has a folder of its own."""
    path = f"file://{tmp_path}/s"
    store._laid_out(days(spark, 1, 2).withColumn("ingested_at", F.current_timestamp()), f"{path}/batch=lost")
    assert store.read_candles(spark, path).count() == 0 and store.write(days(spark, 1, 2), path, name="b") == 2
    assert store.read_candles(spark, path).count() == 2 and store.vacuum(spark, path) == 1


def test_lists_without_writers_are_read(spark, tmp_path):
    import json

    path = f"file://{tmp_path}/s"
    store.write(days(spark, 1), path)
    (tmp_path / "s" / "batches-0000000002.json").write_text(json.dumps(store.batches(spark, path)))
    assert store.committed(spark, path).writers == {} and store.write(days(spark, 2), path, name="b") == 1 and store.read_candles(spark, path).count() == 2


@pytest.mark.parametrize("bucket", [3600, 86_400, 864_000])
def test_windows_against_brute_force(spark, bucket):
    import random

    rng = random.Random(bucket)
    hour = lambda h: DAY0 + timedelta(hours=h)
    stamps = {s: sorted({rng.randrange(2000) for _ in range(n)}) for s, n in (("A", 40), ("B", 3), ("C", 0))}
    candles = spark.createDataFrame([bar(hour(h), 10, symbol=s) for s, hs in stamps.items() for h in hs] or [], SCHEMA)
    asked = [(i, rng.choice("ABCD"), *(None if rng.random() < 0.25 else rng.randrange(-50, 2050) for _ in range(2))) for i in range(400)] + [(400, "A", 9, 9), (401, "A", stamps["A"][0], stamps["A"][0])]
    df = spark.createDataFrame([(i, s, "XNSE", "1d", None if a is None else hour(a), None if b is None else hour(b)) for i, s, a, b in asked], "i int, symbol string, exchange string, timeframe string, start timestamp, end timestamp")
    got = {r["i"]: r["has_data"] for r in store.has_data(df, candles, bucket).collect()}
    assert got == {i: any((a is None or h >= a) and (b is None or h <= b) for h in stamps.get(s, [])) for i, s, a, b in asked}
    only_end = {r["i"]: r["has_data"] for r in store.has_data(df.drop("start"), candles, bucket).collect()}
    assert only_end == {i: any(b is None or h <= b for h in stamps.get(s, [])) for i, s, a, b in asked}


def test_has_data_looks_at_asked_series_only(spark):
    df = spark.createDataFrame([("AAA", "XNSE", "1d")], "symbol string, exchange string, timeframe string")
    plan = store.has_data(df, days(spark, 1, 2))._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and [r["has_data"] for r in store.has_data(df, days(spark, 1, 2)).collect()] == [True]
    assert [r["has_data"] for r in store.has_data(df, days(spark, 1, symbol="Z")).collect()] == [False]


def test_row_numbers_over_files_and_splits(spark, tmp_path):
    """Every row of three files has its number in its file, however the files are split."""
    folder = tmp_path / "many"
    folder.mkdir()
    for f, n in (("a", 700), ("b", 5), ("c", 1500)):
        (folder / f"{f}.csv").write_text("timestamp,open,high,low,close,volume\n" + "".join(f"2026-01-01T00:00:00Z,1,1,1,1,{i if i % 100 else 'none'}\n" + "\n" * (i == 3) for i in range(1, n + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        rows = files.read_csv(spark, f"file://{folder}", "abc", "nse", "1d")
        assert rows.select(F.spark_partition_id()).distinct().count() > 1
        assert rows.where("volume is not null and volume <> row").count() == 0 and rows.count() == 2205
        texts = {(r["file"][-5:], r["row"], r["text"]) for r in files.error_texts(rows).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert texts == {(f"{f}.csv", i, f"Row {i} validation failure: bad volume: none") for f, n in (("a", 700), ("c", 1500)) for i in range(100, n + 1, 100)}
    path = f"file://{tmp_path}/parquet"
    spark.createDataFrame([(DAY0, 1.0, 1.0, 1.0, 1.0, float(i)) for i in range(1, 50)], "timestamp timestamp, open double, high double, low double, close double, volume double").coalesce(1).write.parquet(path)
    assert files.read_parquet(spark, path, "a", "b", "1d").where("row <> volume").count() == 0


def test_ingested_errors_have_places(spark, tmp_path):
    rows = daily(3)
    rows[1] = (*rows[1][:4], "twelve", rows[1][5])
    r = run(spark, tmp_path, rows)
    assert r.status == "FAILED" and [(e["file"].endswith("/x.csv"), e["row"], e["text"]) for e in r.errors.collect()] == [(True, 2, "Row 2 validation failure: bad close: twelve")]


@pytest.mark.parametrize("session", ["America/New_York", "Asia/Kolkata", "UTC"])
def test_stamps_do_not_depend_on_the_session(spark, tmp_path, session):
    from datetime import date

    texts = ["2020-01-02T00:00:00", "2020-01-02T00:00:00Z", "2020-07-01", "2026-03-08 02:30:00", "2025-11-02T01:30:00", "2020-01-02 03:04:05.123456", "x"]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", session)
    try:
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        micros = lambda df, zone: [r[0] for r in df.select(F.unix_micros(files.norm_timestamp("t", df.schema["t"].dataType, zone))).collect()]
        utc = lambda *a: int(datetime(*a, tzinfo=UTC).timestamp() * 1e6)
        assert micros(df, "UTC") == [utc(2020, 1, 2), utc(2020, 1, 2), utc(2020, 7, 1), utc(2026, 3, 8, 2, 30), utc(2025, 11, 2, 1, 30), utc(2020, 1, 2, 3, 4, 5) + 123456, None]
        assert micros(df, "America/New_York")[2:5] == [utc(2020, 7, 1, 4), utc(2026, 3, 8, 7, 30), utc(2025, 11, 2, 5, 30)]
        assert micros(df, None) == [None, utc(2020, 1, 2), None, None, None, None, None]
        dates = spark.createDataFrame([(date(2020, 1, 2),)], "t date")
        assert micros(dates, "UTC") == [utc(2020, 1, 2)] and micros(dates.select(F.col("t").cast("timestamp_ntz").alias("t")), "Asia/Kolkata") == [utc(2020, 1, 1, 18, 30)]
        read = files.read_csv(spark, csv(tmp_path, [("2020-01-02T00:00:00", 1, 1, 1, 1, 1), ("2020-01-02T00:00:00Z", 1, 1, 1, 1, 1)]), "a", "b", "1d", "UTC")
        assert read.select("timestamp").distinct().count() == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_row_groups_without_the_symbol_are_skipped(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    store.write(spark.range(3000).select(F.concat(F.lit("S"), F.col("id")).alias("symbol"), F.lit("X").alias("exchange"), F.lit("1d").alias("timeframe"), F.lit(DAY0).cast("timestamp").alias("timestamp"), *[F.lit(1.0).alias(c) for c in ("open", "high", "low", "close", "volume")]), path)

    def scanned(symbol):
        df = store.read_candles(spark, path, [symbol])
        return df.count()

    def bloom(symbol):
        """Whether the file that the symbol would be in keeps a filter for it."""
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        kept = []
        for part in (tmp_path / "s").rglob("*.parquet"):
            file = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(f"file://{part}"), conf)
            reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(file)
            for block in reader.getFooter().getBlocks():
                column = next(c for c in block.getColumns() if c.getPath().toDotString() == "symbol")
                filter_ = reader.readBloomFilter(column)
                if filter_ is not None:
                    kept.append(filter_.findHash(filter_.hash(jvm.org.apache.parquet.io.api.Binary.fromString(symbol))))
            reader.close()
        return kept

    assert scanned("S17") == 1 and scanned("S17x") == 0
    assert sum(bloom("S17")) >= 1 and bloom("S17x") and not all(bloom("S17x"))
