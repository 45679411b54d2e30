"""Sources, sinks and streams on small files."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from panelforge.operators import late_panes, regimes, routing
from panelforge.sources import readers, sinks
from panelforge.streaming import late_counts, regime_filter

D = dt.date


def test_publication_scan_prunes_and_pushes(spark, tmp_path):
    at = str(tmp_path / "pubs")
    rows = [("1", [("ACME", "US"), ("BETA", "US")], "US", 20100101, 20110101, 0, 0), ("2", [("ACME", "EP")], "EP", 20100101, 0, 0, 0), ("3", [], "US", 0, 0, 0, 0)]
    spark.createDataFrame(rows, readers.NESTED_PUBLICATIONS).withColumn("unused", F.lit("x")).write.parquet(at)
    df = readers.PublicationScan(at).read(spark)
    assert sorted((r.application_number, r.assignee_name) for r in df.collect()) == [("1", "ACME"), ("1", "BETA")]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(country_code,US)" in plan and "unused" not in plan
    assert readers.guarded(df, 10**12) is df
    with pytest.raises(readers.TooLarge):
        readers.guarded(df, 1)


def test_csv_round_trip_and_top_up(spark, tmp_path):
    store = readers.CsvStore(str(tmp_path / "raw"))
    rows = [("1", "ACME, INC \"x\"", "US", 20100101, 20110101, 0, 20100101), ("2", None, "US", 0, None, 0, 0)]
    df = spark.createDataFrame(rows, readers.PUBLICATIONS)
    store.write(df)
    back = store.read(spark)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    rules = spark.createDataFrame([(1, "A", "match", "ACME%", ""), (2, "B", "match", "BETA%", "")], routing.RULES)
    assert [r.ticker for r in readers.missing_entities(back, rules).collect()] == ["B"]
    fetched = spark.createDataFrame([("9", "BETA LTD", "US", 1, 1, 0, 0), ("8", "ACME NEW", "US", 1, 1, 0, 0)], readers.PUBLICATIONS)
    assert sorted(r.application_number for r in readers.top_up(back, fetched, rules).collect()) == ["1", "2", "9"]
    low = readers.low_counts(spark.createDataFrame([("A",)], "ticker string"), spark.createDataFrame([("A", 1), ("B", 1)], "ticker string, expect_min int"))
    assert [(r.ticker, r.n) for r in low.collect()] == [("B", 0)]


def test_company_facts_and_statement(spark, tmp_path):
    (tmp_path / "cf").mkdir()
    fact = {"start": "2020-01-01", "end": "2020-03-31", "val": 5, "filed": "2020-05-01", "form": "10-Q", "fy": 2020, "fp": "Q1", "accn": "x"}
    (tmp_path / "cf/a.json").write_text(json.dumps({"cik": 7, "facts": {"us-gaap": {"Revenues": {"units": {"USD": [fact]}}}}}))
    (tmp_path / "cf/b.json").write_text("not json")
    src = readers.CompanyFacts(str(tmp_path / "cf"))
    reg = spark.createDataFrame([(7, "A"), (8, "A")], "cik bigint, ticker string")
    assert src.for_companies(spark, reg).count() == 1
    with pytest.raises(LookupError):
        src.for_companies(spark, spark.createDataFrame([(9, "Z")], "cik bigint, ticker string"))
    (tmp_path / "st.csv").write_text("ticker,item,2020-03-31,2020-06-30\nA,Total Revenue,5.5,\nA,Other,1,2\nA,Gross Profit,NaN,3\n")
    st = readers.WideStatement(str(tmp_path / "st.csv"), {"Total Revenue": "revenue", "Gross Profit": "gross_profit"}).read(spark)
    assert sorted((r.concept, r.end, r.value) for r in st.collect()) == [("gross_profit", D(2020, 6, 30), 3.0), ("revenue", D(2020, 3, 31), 5.5)]


def test_first_of(spark):
    df = spark.range(1).select(F.struct(F.array(F.struct(F.lit("d").alias("filing_date"))).alias("application"), F.array().cast("array<struct<x:string>>").alias("none")).alias("p"))
    assert df.select(readers.first_of("p", "application.[0].filing_date"), readers.first_of("p", "none.[0].x")).first()[:] == ("d", None)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("A", 2), ("A", 1), ("B", 1)], "ticker string, q int")
    assert spark.read.parquet(sinks.write_artefact(df, str(tmp_path), "x")).count() == 3
    assert spark.read.option("header", True).csv(sinks.write_artefact(df, str(tmp_path), "y", "csv")).columns == ["ticker", "q"]
    c = {(r.ticker, r.q): r.caveat for r in sinks.first_row_caveat(df, "beware", ["ticker"], ["q"]).collect()}
    assert c == {("A", 1): "beware", ("A", 2): "", ("B", 1): "beware"}
    calls = []

    def run(w):
        calls.append(sorted(r.ticker for r in w.select("ticker").distinct().collect()))
        return w.groupBy("ticker").agg(F.sum("q").alias("s"))

    at = str(tmp_path / "fits")
    sinks.resume(df.where("ticker = 'A'"), run, at)
    assert sorted((r.ticker, r.s) for r in sinks.resume(df, run, at).collect()) == [("A", 3), ("B", 1)]
    assert calls == [["A"], ["B"]]
    assert df.limit(1).select(sinks.table_row(["ticker", "q"], "%s & %d")).first()[0].startswith("A & ")


def test_late_counts_stream_equals_batch(spark, tmp_path):
    import random

    rng = random.Random(7)
    data = [(rng.randrange(2), D(2015, 1, 1) + dt.timedelta(a := rng.randrange(500)), D(2015, 1, 1) + dt.timedelta(a + rng.randrange(1500))) for _ in range(200)]
    schema = "feed int, f date, p date"
    src = str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame(data[k::3], schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    store = late_counts.PaneStore(spark, str(tmp_path / "panes"))
    q = late_counts.correct_late(stream, ["feed"], "f", "p", store, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    last = out.groupBy("stream", "window_q").agg(F.max("batch").alias("batch"))
    final = out.join(last, ["stream", "window_q", "batch"]).select("stream", "window_q", "arrival_month", "stage", "delta", "total")
    whole = late_panes.recompose(late_panes.slice_events(spark.createDataFrame(data, schema), ["feed"], "f", "p")).select(*final.columns)
    assert sorted(map(str, final.collect())) == sorted(map(str, whole.collect()))
    assert out.select("batch").distinct().count() == 3


def test_regime_stream_equals_batch(spark, tmp_path):
    counts = [(t, q, (q * 7 + i) % 30) for i, t in enumerate("AB") for q in range(12)]
    schema = "ticker string, q int, n bigint"
    src = str(tmp_path / "in")
    for lo in (0, 6):
        spark.createDataFrame([c for c in counts if lo <= c[1] < lo + 6], schema).coalesce(1).write.mode("append").parquet(src)
    args = ([8.0, 20.0], 5.0, [[0.9, 0.1], [0.2, 0.8]], [0.6, 0.4])
    s = regime_filter.regime_stream(spark.readStream.schema(schema).parquet(src), *args)
    q = s.writeStream.format("memory").queryName("regimes").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.ticker, r.q): r.p_high for r in spark.sql("select * from regimes").collect()}
    want = {(r.ticker, r.q): r.p_high for r in regimes.filter_probabilities(spark.createDataFrame(counts, schema), *args).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
