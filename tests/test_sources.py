"""Readers of staged files: payloads, journals, archives, calendars, listings; manifests and rejected files."""

from __future__ import annotations

import datetime as dt
import gzip
import hashlib
import zipfile

import pytest
from pyspark.sql import functions as F

from panelwright.operators import calendar as C
from panelwright.operators import metrics as M
from panelwright.sources import sinks, tables

D = dt.date


def test_bad_bars_reject_the_file(spark, tmp_path):
    rows = [("a", dt.datetime(2024, 1, 1), D(2024, 1, 1), "09:30:00", 1.0, 1.0, 1.0, 2.0, 5.0), ("a", dt.datetime(2024, 1, 1), D(2024, 1, 1), "09:45:00", 0.0, 1.0, 1.0, 2.0, 5.0)]
    sinks.write_table(spark.createDataFrame(rows[:1], tables.BAR_SCHEMA), f"{tmp_path}/good.csv.gz")
    sinks.write_table(spark.createDataFrame(rows, tables.BAR_SCHEMA), f"{tmp_path}/bad.csv.gz")
    assert len(tables.read_bars(spark, f"{tmp_path}/good.csv.gz").collect()) == 1
    with pytest.raises(Exception, match="bad bar in"):
        tables.read_bars(spark, f"{tmp_path}/bad.csv.gz").collect()


@pytest.mark.parametrize("suffix", ["", ".csv", ".csv.gz", ".json"])
def test_sidecars_name_what_was_written(spark, tmp_path, suffix):
    df = spark.createDataFrame([(1, "x", 2.5), (2, "y", None)], "a long, b string, c double")
    sinks.write_with_sidecar(df, f"{tmp_path}/t{suffix}")
    got = spark.read.json(f"{tmp_path}/t{suffix}.manifest").first()
    assert (got["rows"], got["content_hash"]) == tuple(sinks.content_hash(df).select("rows", "content_hash").first())


def test_chunks_are_what_their_hash_says(spark, tmp_path):
    (tmp_path / "a.csv").write_text("one")
    (tmp_path / "b.csv").write_text("two")
    digest = hashlib.sha256(b"one").hexdigest()
    lines = [f'{{"path": "{tmp_path}/a.csv", "status": "complete", "sha256": "{digest}"}}', f'{{"path": "{tmp_path}/b.csv", "status": "partial", "sha256": "x"}}']
    (tmp_path / "m.json").write_text("\n".join(lines))
    assert [r.path for r in tables.complete_chunks(spark, f"{tmp_path}/m.json").collect()] == [f"{tmp_path}/a.csv"]
    (tmp_path / "m2.json").write_text(lines[1].replace("partial", "complete"))
    with pytest.raises(Exception, match="hash differs"):
        tables.complete_chunks(spark, f"{tmp_path}/m2.json").collect()


def test_records_and_payloads(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.jsonl").write_text('{"id": "1"}\n{"id": "2"}\n')
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write('{"id": "3"}\n')
    assert sorted(r.id for r in tables.read_records(spark, str(tmp_path), "id string").collect()) == ["1", "2", "3"]
    own = tmp_path / "p"
    own.mkdir()
    for name, text in {"list": '[{"id": "1"}]', "key": '{"feed": [{"id": "2"}]}', "deep": '{"data": {"articles": [{"id": "3"}, {"id": "4"}]}}', "one": '{"id": "5"}'}.items():
        (own / f"{name}.json").write_text(text)
    assert sorted(r.id for r in tables.read_payloads(spark, str(own), "id:string").collect()) == ["1", "2", "3", "4", "5"]


def test_torn_journals(spark, tmp_path):
    (tmp_path / "j.jsonl").write_text('{"id": 1}\n{"id": 2}\n{"id": 3, "na')
    assert sorted(r.id for r in tables.whole_records(spark, f"{tmp_path}/j.jsonl", "id long").collect()) == [1, 2]
    (tmp_path / "k.jsonl").write_text('{"id": 1}\n{"id": \n{"id": 3}\n')
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        tables.whole_records(spark, f"{tmp_path}/k.jsonl", "id long").collect()


def test_factor_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "f.zip", "w") as z:
        z.writestr("f.csv", "This file was made\nby someone, once\n\n,Mkt-RF,RF\n20240102,  1.50, -99.99\n20240103,-0.20,0.01\n\nCopyright 2024\n")
    got = sorted((r.date, r.name, r.value) for r in tables.read_factor_archives(spark, f"{tmp_path}/f.zip").collect())
    assert got == [(D(2024, 1, 2), "Mkt-RF", 0.015), (D(2024, 1, 2), "RF", None), (D(2024, 1, 3), "Mkt-RF", -0.002), (D(2024, 1, 3), "RF", 0.0001)]


def test_calendars_listings_and_earnings(spark, tmp_path):
    (tmp_path / "r.html").write_text("<table><tr><th>Date</th></tr><tr><td>Friday, January 5, 2024</td><td>08:30 AM</td><td><b>Employment</b> Situation</td></tr><tr><td>Monday, January 8, 2024</td><td>10:00 AM</td><td>Other</td></tr></table>")
    assert [(r.release, r.date, r.time) for r in tables.read_release_table(spark, f"{tmp_path}/r.html", ["Employment"]).collect()] == [("Employment Situation", D(2024, 1, 5), "08:30 AM")]
    (tmp_path / "m.html").write_text("<h4><a>2023 Meetings</a></h4><p>January 31-February 1 is not it</p><div>March 21-22</div><h4>2024 Meetings</h4><div>April/May 30-1</div><div>June 11-12</div>")
    got = {(r.year, r.first, r.last) for r in tables.read_meeting_headings(spark, f"{tmp_path}/m.html").collect()}
    assert got >= {(2023, D(2023, 3, 21), D(2023, 3, 22)), (2024, D(2024, 4, 30), D(2024, 5, 1)), (2024, D(2024, 6, 11), D(2024, 6, 12))}
    (tmp_path / "l.xml").write_text("<L><Contents><Key>a/b.gz</Key><Size>12</Size></Contents><Contents><Key>c</Key><Size>3</Size></Contents></L>")
    assert sorted((r.key, r.bytes) for r in tables.read_bucket_listing(spark, f"{tmp_path}/l.xml").collect()) == [("a/b.gz", 12), ("c", 3)]
    (tmp_path / "e.json").write_text('{"symbol": "A", "quarterlyEarnings": [{"fiscalDateEnding": "2023-12-31", "reportedDate": "2024-02-01", "surprise": "0.5", "reportTime": "pre-market"}, {"fiscalDateEnding": "2023-09-30", "reportedDate": "2023-11-01", "surprise": "None"}]}')
    assert [(r.symbol, r.reported, r.surprise, r.timing_known) for r in tables.read_earnings(spark, f"{tmp_path}/e.json", "2023-10-01", "2024-01-31").collect()] == [("A", D(2023, 11, 1), None, False)]
    (tmp_path / "h.csv").write_text("a, b,c\n1,2,3\n")
    assert sorted((r.place, r.column) for r in tables.read_csv_head(spark, f"{tmp_path}/h.csv").collect()) == [(0, "a"), (1, "b"), (2, "c")]
    urls = spark.createDataFrame([("https://x/?cursor=ab&y=1",), ("https://x/?y=1",), ("https://x/?cursor=a&cursor=b",)], "u string")
    assert [r[0] for r in urls.select(tables.cursor_of(F.col("u"))).collect()] == ["ab", None, None]


def test_asof_looks_back_without_a_bound(spark):
    events = spark.createDataFrame([(1, dt.datetime(1990, 1, 1)), (2, dt.datetime(2022, 1, 3, 14)), (3, dt.datetime(2022, 1, 3, 15)), (4, dt.datetime(2022, 6, 1)), (5, dt.datetime(2030, 1, 1))], "id long, at timestamp_ntz")
    cuts = spark.createDataFrame([(dt.datetime(2022, 1, 3, 14),), (dt.datetime(2022, 12, 1, 14),)], "cutoff timestamp_ntz")
    for strict, second in ((False, 0), (True, 1)):
        got = {r.id: r.cutoff for r in C.asof_forward(events, "at", cuts, "cutoff", strict).collect()}
        both = [dt.datetime(2022, 1, 3, 14), dt.datetime(2022, 12, 1, 14)]
        assert got == {1: both[0], 2: both[second], 3: both[1], 4: both[1], 5: None}


def test_exact_binomial_probability(spark):
    from math import comb

    rows = [(x, y) for x in range(0, 9) for y in range(0, 9)] + [(400, 460), (0, 900)]
    got = spark.createDataFrame(rows, "x long, y long").select("x", "y", M.exact_binomial_p(F.col("x"), F.col("y")).alias("p")).collect()
    for r in got:
        n, k = r.x + r.y, min(r.x, r.y)
        want = min(1.0, 2 * sum(comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0
        assert abs(r.p - want) < 1e-9
