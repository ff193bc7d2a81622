"""Queries that join or group every row, against brute force on tables whose ids go far beyond those of the driver's."""

import datetime

import duckdb

import __spark_entry__ as entry


def test_range_join_covers_all_ids(spark, tmp_path):
    kinds = ["error", "signup", "click", "error", "signup"]
    rows = [(i, kinds[(i // 3 + i) % 5]) for i in [*range(-20, 20), *range(8990, 9050), *range(50_000, 50_050)]]
    spark.createDataFrame(rows, "event_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(tuple(r) for r in entry.queries()["range_join"](spark, str(tmp_path)).select("a_id", "b_id").collect())
    want = sorted((a, b) for a, x in rows for b, y in rows if x == "error" and y == "signup" and abs(a - b) <= 6)
    assert got == want and any(a > 9000 for a, _ in got)


def test_every_lineitem_row_is_an_entry_and_an_object(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    links = entry.queries()["hardlinks"](spark, sf).collect()
    assert len(links) == rows and any(r.link_to and not r.path.endswith(("-1", "-2")) for r in links)
    assert sum(r.objects for r in entry.queries()["layout_totals"](spark, sf).collect()) == rows


def test_reuse_keeps_the_part_of_the_later_version(spark, tmp_path):
    day, next_day, nan = datetime.datetime(1997, 10, 5), datetime.datetime(1997, 10, 6), float("nan")
    rows = [
        (5, 1, 12.0, day, 100), (5, 1, 11.0, day, 200), (5, 1, 11.0, day, 201), (5, 1, 11.0, next_day, 202),  # 12 equals both rows of 11 + 1
        (6, 1, 12.0, day, 300), (6, 1, 12.0, day, 301), (6, 1, 11.0, day, 302), (6, 2, 12.0, day, 303),  # copies, each equal to each
        (7, 1, None, day, 400), (7, 2, 1.0, None, 401), (None, 1, 1.0, day, 402), (7, 3, 1.0, day, None),  # a null equals nothing; a part may be null
        (8, 1, nan, day, 500), (10, 1, nan, day, 501), (8, 2, -0.0, day, 502), (8, 2, 0.0, day, 503), (-5, 1, 0.0, day, 600), (-5, 1, -1.0, day, 601),
    ]
    frame = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_shipdate timestamp_ntz, l_partkey long")
    frame.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = [tuple(r) for r in entry.queries()["incremental_reuse"](spark, str(tmp_path)).select("l_orderkey", "l_linenumber", "l_partkey").collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.sql(entry.oracle_sql()["incremental_reuse"]).fetchall()
    assert sorted(got, key=str) == sorted(want, key=str)
    assert got.count((5, 1, 100)) == 2 and got.count((6, 1, 300)) == got.count((6, 1, 301)) == 2 and (-5, 1, 600) in got
    assert not any(k in (200, 201, 601) for _, _, k in got)
