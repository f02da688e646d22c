"""Sources (S1-S7) and sinks (K1-K5) on small files written by the tests."""

import os

from pyspark.sql import functions as F

from marketweave.sources import files as S
from marketweave.sources import sinks as K
from marketweave.sources import tables as T
from marketweave.sources.tables import read_table, register_views
from conftest import SF001


def _write(path, text):
    with open(path, "w") as f:
        f.write(text)
    return path


def test_read_csv_header_as_text(spark, tmp_dir):
    p = _write(os.path.join(tmp_dir, "s.csv"), "Order Date,Quantity\n2020-01-01,3\nOrder Date,Quantity\n,x\n")
    df = S.read_csv(spark, p)
    assert df.columns == ["Order Date", "Quantity"]
    assert dict(df.dtypes)["Quantity"] == "string"
    assert df.count() == 3


def test_read_csv_after_preamble(spark, tmp_dir):
    body = ('"Data Source","WDI",\n\n"Last Updated","2024",\n\n'
            '"Country Name","Country Code","1999","2000"\n"India","IND","4.7","4.0"\n"Chile","CHL","3.3",""\n')
    p = _write(os.path.join(tmp_dir, "w.csv"), body)
    df = S.read_csv_after_preamble(spark, p, ["Country Name", "Country Code", "1999", "2000"])
    assert df.columns == ["Country Name", "Country Code", "1999", "2000"]
    rows = {r["Country Name"]: r for r in df.collect()}
    assert rows["India"]["2000"] == "4.0" and rows["Chile"]["2000"] is None


def test_rows_after_the_header_stay_whatever_is_blank(spark, tmp_dir):
    names = ["Country Name", "Country Code", *map(str, range(1999, 2004))]
    lead = '"Data Source","WDI",\n\n"Last Updated","2024",\n\n' + ",".join(f'"{n}"' for n in names) + ",\n"
    want = {}
    for f in ("a", "b"):
        rows = [(f"{f}{i}", f"C{i}", *("" if i % 5 == k or i % 7 == 0 else str(i + k) for k in range(5))) for i in range(3000)]
        want |= {r[0]: tuple(x or None for x in r) for r in rows}
        _write(os.path.join(tmp_dir, f"{f}.csv"), lead + "".join(",".join(r) + ",\n" for r in rows))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for n in ("4k", size):
            spark.conf.set("spark.sql.files.maxPartitionBytes", n)
            df = S.read_csv_after_preamble(spark, tmp_dir, names)
            got = [tuple(r) for r in df.collect()]
            assert df.columns == names and len(got) == len(want) and {r[0]: r for r in got} == want
            assert df.select("2003").filter("`2003` is null").count() == sum(r[-1] is None for r in want.values())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_read_csv_named_skips_lead_lines(spark, tmp_dir):
    body = "Price,Close,High\nTicker,SONY,SONY\nDate,,\n2020-01-02,10.5,11\n2020-01-03,abc,12\n"
    p = _write(os.path.join(tmp_dir, "sony.csv"), body)
    df = S.read_csv_named(spark, p, ["date", "close", "high"], F.expr("try_to_date(date) IS NOT NULL"))
    out = df.orderBy("date").collect()
    assert [r.date for r in out] == ["2020-01-02", "2020-01-03"]
    assert df.select(F.expr("try_cast(close AS double)").alias("c")).orderBy("c").collect()[0].c is None


def test_read_sheet_export(spark, tmp_dir):
    lead = "title,,\nsub,,\n,,\nnote,,\nYear,A,B\n"
    p = _write(os.path.join(tmp_dir, "li.csv"), lead + "2019,1,2\n2020,3,4\nFootnote,,\n")
    df = S.read_sheet_export(spark, p, ["year", "a", "drop_me"], F.expr("try_cast(year AS int) IS NOT NULL"), ["drop_me"])
    assert df.columns == ["year", "a"]
    years = df.select(F.expr("try_cast(year AS int)").alias("y")).na.drop().collect()
    assert sorted(r.y for r in years) == [2019, 2020]


def test_read_table_prunes_columns(spark):
    df = read_table(spark, SF001, "orders", "o_orderkey", "o_orderdate")
    assert df.columns == ["o_orderkey", "o_orderdate"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in plan


def test_register_views(spark):
    register_views(spark, SF001, ["nation", "region"])
    assert spark.sql("SELECT count(*) AS n FROM nation").first().n == 25


def test_write_table_partitioned_and_log(spark, tmp_dir):
    df = spark.createDataFrame([(2020, 1.0), (2021, 2.0)], "year int, v double")
    K.write_table(df, os.path.join(tmp_dir, "t"), ["year"])
    parts = sorted(x for x in os.listdir(os.path.join(tmp_dir, "t")) if x.startswith("year="))
    assert parts == ["year=2020", "year=2021"]
    n = K.write_logged(df, os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "log"), "smart_query",
                       {"ticker": "NVDA"}, ["sales", "products", "sales"])
    K.append_query_log(spark, os.path.join(tmp_dir, "log"), "smart_query", {}, ["sales"], 7)
    log = spark.read.parquet(os.path.join(tmp_dir, "log")).orderBy("rows_returned").collect()
    assert n == 2 and [r.rows_returned for r in log] == [2, 7]
    assert log[0].tables_used == '["products", "sales"]'


def test_json_records(spark):
    df = spark.createDataFrame([(1, None)], "a int, b double")
    assert K.to_json_records(df).first().record == '{"a":1}'


def test_build_catalog_counts(spark, tmp_dir):
    counts = K.build_catalog(spark, SF001, os.path.join(tmp_dir, "cat"))
    assert counts["holidays"] == 32 and counts["regions"] == 25
    assert counts["sales"] == read_table(spark, SF001, "lineitem").count()
    back = spark.read.parquet(os.path.join(tmp_dir, "cat", "sales"))
    assert "year" in back.columns and back.count() == counts["sales"]


def test_catalog_holds_every_yearly_series(spark, tmp_dir, monkeypatch):
    from marketweave.sources import catalog as C
    monkeypatch.setattr(K, "BUILD", {k: v for k, v in K.BUILD.items() if k.startswith("annual_")})
    counts = K.build_catalog(spark, SF001, tmp_dir)
    for kind in C.annual_all(spark, SF001).columns[1:]:
        want = sorted(map(tuple, C.annual_series(spark, SF001, kind).collect()))
        assert sorted(map(tuple, spark.read.parquet(os.path.join(tmp_dir, f"annual_{kind}")).collect())) == want
        assert counts[f"annual_{kind}"] == len(want) > 0


def test_smart_query_logged(spark, tmp_dir):
    from marketweave.plans.smart_query import smart_query_logged
    n = smart_query_logged(spark, SF001, os.path.join(tmp_dir, "q"), os.path.join(tmp_dir, "log"),
                           holiday="Diwali", ticker="nvda")
    log = spark.read.parquet(os.path.join(tmp_dir, "log")).first()
    assert log.rows_returned == n == spark.read.parquet(os.path.join(tmp_dir, "q")).count()
    assert log.tables_used == '["holidays", "products", "sales", "stock_prices"]'
    assert '"holiday": "Diwali"' in log.conditions


def test_lead_rows_of_every_file_go(spark, tmp_dir):
    for t in ("a", "b"):
        _write(os.path.join(tmp_dir, f"{t}.csv"), f"Price,Close\nTicker,{t}\n2020-01-02,1\n2020-01-03,2\n")
    df = S.read_csv_named(spark, tmp_dir, ["date", "close"], F.expr("try_to_date(date) IS NOT NULL"))
    assert df.count() == 4


def test_named_markers_and_declared_schemas(spark, tmp_dir):
    import pytest
    df = T.query(spark, SF001, "SELECT count(*) AS n FROM orders WHERE o_orderstatus = :status AND o_totalprice > :least", status="F", least=0.0)
    assert df.first().n == read_table(spark, SF001, "orders").filter("o_orderstatus = 'F' AND o_totalprice > 0").count()
    spark.createDataFrame([("x", "y")], "r_regionkey string, r_name string").write.parquet(os.path.join(tmp_dir, "region.parquet"))
    with pytest.raises(ValueError, match="r_regionkey"):
        read_table(spark, tmp_dir, "region")
