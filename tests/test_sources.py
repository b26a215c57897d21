from pathlib import Path

import pytest
from helpers import day, make_roles, rows
from pyspark.sql import DataFrameWriter
from shelfscope import Market, Rules, read_roles, read_table, write_table
from shelfscope.plans import quality, trends
from shelfscope.reports import OUTPUTS, reports, write_outputs
from shelfscope.schemas import INPUT_FILES, TRANSACTION
from shelfscope.sources import kept
from shelfscope.sources.kept import CHECKPOINT_DIR, KeptTables, clustered, shared_folder
from shelfscope.sources.star import categories

FILES = {
    "transaction_dat.csv": "create_dt,content_id,acct_id,price,device_id\n"
    "2016-07-04,c1,u,4.99,1\n2016-07-04,c1,u,4.99,1\n2016-07-05,A,v,0,2\n",
    "account_dat.csv": "acct_id,create_dt,payment_type\n"
    "u,2015-01-01,PMOF\nv,2016-01-01,Free only\n",
    "app_dat.csv": "content_id,app_name,category_id,device_id\nA,app-a,1,3\n",
    "in-app_dat.csv": "parent_app_content_id,content_id,type\nA,c1,consumable\n",
    "category_ref.csv": "category_id,category_name\n1,Games\n",
    "device_ref.csv": "device_id,device_name\n1,Phone\n2,Tablet\n3,Both\n",
}


def test_a_market_from_csv_files(spark, tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).write_text(text)
    roles = read_roles(spark, str(tmp_path))
    assert roles.transaction.schema == TRANSACTION
    assert {n: df.schema for n, df in roles.tables().items()} == {
        n: schema for n, (_, schema) in INPUT_FILES.items()
    }
    m = Market(spark, roles, Rules(), folder=str(tmp_path / "kept"))
    assert rows(trends.performance_daily(m.daily), "transaction_dt", "daily_sales") == [
        (day("2016-07-04"), 4.99), (day("2016-07-05"), 0.0)
    ]
    assert quality.null_report(roles).filter("null_ct > 0").count() == 0


def test_csv_values_that_do_not_fit_are_errors(spark, tmp_path):
    (tmp_path / "t.csv").write_text("create_dt,content_id,acct_id,price,device_id\nsoon,c,u,1,1\n")
    df = read_table(spark, str(tmp_path / "t.csv"), TRANSACTION)
    with pytest.raises(Exception, match="MALFORMED|CANNOT_PARSE|FAILFAST|FAILED_READ"):
        df.collect()


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_write_and_read_again(spark, tmp_path, fmt):
    sold = [("2016-07-01", 'c,"1"', "u", "1.50", 1), ("2016-07-02", "c", None, None, 2)]
    roles = make_roles(spark, sold)
    path = str(tmp_path / fmt)
    write_table(roles.transaction, path, fmt)
    write_table(roles.transaction, path, fmt)
    assert rows(read_table(spark, path, TRANSACTION, fmt)) == rows(roles.transaction)


def test_kept_tables_are_built_once_and_read_from_files(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        numbered = spark.range(5).selectExpr("id", "cast(id % 2 as string) as part")
        return clustered(numbered, "id", within=["part"])

    tables = KeptTables(spark, str(tmp_path))
    first = tables.get("t", build, partition_by=["part"])
    again = tables.get("t", build)
    assert built == [1]
    assert first.columns == ["id", "part"]
    assert rows(again) == rows(spark.range(5).selectExpr("id", "cast(id % 2 as string) as part"))
    assert "FileScan parquet" in first._jdf.queryExecution().executedPlan().toString()


def test_shared_folder_is_the_session_setting(spark):
    assert shared_folder(spark) == spark.conf.get(CHECKPOINT_DIR).rstrip("/")


def test_a_mounted_folder_serves_a_cluster(spark, monkeypatch):
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    folder = Path(spark.conf.get(CHECKPOINT_DIR))
    before = set(folder.iterdir())
    assert shared_folder(spark) == str(folder)
    assert Market(spark, make_roles(spark)).folder.startswith(f"{folder}/")
    assert set(folder.iterdir()) == before


def test_a_folder_of_one_machine_does_not(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr(kept, "CHECKPOINT_DIR", "shelfscope.test.dir")
    spark.conf.set("shelfscope.test.dir", str(tmp_path))
    # As if the tasks' files were on other disks: the driver has but the folder.
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path: Path(path).mkdir())
    for _ in range(2):
        with pytest.raises(ValueError, match="not seen by all machines"):
            shared_folder(spark)
    assert list(tmp_path.iterdir()) == []


def test_a_failed_build_can_be_repeated(spark, tmp_path):
    tables, ready = KeptTables(spark, str(tmp_path)), []

    def build():
        good = spark.range(3)
        return good if ready else good.selectExpr("CAST(raise_error('no') AS BIGINT) AS id")

    with pytest.raises(Exception, match="no"):
        tables.get("t", build)
    ready.append(1)
    assert tables.get("t", build).count() == 3


def test_close_deletes_all_that_was_written(spark, small, tmp_path):
    import __spark_entry__ as registered
    from shelfscope import roles_from_star

    (tmp_path / "other").mkdir()
    m = Market(spark, roles_from_star(spark, small), registered.RULES, folder=str(tmp_path))
    assert reports()["csv_round_trip"](m).count() > 0
    assert len(list(tmp_path.iterdir())) == 2
    m.close()
    assert [p.name for p in tmp_path.iterdir()] == ["other"]


@pytest.mark.parametrize("kind", ["int", "long", "decimal(10,0)"])
def test_region_keys_of_any_width(spark, tmp_path, kind):
    keys = spark.createDataFrame([(0,), (4,), (5,), (-2,), (None,)], "key int")
    keys.select(keys.key.cast(kind).alias("r_regionkey")).write.parquet(str(tmp_path / "region.parquet"))
    table = categories(spark, str(tmp_path))
    assert table.schema == INPUT_FILES["category"][1]
    found = dict(rows(table))
    assert found == {0: "Entertainment", 4: "Utilities", 5: None, -2: None, None: None}


def test_csv_columns_are_found_by_name(spark, tmp_path):
    text = "\n".join(["no,price,acct_id,create_dt,content_id,device_id", "0,1.50,u,2016-07-01,c1,2", ""])
    (tmp_path / "t.csv").write_text(text)
    got = read_table(spark, str(tmp_path / "t.csv"), TRANSACTION)
    assert rows(got, "create_dt", "content_id", "acct_id", "device_id") == [(day("2016-07-01"), "c1", "u", 2)]
    assert got.schema == TRANSACTION
    (tmp_path / "u.csv").write_text("price,acct_id\n1,u\n")
    with pytest.raises(ValueError, match="create_dt, content_id, device_id"):
        read_table(spark, str(tmp_path / "u.csv"), TRANSACTION)


def test_prices_are_not_rounded(spark, tmp_path):
    head = "create_dt,content_id,acct_id,price,device_id\n"
    (tmp_path / "a.csv").write_text(head + "2016-07-01,c,u,1500000,1\n")
    assert float(read_table(spark, str(tmp_path / "a.csv"), TRANSACTION).first().price) == 1500000
    (tmp_path / "b.csv").write_text(head + "2016-07-01,c,u,4.995,1\n")
    with pytest.raises(Exception, match="does not fit"):
        read_table(spark, str(tmp_path / "b.csv"), TRANSACTION).collect()


def test_names_with_quotes_and_line_breaks(spark, tmp_path):
    schema = INPUT_FILES["app"][1]
    name = 'Bob ""The"" App, HD'
    (tmp_path / "app.csv").write_text(f'content_id,app_name,category_id,device_id\nA,"{name}\nx",1,2\n')
    found = read_table(spark, str(tmp_path / "app.csv"), schema, line_breaks=True)
    assert rows(found, "app_name") == [('Bob "The" App, HD\nx',)]
    odd = spark.createDataFrame([("A", 'a "b"\n\\ c,', 1, 2), ("B", "\\", 1, 2)], schema)
    write_table(odd, str(tmp_path / "again"))
    assert rows(read_table(spark, str(tmp_path / "again"), schema, line_breaks=True)) == rows(odd)


def test_all_outputs_are_written(spark, small, tmp_path):
    import __spark_entry__ as registered

    market = registered.market(spark, small)
    paths = write_outputs(market, str(tmp_path))
    assert len(paths) == len(OUTPUTS) == 21
    known = reports()
    for output, path in paths.items():
        df = known[OUTPUTS[output]](market)
        assert rows(read_table(spark, path, df.schema)) == rows(df), output
