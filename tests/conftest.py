import duckdb
import pytest
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


def sorted_rows(columns, rows, order):
    at = [columns.index(c) for c in order]
    return sorted(([r[k] for k in at] for r in rows), key=repr)


@pytest.fixture(scope="session")
def same_rows(spark, duck):
    """Runs a query and its statement and compares all rows by column name."""

    def check(query, sql, sf_dir=SMALL, connection=None):
        df = query(spark, sf_dir)
        found = (connection or duck).execute(sql)
        columns = [c[0] for c in found.description]
        assert sorted(df.columns) == sorted(columns)
        order = sorted(columns)
        mine, its = sorted_rows(df.columns, [tuple(r) for r in df.collect()], order), sorted_rows(columns, found.fetchall(), order)
        assert mine == its

    return check
