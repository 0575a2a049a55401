import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("OMP_NUM_THREADS", "1")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


def comparable(rows, columns):
    """Rows as sorted tuples of text, columns in name order; doubles to nine digits."""

    def one(v):
        if v is None or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, float):
            return f"{v:.9g}"
        return str(int(v)) if hasattr(v, "is_integer") and not isinstance(v, int) else str(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(one(r[i]) for i in order) for r in rows), key=repr)


def duck(sql, sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    done = con.execute(sql)
    columns = [c[0] for c in done.description]
    return done.fetchall(), columns
