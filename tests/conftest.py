import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    with tempfile.TemporaryDirectory() as folder:
        session = (
            SparkSession.builder.master("local[4]")
            .config("spark.sql.shuffle.partitions", "4")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.ui.enabled", "false")
            .config("spark.sql.warehouse.dir", f"{folder}/warehouse")
            .config("spark.checkpoint.dir", f"{folder}/shared")
            .getOrCreate()
        )
        session.sparkContext.setLogLevel("ERROR")
        yield session
        session.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def same_as_duckdb():
    """Compares a DataFrame with DuckDB SQL over the tables of a directory: rows as sets of rounded values."""
    import duckdb

    def compare(df, sql, sf_dir):
        con = duckdb.connect()
        for p in Path(sf_dir).glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        cursor = con.execute(sql)
        names = [d[0] for d in cursor.description]
        assert sorted(names) == sorted(df.columns)
        value = lambda x: round(x, 9) if isinstance(x, float) else x
        plain = lambda rows: sorted((tuple(value(x) for x in r) for r in rows), key=repr)
        assert plain(df.select(*names).collect()) == plain(cursor.fetchall())

    return compare
