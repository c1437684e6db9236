"""Run queries and their SQL side by side: ``python -m tests.compare [sf] [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

DATA = Path("/root/testdata")


def connect(sf_dir: Path) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(sf_dir.glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def canonical(rows: pd.DataFrame) -> list[tuple]:
    rows = rows[sorted(rows.columns)]

    def value(x: object) -> str:
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
            return "null"
        if isinstance(x, pd.Timestamp):
            return str(x.tz_localize(None) if x.tzinfo else x)
        if isinstance(x, (int, float)) and not isinstance(x, bool) or hasattr(x, "dtype") and x.dtype.kind in "iuf" or type(x).__name__ == "Decimal":
            return repr(round(float(x), 6))
        return str(x)

    return sorted(tuple(value(x) for x in row) for row in rows.astype(object).itertuples(index=False))


def difference(spark, con, query, sql: str, sf_dir: str) -> str:
    """What differs, or nothing."""
    ours, theirs = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} and {sorted(theirs.columns)}"
    a, b = canonical(ours), canonical(theirs)
    if a == b:
        return ""
    left, right = [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2]
    return f"{len(a)} and {len(b)} rows; only here {left}; only there {right}"


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir, names = DATA / (sys.argv[1] if len(sys.argv) > 1 else "sf0.001"), sys.argv[2:]
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con, queries, sql = connect(sf_dir), entry.queries(), entry.oracle_sql()
    for name in names or [n for n in queries if not n.startswith("op") and n != "pipeline" or n.startswith("o") and not n[2].isdigit()]:
        began = time.time()
        try:
            said = difference(spark, con, queries[name], sql[name], str(sf_dir)) if name in sql else f"no SQL; {queries[name](spark, str(sf_dir)).count()} rows"
        except Exception as e:  # noqa: BLE001
            said = "ERROR " + str(e)[:400].replace("\n", " ")
        print(f"{name}: {said[:700] or 'same'} ({time.time() - began:.1f} s)", flush=True)


if __name__ == "__main__":
    main()
