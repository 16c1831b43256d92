"""Compare a query with its SQL on the same tables, as sets of rows with repeats."""

import math
import sys
from collections import Counter
from datetime import date, datetime
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir) / f"{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9) + 0.0
    if isinstance(x, (datetime, date)):
        return str(x)
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(tuple(plain(r[k]) for k in order) for r in data)


def differences(spark, query, sql, sf_dir, con=None):
    df = query(spark, sf_dir)
    got = rows(df.columns, df.collect())
    con = con or connect(sf_dir)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = rows(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return [("columns", sorted(df.columns), sorted(names))]
    return [*(("only in the query", r) for r in list((got - want))[:3]), *(("only in SQL", r) for r in list((want - got))[:3])]


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    sys.path.insert(0, str(Path(__file__).parent.parent))
    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf, names = sys.argv[1], sys.argv[2:]
    queries, sql, con = entry.queries(), entry.oracle_sql(), connect(sf)
    for name in names or queries:
        try:
            if name in sql:
                bad = differences(spark, queries[name], sql[name], sf, con)
                print(name, "ok" if not bad else bad, flush=True)
            else:
                print(name, "rows", queries[name](spark, sf).count(), flush=True)
        except Exception as e:  # noqa: BLE001  a report goes on to the next query
            print(name, "FAILED", str(e).split("\n")[0][:300], flush=True)
