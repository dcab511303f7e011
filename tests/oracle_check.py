"""Compare queries with their SQL: row count, column names and values, order left out.

    python tests/oracle_check.py /root/testdata/sf0.01 [query ...]
"""

import decimal
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, decimal.Decimal):
        return int(v) if v == v.to_integral_value() else float(v)
    return v


def compare(con, df, sql):
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    got = df.collect()
    if sorted(names) != sorted(df.columns):
        return f"columns differ: {sorted(df.columns)} / {sorted(names)}"
    order = sorted(names)
    w = Counter(tuple(_plain(r[names.index(c)]) for c in order) for r in want)
    g = Counter(tuple(_plain(r[c]) for c in order) for r in got)
    if w != g:
        return (f"rows {len(got)} / {len(want)}; only here {list((g - w).items())[:3]}; "
                f"only in SQL {list((w - g).items())[:3]} {order}")
    return None


def main():
    from pyspark.sql import SparkSession
    import __spark_entry__ as entry
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(sf_dir), 0
    for name, q in entry.queries().items():
        if names and name not in names:
            continue
        t = time.time()
        sql = entry.oracle_sql().get(name)
        try:
            df = q(spark, sf_dir)
            problem = compare(con, df, sql) if sql else f"no SQL, {df.count()} rows"
        except Exception as e:  # report every query
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += bool(problem and sql)
        print(f"{'ok  ' if not problem else 'note' if not sql else 'BAD '} {name:30s} {time.time() - t:6.2f}s {problem or ''}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
