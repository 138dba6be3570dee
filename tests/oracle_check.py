"""Run registered queries next to their SQL: python tests/oracle_check.py SF_DIR [name ...]"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(v + 0.0)
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda c: columns[c])
    return sorted(tuple(normal(r[c]) for c in order) for r in rows)


def main(sf, names):
    import __spark_entry__ as entry
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = []
    for name in names or queries:
        t0 = time.time()
        try:
            df = queries[name](spark, sf)
            got = [tuple(r) for r in df.collect()]
            t1 = time.time()
            if name not in oracles:
                print(f"rows  {name}: {len(got)} rows {t1 - t0:.1f}s", flush=True)
                continue
            res = con.execute(oracles[name])
            columns = [d[0] for d in res.description]
            want = res.fetchall()
            t2 = time.time()
            a, b = rows_of(df.columns, got), rows_of(columns, want)
            types = {d[0]: str(d[1]) for d in res.description}
            odd = [c for c, k in types.items() if "HUGEINT" in k or "DECIMAL" in k]
            if sorted(df.columns) != sorted(columns) or a != b or odd:
                bad.append(name)
                diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
                print(f"FAIL  {name}: {sorted(df.columns)} {sorted(columns)} {len(a)} {len(b)} rows, odd {odd}, {len([1 for x, y in zip(a, b) if x != y])} differ {diff}", flush=True)
            else:
                print(f"ok    {name}: {len(a)} rows spark {t1 - t0:.1f}s sql {t2 - t1:.1f}s", flush=True)
        except Exception as e:
            bad.append(name)
            print(f"ERROR {name}: {type(e).__name__} {str(e)[:700]}", flush=True)
    print(f"{len(bad)} bad: {bad}")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
