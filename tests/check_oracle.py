"""Compare registered queries with their SQL in DuckDB: ``python tests/check_oracle.py [sf] [name ...]``."""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session(cpus: str = "8"):
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{cpus}]").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return int(v) if v == int(v) and abs(v) < 1e15 else round(v, 6)
    if hasattr(v, "__float__"):
        return norm(float(v))
    return str(v) if not isinstance(v, int) else v


def compare(spark, con, name, fn, sql, sf):
    t = time.time()
    df = fn(spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(x) for x in r) for r in df.select(*cols).toPandas().astype(object).where(lambda d: d.notna(), None).itertuples(index=False)), key=repr)
    spent = time.time() - t
    if sql is None:
        return f"rows-only {len(got)}", spent, []
    t = time.time()
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    if sorted(names) != cols:
        return f"COLUMNS {cols} vs {sorted(names)}", spent, []
    order = [names.index(c) for c in cols]
    want = sorted((tuple(norm(r[i]) for i in order) for r in res.fetchall()), key=repr)
    if got == want:
        return f"ok {len(got)} (sql {time.time() - t:.1f}s)", spent, []
    diff = [(g, w) for g, w in zip(got, want) if g != w][:3]
    return f"DIFF rows {len(got)} vs {len(want)}; {sum(g != w for g, w in zip(got, want))} differ", spent, diff


def main():
    import duckdb
    import __spark_entry__ as entry
    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    path = f"/root/testdata/{sf}"
    con = duckdb.connect()
    for tb in TABLES:
        con.execute(f"CREATE VIEW {tb} AS SELECT * FROM '{path}/{tb}.parquet'")
    qs, sqls = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[2:]
    names = [n for n in qs if not wanted or any(n.startswith(w) for w in wanted)]
    spark, bad = session(), 0
    for n in names:
        try:
            msg, spent, diff = compare(spark, con, n, qs[n], sqls.get(n), path)
        except Exception as e:  # report and go on
            msg, spent, diff = "ERROR " + " ".join(str(e).split())[:600], 0, []
        if not msg.startswith(("ok", "rows-only")):
            bad += 1
        print(f"{n:32s} {spent:6.1f}s {msg}", *diff, sep="\n   " if diff else "", flush=True)
    print(f"{len(names)} queries, {bad} not matching")


if __name__ == "__main__":
    main()
