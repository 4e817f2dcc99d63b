"""Compare registered queries with their SQL: python tests/oracle.py [SF] [NAME...]."""

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings messages spans metrics updates nodes edges registry lineage raw_records languages mix_targets containers".split()


def value(x):
    if x is None or x != x:
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, float):
        return float(f"{x:.9g}")
    if hasattr(x, "isoformat"):
        return x.isoformat()
    try:
        return int(x) if float(x) == int(x) and not isinstance(x, str) else x
    except (TypeError, ValueError):
        return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(value(r[i]) for i in order) for r in data), key=repr)


def compare(spark, name, query, sql, sf_dir):
    t = time.time()
    df = query(spark, sf_dir)
    got = rows(df.columns, df.collect())
    took = time.time() - t
    if sql is None:
        return f"{name}: {len(got)} rows, {took:.1f} s, no SQL", True
    con = duckdb.connect()
    for x in TABLES:
        con.execute(f"CREATE VIEW {x} AS SELECT * FROM read_parquet('{sf_dir}/{x}.parquet')")
    t = time.time()
    ran = con.execute(sql)
    columns = [c[0] for c in ran.description]
    want = rows(columns, ran.fetchall())
    same = sorted(columns) == sorted(df.columns) and got == want
    note = "" if same else f" columns {sorted(df.columns)} / {sorted(columns)}; first differences {[x for x in got if x not in set(want)][:3]} / {[x for x in want if x not in set(got)][:3]}"
    return f"{name}: {'same' if same else 'DIFFERENT'}, {len(got)} / {len(want)} rows, Spark {took:.1f} s, DuckDB {time.time() - t:.1f} s{note}", same


if __name__ == "__main__":
    import __spark_entry__ as e

    from fedlens.common import local_session

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith(("0", "sf", "check")) else "0.01"
    d = f"/root/testdata/{sf if not sf[0].isdigit() else 'sf' + sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    ok = True
    for name, q in e.queries().items():
        if not args or name in args or any(a.endswith("*") and name.startswith(a[:-1]) for a in args):
            try:
                line, good = compare(spark, name, q, e.oracle_sql().get(name), d)
            except Exception as x:  # noqa: BLE001
                line, good = f"{name}: ERROR {str(x)[:1500]}", False
            ok &= good
            print(line, flush=True)
    sys.exit(not ok)
