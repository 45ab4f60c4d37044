"""Compare registered queries with their SQL: ``python -m tests.oracle_check [sf_dir] [name ...]``."""

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return repr(value)


def compare(spark, con, name: str, sf_dir: str, query, sql: str) -> str:
    """Empty string when rows (as a multiset) and column names agree."""
    spark_df = query(spark, sf_dir)
    columns = sorted(spark_df.columns)
    got = sorted(tuple(_norm(v) for v in row) for row in spark_df.select(*columns).collect())
    relation = con.sql(sql)
    if sorted(relation.columns) != columns:
        return f"columns {columns} vs {sorted(relation.columns)}"
    order = [relation.columns.index(c) for c in columns]
    want = sorted(tuple(_norm(row[i]) for i in order) for row in relation.fetchall())
    if got == want:
        return ""
    in_got, in_want = set(got), set(want)
    only_got = [r for r in got if r not in in_want][:2]
    only_want = [r for r in want if r not in in_got][:2]
    return f"rows {len(got)} vs {len(want)}\n  spark {only_got}\n  sql   {only_want}"[:1500]


def main() -> int:
    from rulesieve.plans.oracles import ORACLES
    from rulesieve.plans.queries import QUERIES
    from rulesieve.session import local_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, query in QUERIES.items():
        if args and name not in args:
            continue
        start = time.time()
        try:
            if name in ORACLES:
                problem = compare(spark, con, name, sf_dir, query, ORACLES[name])
            else:
                problem = "" if query(spark, sf_dir).count() else "no rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {problem}", flush=True)
    print("failures:", bad, "queries without SQL:", sorted(set(QUERIES) - set(ORACLES)))
    return bad


if __name__ == "__main__":
    sys.exit(main())
