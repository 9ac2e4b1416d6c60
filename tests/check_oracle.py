"""Run registered queries against their SQL: python tests/check_oracle.py [sf dir] [names...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf_dir: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(record[i] for i in order) for record in records), key=repr)


def compare(spark, connection, name, query, sql, sf_dir, may_be_empty=True):
    """A message describing the first difference, or None."""
    frame = query(spark, sf_dir)
    ours = rows(frame.columns, [tuple(row) for row in frame.collect()])
    if not may_be_empty and not ours[1]:
        return "no rows"
    result = connection.execute(sql)
    theirs = rows([item[0] for item in result.description], result.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} != {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"rows {len(ours[1])} != {len(theirs[1])}"
    for mine, other in zip(ours[1], theirs[1]):
        if mine != other or [type(v) for v in mine] != [type(v) for v in other]:
            return f"{mine!r}\n  != {other!r}"
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from emberline.session import build_session, remove_staged

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:]
    spark = build_session(
        master="local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = oracle(sf_dir)
    sqls, failed = oracle_sql(), 0
    for name, query in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name in sqls:
                problem = compare(spark, connection, name, query, sqls[name], sf_dir, name == "recent_incidents_none")
            else:
                print(name, "rows", query(spark, sf_dir).count())
                problem = None
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        remove_staged(spark)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
