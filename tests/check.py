"""Run registered queries beside their SQL and compare: python -m tests.check [sf] [names...]"""

import math
import sys
import time
from datetime import date, datetime

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def oracle(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')"
        )
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, int):
        return str(value)
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(df, connection, sql):
    """None if equal, else what differs."""
    result = connection.execute(sql)
    names = [c[0] for c in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    expected = rows_of(names, result.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if len(expected) != len(got):
        return f"{len(got)} rows, expected {len(expected)}"
    for a, b in zip(got, expected):
        if a != b:
            return f"got {a}, expected {b}"
    types = {c[0]: str(c[1]) for c in result.description}
    spark_types = dict(df.dtypes)
    same = {
        "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
        "date": "DATE", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN",
    }
    odd = {n: (spark_types[n], types[n]) for n in names if same.get(spark_types[n]) != types[n]}
    return f"types {odd}" if odd else None


def main():
    sys.path.insert(0, ".")
    import __spark_entry__ as entry

    from repolume.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    connection = oracle(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, query in queries.items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            if name in oracles:
                verdict = compare(df, connection, oracles[name])
            else:
                verdict = None if df.count() > 0 else "no rows"
        except Exception as error:
            verdict = f"{type(error).__name__}: {str(error)[:600]}"
        bad += verdict is not None
        kind = "sql" if name in oracles else "rows"
        print(f"{'ok ' if verdict is None else 'BAD'} {kind:4} {time.time() - start:6.2f}s {name} {verdict or ''}", flush=True)
    print("unmatched oracles:", sorted(set(oracles) - set(queries)))
    print("bad:", bad)


if __name__ == "__main__":
    main()
