"""Comparing a registered query with its SQL, as a multiset of rows and by column types.

    python tests/oracle.py [sf_dir] [name ...]
"""

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# DuckDB type -> Spark type, for the types that queries return.
TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
    "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz",
}


def database(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def differences(df, con, sql):
    """Problems found, as text; an empty list means both sides agree."""
    rel = con.sql(sql)
    columns = sorted(rel.columns)
    if sorted(df.columns) != columns:
        return [f"columns {sorted(df.columns)} against {columns}"]
    theirs = {c: TYPES.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types)}
    ours = {f.name: f.dataType.simpleString() for f in df.schema}
    out = [f"type of {c}: {ours[c]} against {theirs[c]}" for c in columns if ours[c] != theirs[c]]
    left = Counter(tuple(r) for r in df.select(*columns).collect())
    right = Counter(con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall())
    if left != right:
        out.append(f"{left.total()} rows against {right.total()}")
        out += [f"only in Spark: {r}" for r in list((left - right))[:3]]
        out += [f"only in SQL: {r}" for r in list((right - left))[:3]]
    if not left:
        out.append("no rows")
    return out


if __name__ == "__main__":
    import __spark_entry__ as entry

    from evenkeel import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    session = build_session(
        "oracle", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="8g"
    )
    session.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = database(sf), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        began = time.time()
        try:
            found = differences(fn(session, sf), con, sqls[name]) if name in sqls else [f"{fn(session, sf).count()} rows, no SQL"]
        except Exception as e:  # a failing query is one line of the report
            found = [f"{type(e).__name__}: {str(e)[:600]}"]
        bad += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {name} {time.time() - began:.1f}s", *found, sep="\n     " if found else " ", flush=True)
    print(f"{bad} failed")
