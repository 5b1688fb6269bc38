"""Compare a Spark result with its SQL twin in DuckDB."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _value(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, float):
        if math.isnan(v):
            return (0, "")
        return (2, f"{v:.9g}")
    if isinstance(v, int):
        return (2, f"{float(v):.9g}") if abs(v) < 2**53 else (2, str(v))
    return (3, str(v))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_value(r[i]) for i in order) for r in rows)


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp": "TIMESTAMP",
}


def compare(con, spark, name: str, folder: str, queries, oracle) -> str:
    """'' when equal, otherwise what differs."""
    df = queries[name](spark, folder)
    got = [tuple(r) for r in df.collect()]
    if name not in oracle:
        return "" if got else "no rows"
    cur = con.execute(oracle[name])
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    notes = []
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    for c, kind in df.dtypes:
        if TYPES.get(kind, kind) != types[c]:
            notes.append(f"type of {c}: {kind} / {types[c]}")
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a != b:
        in_a, in_b = set(a), set(b)
        left, right = [x for x in a if x not in in_b], [x for x in b if x not in in_a]
        return f"rows {len(a)} / {len(b)}; only spark {len(left)} {left[:3]}; only sql {len(right)} {right[:3]}"
    if not a:
        notes.append("empty result")
    return ("note: " + "; ".join(notes)) if notes else ""


if __name__ == "__main__":
    import __spark_entry__ as entry

    from pageloom.session import local_session

    folder = f"/root/testdata/{sys.argv[1]}"
    picked = sys.argv[2:]
    spark, con = local_session(), connect(folder)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in queries:
        if picked and name not in picked and not any(p.startswith("@") and p[1:] in name for p in picked):
            continue
        start = time.time()
        try:
            note = compare(con, spark, name, folder, queries, oracle)
        except Exception as exc:  # noqa: BLE001
            note = f"{type(exc).__name__}: {str(exc)[:700]}"
        mark = "ok " if not note else ("~  " if note.startswith("note") else "BAD")
        bad += mark == "BAD"
        print(f"{mark} {name} {time.time() - start:.1f}s {note[:1500]}", flush=True)
    print("bad:", bad)
