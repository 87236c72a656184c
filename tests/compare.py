"""Compare registered queries with their SQL twins: names, types, row counts, values."""

from __future__ import annotations

import datetime as dt
import sys
import tempfile
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return v + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _sorted(rows):
    return sorted((tuple(_norm(v) for v in r) for r in rows), key=repr)


_SAME = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP",
    "timestamp_ntz": "TIMESTAMP",
}


def difference(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    rel = con.sql(sql)
    names = sorted(df.columns)
    if names != sorted(rel.columns):
        return f"columns {sorted(set(names) ^ set(rel.columns))}"
    types = dict(zip(rel.columns, map(str, rel.types)))
    for f in df.schema.fields:
        want = _SAME.get(f.dataType.simpleString(), "?")
        if types[f.name] != want:
            return f"type of {f.name}: spark {f.dataType.simpleString()}, duckdb {types[f.name]}"
    ours = _sorted(df.select(*names).collect())
    quoted = ", ".join(f'"{n}"' for n in names)
    theirs = _sorted(con.sql(f"select {quoted} from ({sql})").fetchall())
    if len(ours) != len(theirs):
        return f"rows: spark {len(ours)}, duckdb {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b:
            cells = [(n, x, y) for n, x, y in zip(names, a, b) if x != y]
            return f"values: {cells[:4]}"
    return None


def main(sf_dir: str, only: list[str]) -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from creditloom.session import local_session

    spark = local_session(8, shared=f"file://{tempfile.mkdtemp()}")
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sql:
                problem = difference(df, con, sql[name])
                state = "ok" if problem is None else "DIFF " + problem
                bad += problem is not None
            else:
                state = f"rows {df.count()}"
        except Exception as e:  # report and go on with the next query
            state, bad = f"ERROR {type(e).__name__}: {str(e)[:1500]}", bad + 1
        print(f"{name:24s} {time.time() - start:6.2f}s  {state}", flush=True)
    print("not matching:", bad)
    return bad


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
