"""Run a query and its SQL on the same tables and compare whole results strictly."""
from __future__ import annotations

import time

import duckdb
from popweave.catalog import QUERIES, SQL, load_all
from popweave.session import TABLES


LAST: dict[str, str] = {}


def sql_connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(columns: list[str], rows: list) -> tuple[dict, list]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    kinds = {columns[i]: {type(r[i]).__name__ for r in rows if r[i] is not None and r[i] == r[i]} for i in order}
    return kinds, sorted(tuple("NULL" if r[i] is None or r[i] != r[i] else repr(r[i] + 0.0) if isinstance(r[i], float)
                               else str(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, sf_dir: str) -> tuple[str, str, int, float]:
    t0 = time.time()
    df = QUERIES[name](spark, sf_dir)
    got = df.collect()
    LAST["plan"] = df._jdf.queryExecution().executedPlan().toString()
    dt = time.time() - t0
    if name not in SQL:
        return "rows-only", "", len(got), dt
    cur = con.execute(SQL[name])
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(cols):
        return "FAIL", f"columns {sorted(df.columns)} vs {sorted(cols)}", len(got), dt
    (ka, a), (kb, b) = canon(df.columns, got), canon(cols, want)
    if a != b:
        sa, sb = set(a), set(b)
        return "FAIL", (f"rows {len(a)} vs {len(b)}; cols {sorted(cols)}; only spark {len(sa - sb)} {sorted(sa - sb)[:3]}; "
                        f"only sql {sorted(sb - sa)[:3]}"), len(got), dt
    if ka != kb:
        return "FAIL", f"kinds {ka} vs {kb}", len(got), dt
    return "ok", "", len(got), dt


if __name__ == "__main__":
    import sys
    sys.path.insert(0, ".")
    from popweave.session import local_session
    load_all()
    prefixes = sys.argv[2:]
    sf = f"/root/testdata/sf{sys.argv[1]}"
    spark, con = local_session(), sql_connection(sf)
    bad = 0
    for name in QUERIES:
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            s, msg, n, dt = compare(spark, con, name, sf)
        except Exception as e:                                  # noqa: BLE001
            s, msg, n, dt = "ERROR", str(e)[:700], 0, 0.0
        bad += s in ("FAIL", "ERROR")
        plan = LAST.pop("plan", "")
        if "NestedLoop" in plan or "CartesianProduct" in plan:
            msg += " NESTED LOOP"
        if s != "ok" or n == 0 or dt > 6 or msg:
            print(f"{name:34s} {s:9s} rows={n:<7d} {dt:5.1f}s {msg}", flush=True)
    print("bad", bad)
