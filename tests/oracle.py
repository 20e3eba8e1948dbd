"""Run registered queries next to their SQL on the same tables and compare whole results."""
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(d):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return round(float(v), 4) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return str(v)


def compare(spark, con, d, fn, sql, show=3):
    t0 = time.time()
    df = fn(spark, d)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    t1 = time.time()
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    if sorted(names) != cols:
        return f"columns differ: {cols} vs {sorted(names)}", len(got), t1 - t0
    ix = [names.index(c) for c in cols]
    want = sorted((tuple(norm(r[i]) for i in ix) for r in cur.fetchall()), key=repr)
    if got == want:
        return None, len(got), t1 - t0
    sg, sw = set(got), set(want)
    a, b = [g for g in got if g not in sw][:show], [w for w in want if w not in sg][:show]
    return f"{len(got)} vs {len(want)} rows\n   cols {cols}\n   spark only {a}\n   sql only   {b}", len(got), t1 - t0


def main(d, names):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as e
    from shotweave.session import local_session
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con, q, o = connect(d), e.queries(), e.oracle_sql()
    bad = 0
    for n in q:
        if names and not any(n.startswith(x) or x in n for x in names):
            continue
        try:
            if n in o:
                err, rows, secs = compare(spark, con, d, q[n], o[n])
            else:
                t0 = time.time()
                rows = len(q[n](spark, d).collect())
                err, secs = None, time.time() - t0
        except Exception as x:                                      # keep going through the list
            err, rows, secs = "ERROR " + str(x)[:1500], 0, 0
        bad += err is not None
        print(("ok  " if err is None else "BAD ") + ("" if n in o else "(no sql) ") + n, rows, f"{secs:.2f}s", err or "", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
