"""Run catalogue queries next to their SQL twins and report every difference.

    python tests/oracle.py [--sf 0.01] [name or prefix ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb
import pyarrow as pa

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _family(t: pa.DataType) -> str:
    if pa.types.is_large_string(t) or pa.types.is_string(t):
        return "string"
    if pa.types.is_timestamp(t):
        return "timestamp"
    if pa.types.is_list(t):
        return f"list<{_family(t.value_type)}>"
    return str(t)


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def compare(got: pa.Table, want: pa.Table) -> str | None:
    """None when equal, else what differs."""
    gs = {f.name: _family(f.type) for f in got.schema}
    ws = {f.name: _family(f.type) for f in want.schema}
    if gs != ws:
        return f"schema {sorted(gs.items() ^ ws.items())}"
    if got.num_rows != want.num_rows:
        return f"rows {got.num_rows} vs {want.num_rows}"
    names = sorted(gs)
    rows = [sorted(tuple(_cell(r[n]) for n in names) for r in t.to_pylist()) for t in (got, want)]
    for g, w in zip(*rows):
        if g != w:
            bad = [f"{n}: {a[:80]} vs {b[:80]}" for n, a, b in zip(names, g, w) if a != b]
            count = sum(x != y for x, y in zip(*rows))
            return f"{count} rows differ, first: {'; '.join(bad)}"
    return None


def main() -> int:
    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="0.01")
    args.add_argument("names", nargs="*")
    opts = args.parse_args()
    from bench import session

    import __spark_entry__ as entry

    spark = session(8)
    sf_dir = f"/root/testdata/sf{opts.sf}"
    con = duck(sf_dir)
    sqls = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if opts.names and not any(name.startswith(n) for n in opts.names):
            continue
        start = time.time()
        try:
            got = fn(spark, sf_dir).toArrow()
            took = time.time() - start
            if name in sqls:
                want = con.execute(sqls[name]).to_arrow_table()
                problem = compare(got, want)
            else:
                problem = None if got.num_rows else "no rows"
        except Exception as e:  # report and go on
            took, problem = time.time() - start, f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        mark = "ok  " if problem is None else "FAIL"
        print(f"{mark} {name} {took:.2f}s rows={got.num_rows if problem is None else '-'} {'' if name in sqls else '(rows only)'} {problem or ''}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
