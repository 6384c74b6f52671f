"""Run registered queries in Spark and their SQL in DuckDB and compare whole results."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from workload.target_view import TABLES  # noqa: E402


def connect(sf_dir: str):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 9)
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cells = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(cells, key=lambda r: tuple((x is None, str(x)) for x in r))


_KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def compare(df, db, sql: str) -> str | None:
    """None if both agree in column names, types and all values, else what differs."""
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    theirs = _rows(names, result.fetchall())
    ours = _rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"first difference {a} != {b}"
    kinds = {d[0]: str(d[1]) for d in result.description}
    for name, kind in df.dtypes:
        if _KINDS.get(kind) != kinds[name]:
            return f"type of {name}: {kind} != {kinds[name]}"
    if not ours:
        return "both empty"
    return None


def main(sf_dir: str, only: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from mercalith.session import get_session

    spark = get_session(
        master="local[8]",
        conf={"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g",
              "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("OFF")
    db, bad = connect(sf_dir), 0
    for name, run in queries().items():
        if only and name not in only:
            continue
        begin = time.time()
        try:
            problem = compare(run(spark, sf_dir), db, oracle_sql()[name])
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        print(f"{name:28s} {time.time() - begin:6.2f}s  {problem or 'ok'}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
