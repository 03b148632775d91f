"""Run a registered query and its SQL over the same tables and compare the rows."""

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'").fetchall()
    return con


def _cell(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, float):
        return "NULL" if math.isnan(value) else repr(value)
    if isinstance(value, bool):
        return str(int(value))
    return str(value)


def _normal(names, rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(spark, con, query, sql: str, sf_dir: str) -> list[str]:
    df = query(spark, sf_dir)
    ours = [tuple(r) for r in df.collect()]
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    problems = []
    plan = df._jdf.queryExecution().executedPlan().toString()
    problems += [f"plan holds {join}" for join in ("CartesianProduct", "BroadcastNestedLoopJoin") if join in plan]
    if sorted(df.columns) != sorted(names):
        problems.append(f"columns differ: {sorted(set(df.columns) ^ set(names))}")
        return problems
    if not ours:
        problems.append("no rows")
    if len(ours) != len(theirs):
        problems.append(f"{len(ours)} rows instead of {len(theirs)}")
    a, b = _normal(df.columns, ours), _normal(names, theirs)
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        problems.append(f"{len(wrong)} rows differ, e.g. {str(wrong[0][0])[:300]} / {str(wrong[0][1])[:300]}")
    return problems
