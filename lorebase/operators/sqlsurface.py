"""The bounded read-only SQL surface (Q1-Q5) and bounded scripts over it."""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Iterable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field
from threading import Thread
from typing import Any
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from ..functions.scalars import clamp
from ..schema import TABLES

#: Plan nodes that a read-only statement may parse to (fixed values; anything else is refused).
READ_NODES = set(
    "Project Filter Aggregate Sort GlobalLimit LocalLimit Limit Offset Distinct Deduplicate Join Union Except Intersect SubqueryAlias UnresolvedRelation UnresolvedWith UnresolvedHaving "
    "UnresolvedSubqueryColumnAliases UnresolvedInlineTable UnresolvedTableValuedFunction UnresolvedTVFAliases Generate LateralJoin Window WithWindowDefinition Pivot Unpivot Sample LocalRelation OneRowRelation "
    "ExplainCommand ShowTables ShowTablesCommand ShowColumns ShowNamespaces ShowFunctions DescribeRelation DescribeColumn DescribeQueryCommand UnresolvedNamespace UnresolvedTableOrView UnresolvedFunctionName CurrentNamespace UnresolvedAttribute ResolvedInlineTable".split()
)
#: Functions that reach outside the tables (fixed values).
REFUSED_FUNCTIONS = {"java_method", "reflect", "try_reflect", "input_file_name", "read_files", "raise_error", "sleep"}
_PATH_FORMATS = {"parquet", "orc", "json", "csv", "text", "avro", "binaryfile", "delta"}


class Refused(ValueError):
    pass


def check_read_only(spark: SparkSession, sql: str) -> None:
    """Q1, Q2: parses one statement and walks its whole plan, subqueries too; refuses what isn't a read of named tables."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql.strip().rstrip(";"))
    except Exception as e:
        raise Refused(f"not one statement that parses: {str(e).splitlines()[0]}") from None
    _walk(plan, set())


def _walk(plan: Any, seen: set[str]) -> None:
    name = plan.nodeName() if hasattr(plan, "nodeName") else plan.getClass().getSimpleName()
    short = plan.getClass().getSimpleName().rstrip("$")
    if short not in READ_NODES and name not in READ_NODES:
        raise Refused(f"{short} is not a read")
    if short == "UnresolvedRelation":
        parts = [str(p) for p in _items(plan.multipartIdentifier())]
        if len(parts) > 1 and parts[0].lower() in _PATH_FORMATS:
            raise Refused("tables by path are not allowed")
    for child in _items(plan.children()):
        _walk(child, seen)
    for inner in _items(plan.innerChildren()):
        if hasattr(inner, "getClass") and "logical" in inner.getClass().getName():
            _walk(inner, seen)
    if short == "UnresolvedWith":
        for pair in _items(plan.cteRelations()):
            _walk(pair._2(), seen)
    if short == "ExplainCommand":
        _walk(plan.logicalPlan(), seen)
    if short == "DescribeQueryCommand":
        _walk(plan.plan(), seen)
    for e in _items(plan.expressions()):
        _expression(e, seen)


def _expression(e: Any, seen: set[str]) -> None:
    short = e.getClass().getSimpleName()
    if short == "UnresolvedFunction":
        parts = [str(p).lower() for p in _items(e.nameParts())]
        if parts[-1] in REFUSED_FUNCTIONS:
            raise Refused(f"function {parts[-1]} is not allowed")
    if short in ("ScalarSubquery", "ListQuery", "Exists", "LateralSubquery"):
        _walk(e.plan(), seen)
    for child in _items(e.children()):
        _expression(child, seen)


def _items(seq: Any) -> Iterable[Any]:
    return [seq.apply(i) for i in range(seq.size())]


@dataclass
class SQLResult:
    """Q4."""

    sql: str
    columns: list[str]
    rows: list[list[Any]]
    row_count: int
    max_rows: int
    truncated: bool
    elapsed_ms: int


def query_sql(spark: SparkSession, sql: str, max_rows: int = 1000) -> SQLResult:
    """Q3: a read-only statement with at most max_rows rows; one more is asked for to know whether there are."""
    check_read_only(spark, sql)
    n, began = clamp(max_rows, 1000, 10_000), time.time()
    rows = spark.sql(sql.strip().rstrip(";")).limit(n + 1).collect()
    kept = [list(r) for r in rows[:n]]
    columns = list(rows[0].__fields__) if rows else spark.sql(sql.strip().rstrip(";")).columns
    return SQLResult(sql, columns, kept, len(kept), n, len(rows) > n, int(1000 * (time.time() - began)))


#: What joins what (fixed values).
RELATIONSHIPS = ["versions.object_id = facts.object_id", "versions.object_id = changes.object_id", "versions.object_id = object_aliases.object_id", "edges.src_id = object_aliases.alias_id", "edges.dst_id = object_aliases.alias_id", "observations.cluster_id = clusters.name", "observations.(api_group, resource) = api_resources.(api_group, resource)", "ingestion_offsets.(api_group, resource) = api_resources.(api_group, resource)", "filter_decisions.(cluster_id, kind, namespace, name) = observations.(cluster_id, kind, namespace, name)", "agent_runs.session_id = agent_sessions.session_id", "agent_run_events.run_id = agent_runs.run_id"]


def query_schema() -> dict[str, Any]:
    """Q5: tables, columns, relationships and recipes."""
    from ..plans.recipes import RECIPES

    columns = {t: [dict(zip(("name", "type"), c.strip().split(" ", 1), strict=True)) for c in ddl.split(", ")] for t, ddl in TABLES.items()}
    return {"tables": columns, "relationships": RELATIONSHIPS, "recipes": {n: (f.__doc__ or "").strip() for n, f in RECIPES.items()}, "notes": ["Strings are never null; '' means absent.", "Edges without valid_to go on.", "Use object_aliases before joining edges with versions."]}


@dataclass
class Script:
    """What a bounded script may use. Bounds are clamped as given; breaking one raises Refused."""

    spark: SparkSession
    max_queries: int = 6
    max_rows: int = 100
    max_output: int = 128 << 10
    used: int = 0
    scratch: dict[str, str] = field(default_factory=dict)
    group: str = field(default_factory=lambda: f"script-{uuid4().hex}")

    def __post_init__(self) -> None:
        self.max_queries, self.max_rows = clamp(self.max_queries, 6, 10), clamp(self.max_rows, 100, 10_000)
        self.max_output = min(max(self.max_output, 16 << 10), 512 << 10)

    def _reserve(self, n: int) -> None:
        if self.used + n > self.max_queries:
            raise Refused(f"more than {self.max_queries} queries")
        self.used += n

    def _run(self, sql: str, max_rows: int | None) -> list[dict]:
        self.spark.sparkContext.setJobGroup(self.group, "script", interruptOnCancel=True)
        r = query_sql(self.spark, sql, min(max_rows or self.max_rows, self.max_rows))
        return [{c: clean(v) for c, v in zip(r.columns, row, strict=True)} for row in r.rows]

    def sql(self, sql: str, max_rows: int | None = None) -> list[dict]:
        self._reserve(1)
        return self._run(sql, max_rows)

    def sql_all(self, statements: list[str], max_rows: int | None = None) -> list[list[dict]]:
        """Several at once; the quota is taken up front."""
        self._reserve(len(statements))
        with ThreadPoolExecutor(max(1, len(statements))) as pool:
            return list(pool.map(lambda s: self._run(s, max_rows), statements))

    def write(self, name: str, value: Any) -> None:
        text = json.dumps(value, default=str)
        if len(text) > self.max_output:
            raise Refused("scratch value too large")
        self.scratch[name] = text

    def read(self, name: str) -> Any:
        return json.loads(self.scratch[name])

    def names(self) -> list[str]:
        return sorted(self.scratch)


def clean(value: Any) -> Any:
    """U4: numbers that aren't finite are null."""
    return None if isinstance(value, float) and not math.isfinite(value) else value


def run_script(script: Callable[[Script], Any], spark: SparkSession, timeout_s: float = 3, **bounds: int) -> Any:
    """Runs a Python function with a Script; its result as JSON must fit the output bound, its time the limit (at most 8 s). At the limit its Spark
    jobs are cancelled and TimeoutError is raised at once; a thread that computes without Spark is left behind, its result unread."""
    s = Script(spark, **bounds)
    found: Future = Future()

    def work() -> None:
        try:
            found.set_result(script(s))
        except BaseException as e:  # noqa: BLE001  goes to the caller
            found.set_exception(e)

    Thread(target=work, daemon=True).start()
    try:
        result = found.result(timeout=min(timeout_s, 8))
    except TimeoutError:
        s.used = s.max_queries  # it may start no more
        spark.sparkContext.cancelJobGroup(s.group)
        raise
    if len(json.dumps(result, default=str)) > s.max_output:
        raise Refused("output too large")
    return result


def group_by(rows: list[dict], key: str) -> dict[Any, list[dict]]:
    """Helpers for a script's bounded rows."""
    out: dict[Any, list[dict]] = {}
    for r in rows:
        out.setdefault(r.get(key), []).append(r)
    return out


def count_by(rows: list[dict], key: str) -> dict[Any, int]:
    return {k: len(v) for k, v in group_by(rows, key).items()}


def sum_by(rows: list[dict], key: str, value: str) -> dict[Any, float]:
    number = lambda v: v if isinstance(v, int | float) and not isinstance(v, bool) else 0
    return {k: sum(number(r.get(value)) for r in v) for k, v in group_by(rows, key).items()}


def sort_by(rows: list[dict], key: str, descending: bool = False) -> list[dict]:
    return sorted(rows, key=lambda r: (r.get(key) is None, r.get(key)), reverse=descending)


def uniq_by(rows: list[dict], key: str) -> list[dict]:
    return [v[0] for v in group_by(rows, key).values()]


def pick(rows: list[dict], *keys: str) -> list[dict]:
    return [{k: r.get(k) for k in keys} for r in rows]


def register_functions(spark: SparkSession) -> None:
    """The engine's functions by name in SQL."""
    from ..functions.scalars import fnv1a64
    from .filters import redact_secret

    spark.udf.register("fnv1a64", fnv1a64)
    spark.udf.register("redact_secret", redact_secret)


def register_views(tables: dict[str, DataFrame]) -> None:
    """K7: tables as temporary views."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
