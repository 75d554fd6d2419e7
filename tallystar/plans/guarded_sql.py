"""Read-only SQL over an allow-listed set of tables, with a cap for texts without a limit and a result envelope."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystar.operators.profile import PREVIEW_ROWS, PROFILE_ABOVE_ROWS, result_profile
from tallystar.operators.traces import sql_trace
from tallystar.session import scratch_path

# --- fixed values: limits, keywords and messages of the SQL surface ---

ROW_CAP = 10_000
ALLOWED_FIRST = ("SELECT", "WITH")
DANGEROUS_WORDS = ["DROP", "DELETE", "UPDATE", "INSERT", "ALTER", "TRUNCATE", "CREATE"]
EMPTY_MESSAGE = "Empty SQL query"
MANY_MESSAGE = "Multiple SQL statements not allowed. Only single SELECT or WITH queries permitted."
KIND_MESSAGE = "Only SELECT and WITH (CTE) queries are allowed. Got: "

# --- end of fixed values ---

_LITERAL_OR_COMMENT = re.compile(
    r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|--[^\n]*|/\*.*?\*/""", re.DOTALL
)
_REFLECTION = re.compile(r"\b(?:try_reflect|reflect|java_method)\b", re.IGNORECASE)
# Leaves of a plan that hold nothing but what the text itself says.
_OWN_LEAVES = ("OneRowRelation", "LocalRelation", "CTERelationRef", "UnionLoopRef")
_AT = "__at"
_KEPT_SETTINGS = ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")

TableLoader = Callable[[SparkSession], DataFrame]


def rejection(sql: str) -> str | None:
    """Why a text is not a single read-only statement, or null."""
    bare = _LITERAL_OR_COMMENT.sub(" ", sql or "").strip()
    if not bare:
        return EMPTY_MESSAGE
    body = re.sub(r";\s*$", "", bare)
    if ";" in body:
        return MANY_MESSAGE
    first = re.match(r"[^\s(]*", body).group(0).upper()
    if first not in ALLOWED_FIRST:
        return KIND_MESSAGE + (first or body[:1])
    if first == "WITH" and "SELECT" not in body.upper():
        return "WITH clause must be followed by SELECT"
    if _REFLECTION.search(body.replace("`", "")):
        return "Calls into the JVM are not allowed"
    return None


def _without_last_semicolon(sql: str) -> str:
    """Blank the closing semicolon, leaving comments and literals as they are."""
    masked = _LITERAL_OR_COMMENT.sub(lambda m: " " * len(m.group(0)), sql)
    at = masked.rstrip().rfind(";")
    return sql if at < 0 else sql[:at] + " " + sql[at + 1 :]


def _below(node) -> list:
    """The plans right below a plan node, those inside its expressions too."""
    found = []
    for plans in (node.children(), node.subqueries()):
        at = plans.iterator()
        while at.hasNext():
            found.append(at.next())
    return found


def outermost_limit(parsed) -> bool:
    """Whether the statement inside ``SELECT * FROM (…)`` is bounded by a limit of its own, by its parsed plan.

    A limit in a subquery, in a common table expression or in one branch of a set operation bounds something else.
    """
    node = parsed
    for kind in ("Project", "SubqueryAlias", "UnresolvedWith"):
        if node.nodeName() == kind:
            node = node.children().head()
    return node.nodeName() == "GlobalLimit"


def outside_relation(analyzed, views: set[str]) -> str | None:
    """A leaf of the analysed plan that is none of the registered views, or null.

    A view is named by one part; a global or permanent view, or a table of any catalog, is something else, and so is a
    function in FROM that brings rows of its own.
    """
    waiting = [analyzed]
    while waiting:
        node = waiting.pop()
        if node.nodeName() == "View":
            named = node.desc().identifier()
            if not node.isTempView() or named.database().isDefined() or named.table() not in views:
                return named.unquotedString()
            continue
        further = _below(node)
        if not further and node.nodeName() not in _OWN_LEAVES:
            return node.nodeName()
        waiting += further
    return None


def audit_sql(sql: Column, word_match: bool = False) -> Column:
    """Struct of ``status`` and ``reason`` for a column of SQL texts, without running them.

    The keyword test is on substrings, so it also rejects a column called ``created_at``;
    ``word_match`` restricts it to whole words.
    """
    upper = F.upper(sql)
    edge = r"\b" if word_match else ""
    keyword = F.coalesce(*[F.when(upper.rlike(f"{edge}{w}{edge}"), F.lit(w)) for w in DANGEROUS_WORDS])
    status = (
        F.when(F.coalesce(F.trim(sql), F.lit("")) == "", "error")
        .when(keyword.isNotNull(), "error")
        .when(sql.rlike("['\"]"), "warning")
        .otherwise("valid")
    )
    reason = (
        F.when(F.coalesce(F.trim(sql), F.lit("")) == "", "empty")
        .when(keyword.isNotNull(), keyword)
        .when(sql.rlike("['\"]"), "string literals")
    )
    return F.struct(status.alias("status"), reason.alias("reason"))


@dataclass
class SqlResult:
    """Outcome of a guarded statement; ``frame`` is lazy and capped at ``cap`` rows if that is set."""

    sql: str
    params: list = field(default_factory=list)
    frame: DataFrame | None = None
    error: str | None = None
    cap: int | None = None
    whole: DataFrame | None = None
    summary_above: int = PROFILE_ABOVE_ROWS
    _out: dict | None = None
    _kept: tuple | None = None

    @property
    def success(self) -> bool:
        return self.error is None

    def envelope(self) -> dict:
        """All rows up to ``summary_above``, else ten rows and statistics; errors are returned.

        The statement runs once: its result is written, and rows, count and statistics are all taken from what was
        written. ``capped`` says whether the cap cut rows.
        """
        if self._out is None:
            self._out = self._enveloped()
        return self._out

    def _enveloped(self) -> dict:
        base = {"success": self.success, "sql": self.sql, "params": self.params}
        if not self.success:
            return base | {"error": self.error}
        try:
            kept, total, capped = self._stored()
            columns = self.frame.columns
            ordered = kept.orderBy(_AT).drop(_AT)
            if total <= self.summary_above:
                return base | {
                    "truncated": False, "capped": capped, "columns": columns,
                    "data": [list(r) for r in ordered.collect()], "row_count": total,
                }
            stats = {
                r["column"]: {k: r[k] for k in ("min", "max", "mean", "median")}
                for r in result_profile(kept.drop(_AT)).collect()
            }
            return base | {
                "truncated": True,
                "capped": capped,
                "summary": f"Query returned {total:,} rows (showing first {PREVIEW_ROWS}).",
                "columns": columns,
                "sample_data": [list(r) for r in ordered.limit(PREVIEW_ROWS).collect()],
                "row_count": total,
                "stats": stats,
            }
        except PySparkException as error:
            return base | {"success": False, "error": str(error)}

    def _stored(self) -> tuple[DataFrame, int, bool]:
        """The result as written, with the place of each row, its count, and whether the cap cut rows.

        One row beyond the cap is written to tell, and then left out. Names are positional in the file, because a result
        may repeat a column name; types that files do not hold are text.
        """
        if self._kept is None:
            path = scratch_path(self.frame.sparkSession, "sql-result")
            names = self.frame.columns
            whole = self.frame if self.cap is None else self.whole.limit(self.cap + 1)
            placed = whole.toDF(*[f"c{i}" for i in range(len(names))])
            as_text = {c: F.col(c).cast("string") for c, kind in placed.dtypes if kind in ("void", "interval")}
            placed = placed.withColumns(as_text).withColumn(_AT, F.monotonically_increasing_id())
            placed.write.parquet(path)
            kept = placed.sparkSession.read.schema(placed.schema).parquet(path)
            total = kept.count()
            capped = self.cap is not None and total > self.cap
            if capped:
                kept, total = kept.where(F.col(_AT) != kept.agg(F.max(_AT)).first()[0]), self.cap
            shown = [n if names.count(n) == 1 else f"{n}_{i}" for i, n in enumerate(names)]
            self._kept = kept.toDF(*shown, _AT), total, capped
        return self._kept

    def to_json(self) -> str:
        return json.dumps(self.envelope(), indent=2, default=str)

    def trace(self) -> dict:
        """Trace record of this statement, with statistics computed also for small results."""
        out = self.envelope()
        if not out["success"]:
            return sql_trace(self.sql, self.params, [], 0, None)
        preview = out.get("data") or out.get("sample_data") or []
        stats = out.get("stats")
        if stats is None and preview:
            from tallystar.operators.profile import column_stats

            stats = {
                r["column"]: {k: r[k] for k in ("min", "max", "mean", "count")}
                for r in column_stats(self._stored()[0].drop(_AT)).collect()
            }
        rows = [dict(zip(out["columns"], row)) for row in preview[:PREVIEW_ROWS]]
        return sql_trace(self.sql, self.params, rows, out["row_count"], stats, out["truncated"])


class GuardedSql:
    """Runs single SELECT or WITH statements in a session that sees only the given tables.

    Wrapping the text in ``SELECT * FROM (...)`` makes anything but a query a parse error. A text without
    a ``LIMIT`` of its own is capped at ``row_cap`` rows; null caps nothing. Results of more than
    ``summary_above`` rows are summarised in the envelope.
    """

    def __init__(self, spark: SparkSession, tables: Mapping[str, TableLoader], row_cap: int | None = ROW_CAP,
                 summary_above: int = PROFILE_ABOVE_ROWS):
        self.row_cap, self.summary_above = row_cap, summary_above
        self.session = spark.newSession()
        for key in _KEPT_SETTINGS:
            self.session.conf.set(key, spark.conf.get(key))
        # Without this a path in FROM would read any file the job can reach.
        self.session.conf.set("spark.sql.runSQLOnFiles", "false")
        for name, load in tables.items():
            load(self.session).createOrReplaceTempView(name)
        self.views = set(tables)

    def run(self, sql: str, params: str | Sequence | None = None) -> SqlResult:
        try:
            values = list(json.loads(params) if isinstance(params, str) and params else params or [])
        except ValueError as error:
            return SqlResult(sql, error=f"parameters are not a JSON array: {error}")
        reason = rejection(sql)
        if reason:
            return SqlResult(sql, values, error=reason)
        wrapped = f"SELECT * FROM (\n{_without_last_semicolon(sql)}\n)"
        try:
            parsed = self.session._jsparkSession.sessionState().sqlParser().parsePlan(wrapped)
            whole = self.session.sql(wrapped, args=values or None)
        except PySparkException as error:
            return SqlResult(sql, values, error=str(error))
        cap = None if outermost_limit(parsed) else self.row_cap
        if outside_relation(whole._jdf.queryExecution().analyzed(), self.views):
            return SqlResult(sql, values, error="Query reads a table outside the allowed set")
        frame = whole if cap is None else whole.limit(cap)
        return SqlResult(sql, values, frame=frame, cap=cap, whole=whole, summary_above=self.summary_above)
