"""Reports over the prediction and access logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.internal import InternalFunction

from cropline.functions.scalars import add_sums, exact_sum, not_nan, round_even, sum_value

SUCCESS = "SUCCESS"
ERROR = "ERROR"


def is_error(prefix: bool = False) -> Column:
    """Exactly ``ERROR``, or with ``prefix`` anything that starts with it."""
    return F.col("status").startswith(ERROR) if prefix else F.col("status") == ERROR


def monitor_summary(log: DataFrame, prefix: bool = False) -> DataFrame:
    """Number of predictions, mean latency of the successful ones, error rate in percent."""
    total = F.count(F.lit(1))
    latency = F.avg(F.when(F.col("status") == SUCCESS, F.col("latency_ms")))
    rate = F.coalesce(F.try_divide(F.count_if(is_error(prefix)), total) * 100, F.lit(0.0))
    return log.agg(
        total.alias("total_predictions"),
        round_even(F.coalesce(latency, F.lit(0.0)), 2).alias("avg_latency_ms"),
        round_even(rate, 2).alias("error_rate_pct"),
    )


def recent(log: DataFrame, n: int = 10) -> DataFrame:
    """Newest rows by id."""
    return log.orderBy(F.col("id").desc()).limit(n)


def latency_history(log: DataFrame, n: int = 20) -> DataFrame:
    """Latencies of the newest successful predictions, oldest first."""
    rows = log.filter(F.col("status") == SUCCESS).select("id", "timestamp", F.col("latency_ms").alias("latency"))
    return recent(rows, n).orderBy("id")


def log_classes(log: DataFrame) -> DataFrame:
    """Display fields of log rows: short status, row class, address."""
    changes = {}
    if "status" in log.columns:
        changes["status_label"] = F.split("status", ":")[0]
        changes["row_class"] = F.when(F.col("status") == SUCCESS, "success").otherwise("error")
    if "action" in log.columns:
        changes["row_class"] = F.when(F.col("action").contains("FAILURE"), "error").otherwise("success")
        blank = F.coalesce(F.col("ip_address"), F.lit("")) == ""
        changes["address"] = F.when(blank, "local").otherwise(F.col("ip_address"))
    return log.withColumns(changes)


LATENCIES, ROWS = 20, 10


def _newest(row: Column, n: int) -> Column:
    """Aggregate: the ``n`` greatest of the rows that are not null, a bounded heap that merges."""
    return InternalFunction.collect_top_k(row, n, False)


def log_state(log: DataFrame, latencies: int = LATENCIES, rows: int = ROWS) -> DataFrame:
    """One row from one scan of a prediction log, from which its report follows: counts, the sum
    of latencies, the newest rows and the newest latencies. States of parts merge.

    Of rows that share an id the order is that of their other fields.
    """
    success = F.col("status") == SUCCESS
    latency = F.when(success, F.col("latency_ms"))
    return log.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(is_error()).alias("errors"),
        F.count(not_nan(latency)).alias("timed"),
        exact_sum(latency).alias("latency"),
        _newest(F.struct("id", "username", "status", "total_value"), rows).alias("predictions"),
        _newest(F.when(success, F.struct("id", F.col("latency_ms").alias("latency"))), latencies).alias("history"),
    )


def merge_states(states: DataFrame, latencies: int = LATENCIES, rows: int = ROWS) -> DataFrame:
    """The state of all parts together."""

    def newest(name: str, n: int) -> Column:
        return F.slice(F.sort_array(F.flatten(F.collect_list(name)), asc=False), 1, n).alias(name)

    sums = [F.coalesce(F.sum(c), F.lit(0).cast("bigint")).alias(c) for c in ("total", "errors", "timed")]
    return states.agg(*sums, add_sums("latency").alias("latency"), newest("predictions", rows), newest("history", latencies))


def _entries(section: str, key: Column, fields: dict[str, Column]) -> Column:
    """Entries of one report row."""
    name, id_ = F.lit(section).alias("section"), key.cast("bigint").alias("row_id")
    return F.array(
        *[F.struct(name, id_, F.lit(f).alias("field"), c.cast("string").alias("value")) for f, c in fields.items()]
    )


def _section(name: str, found: str, fields: dict[str, str | None]) -> Column:
    """Entries of all rows of an aggregated array; fields and what they are cast to."""

    def entries(row: Column) -> Column:
        return _entries(name, row["id"], {f: row[f].cast(kind) if kind else row[f] for f, kind in fields.items()})

    return F.flatten(F.transform(found, entries))


_MONEY = "decimal(18,2)"


def log_report(state: DataFrame) -> DataFrame:
    """The report of a :func:`log_state` in long form: section, row id, field, value."""
    mean = F.coalesce(F.try_divide(sum_value("latency"), F.col("timed")), F.lit(0.0))
    rate = F.coalesce(F.try_divide("errors", "total") * 100, F.lit(0.0))
    summary = _entries(
        "summary",
        F.lit(0),
        {
            "total_predictions": F.col("total"),
            "avg_latency_ms": round_even(mean, 2).cast(_MONEY),
            "error_rate_pct": round_even(rate, 2).cast(_MONEY),
        },
    )
    history = _section("latency_history", "history", {"latency": _MONEY})
    newest = _section("recent_predictions", "predictions", {"username": None, "status": None, "total_value": _MONEY})
    return state.select(F.inline(F.concat(summary, history, newest)))


def monitoring(log: DataFrame, auth: DataFrame, latencies: int = LATENCIES, rows: int = ROWS) -> DataFrame:
    """The whole monitoring report in long form: section, row id, field, value. Each log is scanned once."""
    events = auth.agg(_newest(F.struct("id", "username", "action", "ip_address"), rows).alias("events"))
    shown = _section("recent_auth_events", "events", {"username": None, "action": None, "ip_address": None})
    return log_report(log_state(log, latencies, rows)).unionByName(events.select(F.inline(shown)))
