"""Data-quality checks and the gate they form.

A check is a row ``(check, category, blocking, violations)``. A report groups
checks into categories: a violated blocking check fails its category, a
violated advisory one warns. Everything stays lazy until a gate asks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.plans.lifecycle import Sources, latest_day, staged_accounts

# The categories of the report and the verdicts.
GRAIN = "1 grain"
NULLS = "2 unexpected nulls"
INTEGRITY = "3 referential integrity"
DRIFT = "4 dimensional drift"
RECONCILIATION = "5 reconciliation"
PASS, WARN, FAIL = "pass", "warn", "fail"
TXN_COUNT_RANGE = (1, 1000)


class QualityGateFailed(RuntimeError):
    """A blocking check found violations, so nothing was published."""


def as_check(
    counted: DataFrame, violations: Column | str, name: str, category: str, blocking: bool = True
) -> DataFrame:
    """A one-row frame with a counter, as a check."""
    value = F.col(violations) if isinstance(violations, str) else violations
    return counted.select(
        F.lit(name).alias("check"),
        F.lit(category).alias("category"),
        F.lit(blocking).alias("blocking"),
        F.coalesce(value, F.lit(0)).cast("long").alias("violations"),
    )


def duplicate_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many keys occur more than once."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.count_if(F.col("n") > 1).alias("violations"))


def unexpected_values(rows: DataFrame, column: str, known: Sequence[str]) -> DataFrame:
    """How many distinct non-NULL values lie outside the known set."""
    values = rows.select(column).distinct()
    return values.agg(F.count_if(~F.col(column).isin(*known)).alias("violations"))


def out_of_range(rows: DataFrame, column: str, low: int, high: int) -> DataFrame:
    """How many rows lie outside ``[low, high]``."""
    outside = (F.col(column) < low) | (F.col(column) > high)
    return rows.agg(F.count_if(outside).alias("violations"))


def null_count(rows: DataFrame, column: str) -> DataFrame:
    return rows.agg(F.count_if(F.col(column).isNull()).alias("violations"))


def orphans(children: Sequence[DataFrame], parent: DataFrame, key: str) -> DataFrame:
    """Distinct keys of the children that the parent does not have.

    An anti join, not ``NOT IN``: a NULL in the parent would make that empty.
    Keys are distinct on both sides before the join, by an aggregate with a map-side step,
    so no key is heavier than another.
    """
    ids = reduce(DataFrame.unionAll, (child.select(key) for child in children))
    known = parent.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 0").select(key)
    return ids.where(F.col(key).isNotNull()).distinct().join(known, key, "left_anti")


def null_state(datelist: DataFrame) -> DataFrame:
    """Days without a status, or open before the account existed."""
    bad = F.col("is_open").isNull() | (
        F.col("is_open") & (F.col("snapshot_date") < F.col("created_date"))
    )
    return datelist.agg(F.count_if(bad).alias("violations"))


def _per_account(datelist: DataFrame) -> DataFrame:
    """What the checks need of each account, in one pass over a stored history."""
    bad_state = F.col("is_open").isNull() | (
        F.col("is_open") & (F.col("snapshot_date") < F.col("created_date"))
    )
    return (
        datelist.groupBy("account_id", "snapshot_date")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(bad_state).alias("bad"))
        .groupBy("account_id")
        .agg(
            F.sum("n").alias("days"),
            F.count_if(F.col("n") > 1).alias("duplicates"),
            F.sum("bad").alias("bad"),
            F.min("snapshot_date").alias("first_day"),
            F.max("snapshot_date").alias("last_day"),
        )
    )


def _broken(last: Column) -> Column:
    return (
        (F.col("days") != F.date_diff(last, F.col("created_date")) + 1)
        | (F.col("first_day") != F.col("created_date"))
        | (F.col("last_day") != last)
    )


def reconcile_counts(datelist: DataFrame, accounts: DataFrame) -> DataFrame:
    """Distinct accounts in the history next to those in the source, from one union."""
    sides = datelist.select("account_id", F.lit(0).alias("side")).unionAll(
        accounts.select("account_id", F.lit(1).alias("side"))
    )
    return sides.groupBy("account_id").agg(F.max("side").alias("source"), F.min("side").alias("modelled")).agg(
        F.sum("source").cast("long").alias("source"), F.count_if(F.col("modelled") == 0).alias("modelled")
    )


def broken_spines(datelist: DataFrame, accounts: DataFrame, last: Column) -> DataFrame:
    """Accounts whose days are not exactly all days from creation to the ``last`` one.

    Reduced to one row per account before the join.
    """
    spans = datelist.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("days"),
        F.min("snapshot_date").alias("first_day"),
        F.max("snapshot_date").alias("last_day"),
    )
    expected = (F.date_diff(last, F.col("created_date")) + 1).cast("long")
    return (
        spans.join(accounts.select("account_id", "created_date"), "account_id")
        .where(_broken(last))
        .select("account_id", "days", expected.alias("expected_days"), "first_day", "last_day")
    )


def transactions_before_creation(sources: Sources) -> DataFrame:
    """Activity that predates its account."""
    accounts = staged_accounts(sources.created).select("account_id", "created_date")
    return sources.transactions.join(accounts, "account_id").where(
        F.col("txn_date") < F.col("created_date")
    )


def _history_checks(datelist: DataFrame, accounts: DataFrame, last: Column) -> DataFrame:
    """Grain, status, spine and account count of a stored history in one pass over it."""
    both = _per_account(datelist).withColumn("modelled", F.lit(True)).join(
        accounts.select("account_id", "created_date"), "account_id", "full_outer"
    )
    broken = _broken(last)
    counters = both.agg(
        F.coalesce(F.sum("duplicates"), F.lit(0)).alias("duplicates"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"),
        F.count_if(broken).alias("broken"),
        F.abs(F.count("modelled") - F.count("created_date")).alias("unreconciled"),
    )

    def check(name: str, category: str, counter: str) -> Column:
        return F.struct(
            F.lit(name).alias("check"),
            F.lit(category).alias("category"),
            F.lit(True).alias("blocking"),
            F.col(counter).cast("long").alias("violations"),
        )

    return counters.select(
        F.inline(
            F.array(
                check("duplicate_days", GRAIN, "duplicates"),
                check("null_state", NULLS, "bad"),
                check("broken_spines", RECONCILIATION, "broken"),
                check("unreconciled_accounts", RECONCILIATION, "unreconciled"),
            )
        )
    )


def account_orphans(sources: Sources) -> DataFrame:
    """Accounts that were closed or active but never created. No history has rows for them."""
    return orphans([sources.closed, sources.transactions], sources.created, "account_id")


def account_checks(
    sources: Sources,
    datelist: DataFrame,
    known_types: Sequence[str],
    last: Column | None = None,
    set_apart: DataFrame | None = None,
) -> DataFrame:
    """All checks of the account model: six blocking groups, two advisory ones.

    Give ``datelist`` as read back from storage: the checks judge what was written, in one pass
    over it. ``last`` is the last day it should have; by default that of the sources.

    ``set_apart`` lists orphans that were written beside the history. Those warn, by an advisory
    check of their own; any other orphan still blocks.
    """
    last = latest_day(sources).scalar() if last is None else last
    staged = staged_accounts(sources.created)
    accounts = staged.select("account_id", "created_date")
    missing = account_orphans(sources)
    if set_apart is not None:
        missing = missing.join(set_apart, "account_id", "left_anti")
    early = transactions_before_creation(sources)
    count = F.count(F.lit(1))
    parts = [
        _history_checks(datelist, accounts, last),
        as_check(
            unexpected_values(staged, "account_type", known_types),
            "violations",
            "unknown_account_types",
            DRIFT,
        ),
        as_check(
            duplicate_keys(sources.transactions, ["account_id", "txn_date"]),
            "violations",
            "duplicate_activity",
            GRAIN,
        ),
        as_check(
            null_count(sources.created, "account_type"),
            "violations",
            "null_account_type",
            NULLS,
            blocking=False,
        ),
        as_check(missing.agg(count.alias("n")), "n", "orphans", INTEGRITY),
        as_check(
            out_of_range(sources.transactions, "txn_count", *TXN_COUNT_RANGE),
            "violations",
            "txn_count_out_of_range",
            DRIFT,
        ),
        as_check(
            early.agg(count.alias("n")),
            "n",
            "transactions_before_creation",
            RECONCILIATION,
            blocking=False,
        ),
    ]
    if set_apart is not None:
        counted = set_apart.agg(F.count_distinct("account_id").alias("n"))
        parts.append(as_check(counted, "n", "orphans_set_apart", INTEGRITY, blocking=False))
    return reduce(DataFrame.unionByName, parts)


def quality_report(checks: DataFrame) -> DataFrame:
    """One row per category: pass, warn or fail, and the counters behind it."""
    violated = F.col("violations") > 0
    return (
        checks.groupBy("category")
        .agg(
            F.count_if(violated & F.col("blocking")).alias("_blocking"),
            F.count_if(violated & ~F.col("blocking")).alias("_advisory"),
            F.array_join(
                F.array_sort(F.collect_list(F.concat_ws("=", "check", F.col("violations").cast("string")))),
                ", ",
            ).alias("detail"),
        )
        .select(
            "category",
            F.when(F.col("_blocking") > 0, FAIL)
            .when(F.col("_advisory") > 0, WARN)
            .otherwise(PASS)
            .alias("result"),
            "detail",
        )
        .orderBy("category")
    )


def require_passed(report: DataFrame) -> None:
    """Raise if a category failed. Brings the failed rows of the report, at most one
    per category, to the driver."""
    failed = report.where(F.col("result") == FAIL).collect()
    if failed:
        raise QualityGateFailed("; ".join(f"{row.category}: {row.detail}" for row in failed))


def freshness(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """The newest value of the time column of each table."""
    newest = [
        rows.agg(F.max(column).cast("timestamp_ntz").alias("newest")).select(
            F.lit(name).alias("table_name"), "newest"
        )
        for name, (rows, column) in tables.items()
    ]
    return reduce(DataFrame.unionByName, newest)


def staleness(upstream: DataFrame, derived: DataFrame, key: str, modified: str) -> DataFrame:
    """Items whose derived counterpart is missing or older than they are.

    ``derived`` may hold several rows per item; only the newest counts, and it is
    found before the join.
    """
    newest = derived.groupBy(key).agg(F.max(modified).alias("_derived"))
    source = upstream.groupBy(key).agg(F.max(modified).alias("_upstream"))
    problem = F.when(F.col("_derived").isNull(), "missing").when(
        F.col("_upstream") > F.col("_derived"), "stale"
    )
    return (
        source.join(newest, key, "left")
        .withColumn("problem", problem)
        .where("problem IS NOT NULL")
        .select(key, "problem")
    )
