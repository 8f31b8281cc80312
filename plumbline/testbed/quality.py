"""Queries for checks, grading, staleness and freshness."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import quality
from plumbline.operators.grading import grade_texts
from plumbline.plans import lifecycle
from plumbline.sources.storage import publish
from plumbline.testbed import oracle, views
from plumbline.testbed.accounts import _acct, _datelist, _dense, sources
from plumbline.testbed.catalog import register
from plumbline.testbed.views import table

# The whole set is retail, pot and joint; leaving one out gives the check something to find.
SOME_TYPES = ("retail", "pot")


@register(
    "dq_grain_dup",
    f"WITH {oracle.TRENDS} SELECT count(*) AS violations FROM (SELECT 1 FROM top_terms"
    " GROUP BY dma_id, term, week HAVING count(*) > 1)",
)
def dq_grain_dup(spark, sf):
    return quality.duplicate_keys(
        views.trends(spark, sf)["top_terms"], ["dma_id", "term", "week"]
    )


def _stored(spark, sf):
    """The history as written and read back, which is what the checks are about."""
    history = _datelist(spark, sf)
    return spark.read.parquet(
        views.stored(spark, sf, "checked", lambda path: publish(history, path, "snapshot_date"))
    )


def _last(spark, sf):
    return lifecycle.latest_day(sources(spark, sf)).scalar()


@register(
    "dq_null_state",
    _dense("SELECT count(*) FILTER (WHERE is_open IS NULL OR (is_open AND snapshot_date"
           " < created_date)) AS violations FROM account_datelist"),
)
def dq_null_state(spark, sf):
    return quality.null_state(_stored(spark, sf))


@register(
    "dq_null_source",
    _acct("SELECT count(*) - count(account_type) AS violations FROM raw_created"),
)
def dq_null_source(spark, sf):
    return quality.null_count(sources(spark, sf).created, "account_type")


_ORPHANS = """
FROM (SELECT DISTINCT account_id FROM (SELECT account_id FROM raw_closed UNION ALL SELECT account_id
      FROM raw_transactions)) x ANTI JOIN raw_created USING (account_id)
"""


@register("dq_orphans", _acct(f"SELECT count(*) AS violations {_ORPHANS}"))
def dq_orphans(spark, sf):
    src = sources(spark, sf)
    missing = quality.orphans([src.closed, src.transactions], src.created, "account_id")
    return missing.agg(F.count(F.lit(1)).alias("violations"))


@register(
    "join_anti_not_in",
    "SELECT DISTINCT o_custkey AS id FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events)"
    " UNION SELECT DISTINCT l_suppkey FROM lineitem WHERE l_suppkey NOT IN"
    " (SELECT user_id FROM events)",
)
def join_anti_not_in(spark, sf):
    def ids(name, column):
        return table(spark, sf, name).select(F.col(column).alias("id"))

    return quality.orphans(
        [ids("orders", "o_custkey"), ids("lineitem", "l_suppkey")], ids("events", "user_id"), "id"
    )


@register(
    "dq_domain_values",
    _dense("SELECT count(DISTINCT account_type) FILTER (WHERE account_type NOT IN"
           " ('retail', 'pot')) AS violations FROM account_datelist"),
)
def dq_domain_values(spark, sf):
    accounts = lifecycle.staged_accounts(sources(spark, sf).created)
    return quality.unexpected_values(accounts, "account_type", SOME_TYPES)


@register(
    "dq_range",
    _acct("SELECT count(*) FILTER (WHERE txn_count < 1 OR txn_count > 2) AS violations"
          " FROM raw_transactions"),
)
def dq_range(spark, sf):
    return quality.out_of_range(sources(spark, sf).transactions, "txn_count", 1, 2)


@register(
    "dq_reconcile_count",
    _dense("SELECT (SELECT count(DISTINCT account_id) FROM raw_created WHERE account_type"
           " IS NOT NULL) AS source, (SELECT count(DISTINCT account_id) FROM account_datelist)"
           " AS modelled"),
)
def dq_reconcile_count(spark, sf):
    created = sources(spark, sf).created.where(F.col("account_type").isNotNull())
    return quality.reconcile_counts(_stored(spark, sf), created)


# An account is broken if a day it should have is missing, by anti join.
_GAPPY = _dense("""
, kept AS (SELECT account_id, snapshot_date AS day FROM account_datelist WHERE l28 < 9),
missing AS (SELECT account_id, day FROM account_days ANTI JOIN kept USING (account_id, day))
SELECT k.account_id, count(*) AS days,
       (SELECT count(*) FROM account_days a WHERE a.account_id = k.account_id) AS expected_days,
       min(k.day) AS first_day, max(k.day) AS last_day
FROM kept k WHERE k.account_id IN (SELECT account_id FROM missing) GROUP BY k.account_id
""")


@register("join_aggregate_validate", _GAPPY)
def join_aggregate_validate(spark, sf):
    """Spines with their busiest days taken out: the check lists every account it hurts."""
    src = sources(spark, sf)
    gappy = _stored(spark, sf).where("l28 < 9")
    return quality.broken_spines(gappy, lifecycle.staged_accounts(src.created), _last(spark, sf))


@register(
    "dq_spine_complete",
    _dense("SELECT count(DISTINCT account_id) AS violations FROM (SELECT account_id, day FROM"
           " account_days EXCEPT ALL SELECT account_id, snapshot_date FROM account_datelist)"),
)
def dq_spine_complete(spark, sf):
    accounts = lifecycle.staged_accounts(sources(spark, sf).created)
    broken = quality.broken_spines(_stored(spark, sf), accounts, _last(spark, sf))
    return broken.agg(F.count(F.lit(1)).alias("violations"))


@register(
    "dq_txn_before_creation",
    _acct("SELECT count(*) AS violations FROM raw_transactions t JOIN stg_created c"
          " ON c.account_id = t.account_id WHERE t.txn_date < c.created_date"),
)
def dq_txn_before_creation(spark, sf):
    early = quality.transactions_before_creation(sources(spark, sf))
    return early.agg(F.count(F.lit(1)).alias("violations"))


_CHECKS = f"""
checks AS (
  SELECT 'duplicate_days' AS "check", '1 grain' AS category, TRUE AS blocking,
         (SELECT count(*) FROM (SELECT 1 FROM account_datelist GROUP BY snapshot_date, account_id
                                HAVING count(*) > 1)) AS violations
  UNION ALL SELECT 'duplicate_activity', '1 grain', TRUE,
         (SELECT count(*) FROM (SELECT 1 FROM raw_transactions GROUP BY account_id, txn_date
                                HAVING count(*) > 1))
  UNION ALL SELECT 'null_state', '2 unexpected nulls', TRUE,
         (SELECT count(*) FROM account_datelist WHERE is_open IS NULL
          OR (is_open AND snapshot_date < created_date))
  UNION ALL SELECT 'null_account_type', '2 unexpected nulls', FALSE,
         (SELECT count(*) - count(account_type) FROM raw_created)
  UNION ALL SELECT 'orphans', '3 referential integrity', TRUE, (SELECT count(*) {_ORPHANS})
  UNION ALL SELECT 'unknown_account_types', '4 dimensional drift', TRUE,
         (SELECT count(DISTINCT account_type) FROM account_datelist
          WHERE account_type NOT IN ('retail', 'pot', 'joint'))
  UNION ALL SELECT 'txn_count_out_of_range', '4 dimensional drift', TRUE,
         (SELECT count(*) FROM raw_transactions WHERE txn_count < 1 OR txn_count > 1000)
  UNION ALL SELECT 'broken_spines', '5 reconciliation', TRUE,
         (SELECT count(DISTINCT account_id) FROM (SELECT account_id, day FROM account_days
            EXCEPT ALL SELECT account_id, snapshot_date FROM account_datelist))
  UNION ALL SELECT 'unreconciled_accounts', '5 reconciliation', TRUE,
         (SELECT abs((SELECT count(DISTINCT account_id) FROM account_datelist)
            - (SELECT count(DISTINCT account_id) FROM raw_created WHERE account_type IS NOT NULL)))
  UNION ALL SELECT 'transactions_before_creation', '5 reconciliation', FALSE,
         (SELECT count(*) FROM raw_transactions t JOIN stg_created c
          ON c.account_id = t.account_id WHERE t.txn_date < c.created_date))
"""
CHECKS_SQL = f"WITH {oracle.DATELIST}, {_CHECKS} SELECT * FROM checks"
REPORT_SQL = f"""WITH {oracle.DATELIST}, {_CHECKS}
SELECT category, CASE WHEN max(CASE WHEN violations > 0 AND blocking THEN 2
                                    WHEN violations > 0 THEN 1 ELSE 0 END) = 2 THEN 'fail'
                      WHEN max(CASE WHEN violations > 0 THEN 1 ELSE 0 END) = 1 THEN 'warn'
                      ELSE 'pass' END AS result,
       string_agg("check" || '=' || CAST(violations AS VARCHAR), ', '
                  ORDER BY "check" || '=' || CAST(violations AS VARCHAR)) AS detail
FROM checks GROUP BY category"""


@register("dq_checks", CHECKS_SQL)
def dq_checks(spark, sf):
    return quality.account_checks(
        sources(spark, sf), _stored(spark, sf), views.ACCOUNT_TYPES
    )


@register("dq_report", REPORT_SQL)
def dq_report(spark, sf):
    return quality.quality_report(dq_checks(spark, sf))


@register(
    "dq_freshness",
    "SELECT 'events' AS table_name, max(ts) AS newest FROM events"
    " UNION ALL SELECT 'orders', max(CAST(o_orderdate AS TIMESTAMP)) FROM orders"
    " UNION ALL SELECT 'lineitem', max(CAST(l_shipdate AS TIMESTAMP)) FROM lineitem",
)
def dq_freshness(spark, sf):
    columns = {"events": "ts", "orders": "o_orderdate", "lineitem": "l_shipdate"}
    return quality.freshness({n: (table(spark, sf, n), c) for n, c in columns.items()})


@register(
    "dq_staleness",
    "SELECT o_orderkey AS item, CASE WHEN last_line IS NULL THEN 'missing' ELSE 'stale' END"
    " AS problem FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS last_line"
    " FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"
    " WHERE last_line IS NULL OR last_line < o_orderdate",
)
def dq_staleness(spark, sf):
    """Orders as the upstream inventory, their lines as what is derived from it."""
    upstream = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("item"), F.col("o_orderdate").alias("modified")
    )
    derived = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("item"), F.col("l_shipdate").alias("modified")
    )
    return quality.staleness(upstream, derived, "item", "modified")


GRADES_SQL = """
WITH assertions AS (
  SELECT doc_id AS case_id, 'contains' AS kind, CASE WHEN quality = 1 THEN 'e' ELSE 'qu' END
    AS needle FROM labels
  UNION ALL SELECT doc_id, 'absent', CASE WHEN toxic = 1 THEN 'http' ELSE '@' END FROM labels
  UNION ALL SELECT doc_id, 'contains', '.' FROM labels),
checked AS (
  SELECT a.case_id, coalesce(contains(d.text, a.needle) = (a.kind = 'contains'), FALSE) AS ok
  FROM assertions a LEFT JOIN documents d ON d.doc_id = a.case_id)
SELECT case_id, count(*) AS n_assert, count(*) FILTER (WHERE ok) AS n_passed,
       count(*) = count(*) FILTER (WHERE ok) AS passed
FROM checked GROUP BY 1
UNION ALL SELECT doc_id, 0, 0, TRUE FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels)
"""


@register("grade_texts", GRADES_SQL)
def grade(spark, sf):
    labels = table(spark, sf, "labels")

    def assertion(kind, needle):
        return F.struct(F.lit(kind).alias("kind"), needle.alias("needle"))

    asserted = labels.select(
        F.col("doc_id").alias("case_id"),
        F.inline(
            F.array(
                assertion("contains", F.when(F.col("quality") == 1, "e").otherwise("qu")),
                assertion("absent", F.when(F.col("toxic") == 1, "http").otherwise("@")),
                assertion("contains", F.lit(".")),
            )
        ),
    )
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("case_id"), "text")
    return grade_texts(texts, asserted)
