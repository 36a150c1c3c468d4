"""Queries for joins, aggregates, windows and set operations (sections 2.4 to 2.8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel import functions as K
from evenkeel.operators import (
    Field,
    affected_by,
    apply_plan,
    carry_over,
    children_of,
    condition_transitions,
    create_only,
    current_conditions,
    distinct_requests,
    fill_if_missing,
    installed_items,
    job_state,
    reconcile_plan,
    replace,
    resolve_refs,
    rows_dedup,
    rows_minus,
    stage_rollup,
)
from evenkeel.plans.registry import query, table
from evenkeel.session import shared_dir

# -- references -----------------------------------------------------------------------------


@query(
    "affected_by",
    """SELECT DISTINCT l_orderkey FROM lineitem
       WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#13')
          OR l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)""",
)
def _(spark, sf):
    parts = table(spark, sf, "part").filter("p_brand = 'Brand#13'").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("name"))
    suppliers = table(spark, sf, "supplier").filter("s_acctbal < 0").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("name"))
    return affected_by(
        table(spark, sf, "lineitem"), parts.unionByName(suppliers), "l_orderkey",
        {"part": ["l_partkey"], "supplier": ["l_suppkey"]},
    )


@query(
    "affected_in_namespace",
    """SELECT DISTINCT user_id, event_type FROM events e
       WHERE EXISTS (SELECT 1 FROM orders o WHERE o_custkey = user_id AND o_orderstatus = 'F'
                     AND e.event_type = CASE o_orderpriority WHEN '1-URGENT' THEN 'error' WHEN '2-HIGH' THEN 'purchase' ELSE 'view' END)""",
)
def _(spark, sf):
    priority = F.col("o_orderpriority")
    changed = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(
        F.when(priority == "1-URGENT", F.lit("error")).when(priority == "2-HIGH", F.lit("purchase")).otherwise(F.lit("view")).alias("event_type"),
        F.lit("customer").alias("kind"),
        F.col("o_custkey").alias("name"),
    )
    return affected_by(
        table(spark, sf, "events"), changed, ["user_id", "event_type"], {"customer": ["user_id"]}, namespace="event_type"
    )


@query(
    "resolve_refs",
    """WITH r AS (
         SELECT o_orderkey, o_orderpriority, o_orderstatus, c_custkey, c_mktsegment, c_nationkey, c_name,
                o_orderstatus <> 'O' AS seg_ref, o_orderpriority IN ('1-URGENT', '2-HIGH') AS nat_ref, o_orderpriority <> '5-LOW' AS con_ref,
                o_orderstatus = 'P' AS nat_text, o_orderstatus = 'F' AND o_orderpriority = '4-NOT SPECIFIED' AS con_nokey
         FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) ON c_custkey = o_custkey),
       e AS (SELECT *,
         CASE WHEN seg_ref AND c_custkey IS NULL THEN 'NOT_FOUND' END AS e1,
         CASE WHEN nat_ref AND c_custkey IS NULL THEN 'NOT_FOUND' WHEN nat_ref AND nat_text THEN 'BAD_VALUE' END AS e2,
         CASE WHEN NOT con_ref THEN 'REF_MISSING' WHEN c_custkey IS NULL THEN 'NOT_FOUND' WHEN con_nokey THEN 'KEY_NOT_FOUND' END AS e3
         FROM r)
       SELECT o_orderkey,
         CASE WHEN coalesce(e1, e2, e3) IS NULL THEN CASE WHEN seg_ref THEN c_mktsegment ELSE o_orderpriority END END AS segment,
         CASE WHEN coalesce(e1, e2, e3) IS NULL THEN CASE WHEN nat_ref THEN c_nationkey ELSE -1 END END AS nation,
         CASE WHEN coalesce(e1, e2, e3) IS NULL THEN c_name END AS contact,
         CASE WHEN e1 IS NOT NULL THEN 'segment' WHEN e2 IS NOT NULL THEN 'nation' WHEN e3 IS NOT NULL THEN 'contact' END AS error_field,
         coalesce(e1, e2, e3) AS error
       FROM e""",
)
def _(spark, sf):
    status, priority, customer = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_custkey")
    fields = [
        Field("segment", priority, F.when(status != "O", customer), F.lit("segment")),
        Field(
            "nation", F.lit(-1), F.when(priority.isin("1-URGENT", "2-HIGH"), customer),
            F.when(status == "P", F.lit("segment")).otherwise(F.lit("nation")), type="int",
        ),
        Field(
            "contact", None, F.when(priority != "5-LOW", customer),
            F.when((status == "F") & (priority == "4-NOT SPECIFIED"), F.lit("nowhere")).otherwise(F.lit("name")), required_ref=True,
        ),
    ]
    data = F.create_map(
        F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("name"), F.col("c_name")
    )
    found = table(spark, sf, "customer").filter("c_acctbal >= 0").select(F.col("c_custkey").alias("name"), data.alias("data"))
    return resolve_refs(table(spark, sf, "orders"), found, fields, "o_orderkey")


def _tagged_lines(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("namespace"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.create_map(F.lit("job-name"), F.col("l_orderkey").cast("string")).alias("labels"),
    )


def _finished_orders(spark, sf):
    return table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(
        F.col("o_orderstatus").alias("namespace"), F.col("o_orderkey").alias("name"), "o_orderpriority"
    )


@query(
    "children_of",
    """SELECT l_linestatus AS namespace, l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderpriority
       FROM lineitem JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus = l_linestatus""",
)
def _(spark, sf):
    return children_of(
        _tagged_lines(spark, sf), _finished_orders(spark, sf), "job-name", parent_columns=["o_orderpriority"]
    ).drop("labels")


@query(
    "children_of_any_namespace",
    """SELECT l_linestatus AS namespace, l_orderkey, l_linenumber, l_partkey, l_suppkey
       FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')""",
)
def _(spark, sf):
    return children_of(
        _tagged_lines(spark, sf), _finished_orders(spark, sf), "job-name", namespace=None
    ).drop("labels")


# -- reconcile ------------------------------------------------------------------------------

_ORDER = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]

# The copy lags: nothing since 2001, and what was loaded in 2000 is still open there.
_COPY_SQL = """(SELECT o_orderkey, o_custkey, o_orderpriority,
    CASE WHEN o_orderdate >= TIMESTAMP '2000-01-01' THEN 'O' ELSE o_orderstatus END AS o_orderstatus
    FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01')"""


def _orders(spark, sf):
    return table(spark, sf, "orders").select(*_ORDER)


def _orders_copy(spark, sf):
    date = F.col("o_orderdate")
    return (
        table(spark, sf, "orders")
        .filter(date < F.lit("2001-01-01").cast("timestamp_ntz"))
        .withColumn(
            "o_orderstatus",
            F.when(date >= F.lit("2000-01-01").cast("timestamp_ntz"), F.lit("O")).otherwise(F.col("o_orderstatus")),
        )
        .select(*_ORDER)
    )


def _readable(plan):
    return plan.withColumn("changed_cols", K.join_items("changed_cols"))


def plan_orders(spark, sf):
    """Which orders are missing from the copy or have drifted, and in which columns."""
    return _readable(reconcile_plan(_orders(spark, sf), _orders_copy(spark, sf), "o_orderkey", replace()))


query(
    "reconcile_replace",
    f"""SELECT d.o_orderkey, d.o_custkey, d.o_orderstatus, d.o_orderpriority,
          CASE WHEN a.o_orderkey IS NULL THEN 'CREATE' WHEN a.o_orderstatus <> d.o_orderstatus THEN 'UPDATE' ELSE 'NOOP' END AS action,
          CASE WHEN a.o_orderstatus <> d.o_orderstatus THEN 'o_orderstatus' ELSE '' END AS changed_cols
        FROM orders d LEFT JOIN {_COPY_SQL} a ON a.o_orderkey = d.o_orderkey""",
)(plan_orders)


@query(
    "reconcile_carry_over",
    f"""SELECT d.o_orderkey, a.o_custkey, d.o_orderstatus, d.o_orderpriority,
          CASE WHEN a.o_orderkey IS NULL THEN 'CREATE' WHEN a.o_orderstatus <> d.o_orderstatus THEN 'UPDATE' ELSE 'NOOP' END AS action,
          CASE WHEN a.o_orderstatus <> d.o_orderstatus THEN 'o_orderstatus' ELSE '' END AS changed_cols
        FROM orders d LEFT JOIN {_COPY_SQL} a ON a.o_orderkey = d.o_orderkey""",
)
def _(spark, sf):
    desired = _orders(spark, sf).withColumn("o_custkey", F.lit(None).cast("bigint"))
    return _readable(reconcile_plan(desired, _orders_copy(spark, sf), "o_orderkey", carry_over("o_custkey")))


@query(
    "reconcile_create_only",
    f"""SELECT d.o_orderkey, d.o_custkey, coalesce(a.o_orderstatus, d.o_orderstatus) AS o_orderstatus, d.o_orderpriority,
          CASE WHEN a.o_orderkey IS NULL THEN 'CREATE' ELSE 'NOOP' END AS action, '' AS changed_cols
        FROM orders d LEFT JOIN {_COPY_SQL} a ON a.o_orderkey = d.o_orderkey""",
)
def _(spark, sf):
    return _readable(reconcile_plan(_orders(spark, sf), _orders_copy(spark, sf), "o_orderkey", create_only()))


@query(
    "reconcile_fill_missing",
    """SELECT c_custkey, c_name,
          CASE WHEN c_acctbal < 0 OR c_mktsegment = 'HOUSEHOLD' THEN 0.0 ELSE c_acctbal END AS c_acctbal,
          CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'CREATE' WHEN c_acctbal < 0 THEN 'UPDATE' ELSE 'NOOP' END AS action,
          CASE WHEN c_mktsegment <> 'HOUSEHOLD' AND c_acctbal < 0 THEN 'c_acctbal' ELSE '' END AS changed_cols
       FROM customer""",
)
def _(spark, sf):
    customer = table(spark, sf, "customer")
    desired = customer.select("c_custkey", "c_name", F.lit(0.0).alias("c_acctbal"))
    actual = customer.filter("c_mktsegment <> 'HOUSEHOLD'").select(
        "c_custkey", "c_name", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal")
    )
    return _readable(reconcile_plan(desired, actual, "c_custkey", fill_if_missing("c_acctbal")))


@query(
    "apply_plan",
    f"""SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus <> 'P'
        UNION ALL
        SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM {_COPY_SQL} a
        WHERE NOT EXISTS (SELECT 1 FROM orders d WHERE d.o_orderstatus <> 'P' AND d.o_orderkey = a.o_orderkey)""",
)
def _(spark, sf):
    desired = _orders(spark, sf).filter("o_orderstatus <> 'P'")
    actual = _orders_copy(spark, sf)
    plan = reconcile_plan(desired, actual, "o_orderkey")
    return apply_plan(actual, plan, "o_orderkey", staged=shared_dir(spark, "plan"))


# -- aggregates -----------------------------------------------------------------------------


def condition_log(events):
    """Events as a condition log: two conditions per user."""
    kind = F.col("event_type")
    return events.select(
        F.col("user_id").alias("object"),
        F.when(kind.isin("purchase", "signup"), F.lit("Paid")).otherwise(F.lit("Ready")).alias("type"),
        F.when(kind == "error", F.lit("False")).when(kind == "signup", F.lit("Unknown")).otherwise(F.lit("True")).alias("status"),
        kind.alias("reason"),
        F.col("props").alias("message"),
        "ts",
        F.col("event_id").alias("seq"),
    )


LOG_SQL = """(SELECT user_id AS object, CASE WHEN event_type IN ('purchase', 'signup') THEN 'Paid' ELSE 'Ready' END AS type,
    CASE WHEN event_type = 'error' THEN 'False' WHEN event_type = 'signup' THEN 'Unknown' ELSE 'True' END AS status,
    event_type AS reason, props AS message, ts, event_id AS seq FROM events)"""

TRANSITIONS_SQL = f"""SELECT object, type, arg_max(status, (ts, seq)) AS status, max(ts) FILTER (changed) AS last_transition_time
    FROM (SELECT *, lag(status) OVER (PARTITION BY object, type ORDER BY ts, seq) IS DISTINCT FROM status AS changed FROM {LOG_SQL})
    GROUP BY object, type"""


@query(
    "current_conditions",
    f"""SELECT object, type, status, reason, message FROM {LOG_SQL}
        QUALIFY row_number() OVER (PARTITION BY object, type ORDER BY ts DESC, seq DESC) = 1""",
)
def _(spark, sf):
    return current_conditions(condition_log(table(spark, sf, "events")), ["object", "type"])


@query("condition_transitions", TRANSITIONS_SQL)
def _(spark, sf):
    return condition_transitions(condition_log(table(spark, sf, "events")), ["object", "type"])


@query("distinct_requests", "SELECT DISTINCT user_id, event_type FROM events")
def _(spark, sf):
    return distinct_requests(table(spark, sf, "events"), ["user_id", "event_type"])


@query(
    "stage_rollup",
    """WITH s AS (SELECT l_orderkey, l_linenumber, l_shipdate, l_returnflag || l_linestatus AS reason,
                    l_returnflag = 'R' AS failed, l_returnflag = 'N' AND l_linestatus = 'O' AS waits,
                    row_number() OVER (PARTITION BY l_orderkey, (l_returnflag = 'R' OR (l_returnflag = 'N' AND l_linestatus = 'O'))
                                       ORDER BY l_linenumber, l_partkey, l_suppkey) AS nth,
                    count(*) OVER (PARTITION BY l_orderkey) AS stages,
                    max(CASE WHEN l_returnflag = 'R' OR (l_returnflag = 'N' AND l_linestatus = 'O') THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey) AS any_stop
                  FROM lineitem)
       SELECT l_orderkey, CASE WHEN any_stop = 0 THEN 'SUCCEEDED' WHEN failed THEN 'FAILED' ELSE 'WAITING' END AS outcome,
              CASE WHEN any_stop = 1 THEN 'line-' || l_linenumber END AS stopped_stage,
              CASE WHEN any_stop = 1 THEN reason END AS reason,
              CASE WHEN any_stop = 0 THEN NULL WHEN failed THEN 15 ELSE 30 END AS retry_after_s,
              stages,
              CASE WHEN any_stop = 0 THEN NULL WHEN failed THEN l_shipdate + INTERVAL 15 SECOND ELSE l_shipdate + INTERVAL 30 SECOND END AS next_attempt_at
       FROM s WHERE nth = 1 AND (any_stop = 0 OR failed OR waits)""",
)
def _(spark, sf):
    flag, line = F.col("l_returnflag"), F.col("l_linestatus")
    waits = (flag == "N") & (line == "O")
    outcomes = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
        F.concat(F.lit("line-"), F.col("l_linenumber")).alias("stage"),
        (flag != "R").alias("ok"),
        waits.alias("wait"),
        F.concat(flag, line).alias("reason"),
        F.when(waits, F.lit(30)).alias("retry"),
    )
    return stage_rollup(
        outcomes, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"],
        wait="wait", reason="reason", retry_after_s="retry", at="l_shipdate",
    )


@query(
    "installed_items",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(n AS INTEGER) AS item_no,
              CASE n WHEN 0 THEN 'part-' || l_partkey ELSE 'supplier-' || l_suppkey END AS item
       FROM lineitem, (VALUES (0), (1)) t(n) WHERE l_returnflag = 'R'""",
)
def _(spark, sf):
    items = F.array(
        F.concat(F.lit("part-"), F.col("l_partkey")), F.concat(F.lit("supplier-"), F.col("l_suppkey"))
    )
    return installed_items(
        table(spark, sf, "lineitem"), "l_orderkey", items, ["l_linenumber", "l_partkey", "l_suppkey"],
        F.col("l_returnflag") == "R",
    )


@query(
    "job_state",
    """WITH s AS (
         SELECT o_orderkey, string_split(o_orderpriority || ' base ' || lower(o_orderstatus) || ' base', ' ') AS desired,
                CASE o_orderstatus WHEN 'F' THEN ['base'] WHEN 'P' THEN ['base', 'p', o_orderpriority] ELSE [] END AS installed,
                c_mktsegment = 'MACHINERY' AS succeeded, c_mktsegment IN ('BUILDING', 'MACHINERY') AS active, c_mktsegment = 'HOUSEHOLD' AS failed,
                o_orderstatus AS job_item
         FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) ON c_custkey = o_custkey AND o_orderpriority <> '5-LOW'),
       t AS (SELECT *, list_filter(list_filter(desired, lambda x, i: list_position(desired, x) = i), lambda x: NOT list_contains(installed, x)) AS todo FROM s),
       u AS (SELECT *, CASE WHEN succeeded THEN 'CLEAR' WHEN active THEN 'WAIT' WHEN failed THEN 'FAILED' WHEN len(todo) > 0 THEN 'START' ELSE 'DONE' END AS action FROM t)
       SELECT o_orderkey, action,
              CASE action WHEN 'START' THEN array_to_string(todo, ',') WHEN 'CLEAR' THEN job_item ELSE '' END AS items,
              array_to_string(CASE WHEN action = 'CLEAR' THEN list_append(installed, job_item) ELSE installed END, ',') AS installed,
              CASE action WHEN 'START' THEN 30 WHEN 'CLEAR' THEN 30 WHEN 'WAIT' THEN 15 END AS retry_after_s,
              action = 'DONE' AS proceed
       FROM u""",
)
def _(spark, sf):
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    objects = table(spark, sf, "orders").select(
        "o_orderkey",
        F.split(F.concat_ws(" ", priority, F.lit("base"), F.lower(status), F.lit("base")), " ").alias("desired"),
        F.when(status == "F", F.array(F.lit("base")))
        .when(status == "P", F.array(F.lit("base"), F.lit("p"), priority))
        .otherwise(F.array().cast("array<string>")).alias("installed"),
        F.when(priority != "5-LOW", F.col("o_custkey")).alias("job_name"),
        F.array(status).alias("job_items"),
    )
    segment = F.col("c_mktsegment")
    jobs = table(spark, sf, "customer").filter("c_acctbal >= 0").select(
        F.col("c_custkey").alias("name"),
        segment.isin("BUILDING", "MACHINERY").cast("int").alias("active"),
        (segment == "MACHINERY").cast("int").alias("succeeded"),
        (segment == "HOUSEHOLD").cast("int").alias("failed"),
    )
    state = job_state(objects, jobs, "o_orderkey", namespace=None)
    return state.withColumns({"items": K.join_items("items"), "installed": K.join_items("installed")})


# -- rows -----------------------------------------------------------------------------------


@query(
    "rows_minus",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
       WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size <= 25)""",
)
def _(spark, sf):
    parts = table(spark, sf, "part").filter("p_size <= 25").select(F.col("p_partkey").alias("l_partkey"))
    return rows_minus(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), parts, "l_partkey")


@query(
    "rows_dedup",
    """SELECT event_id, ts, user_id, event_type, value FROM events
       QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1""",
)
def _(spark, sf):
    events = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return rows_dedup(events, ["user_id", "event_type"], ["ts", "event_id"])
