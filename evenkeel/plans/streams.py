"""Queries for streams (section 2.9): the events table replayed to its end.

Each runs its stream into a fresh place below the shared folder and returns what it wrote.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel import functions as K
from evenkeel.operators import distinct_requests, fill_if_missing, filter_changes, installed_items, reference_lists, rows_dedup
from evenkeel.operators.conditions import latest_rows
from evenkeel.plans.columns import FILTERED_SQL, change_feed, change_rules
from evenkeel.plans.registry import FEED_SLICES, feed, query, table
from evenkeel.plans.tables import TRANSITIONS_SQL, condition_log
from evenkeel.session import shared_dir
from evenkeel.sources import RowVersions, batch_folder
from evenkeel.streaming import (
    affected_stream,
    change_stream,
    edge_table,
    job_steps,
    reconcile_stream,
    start,
    suppress_unchanged,
    to_the_end,
    track_conditions,
    track_jobs,
)


def _written(spark, name, begin):
    """Run ``begin(sink, checkpoint)`` to the end and read back what the sink wrote."""
    place = shared_dir(spark, name)
    to_the_end(begin(batch_folder(f"{place}/rows"), f"{place}/progress"))
    return spark.read.parquet(f"{place}/rows")


def _replayed(spark, name, stream, mode="append"):
    return _written(spark, name, lambda sink, at: start(stream, sink, at, mode, available_now=True))


@query("read_changes", FILTERED_SQL)
def _(spark, sf):
    changes = filter_changes(change_feed(feed(spark, sf, "events")), change_rules())
    return _replayed(spark, "changes", changes.select("event_id", "user_id", "kind", "op")).drop("batch_id")


@query(
    "affected_stream",
    "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT user_id FROM events WHERE event_type = 'error')",
)
def _(spark, sf):
    changes = feed(spark, sf, "events").filter("event_type = 'error'").select(
        F.lit("customer").alias("kind"), F.col("user_id").alias("name")
    )
    found = _written(
        spark,
        "affected",
        lambda sink, at: affected_stream(
            changes, lambda: table(spark, sf, "orders"), "o_orderkey", {"customer": ["o_custkey"]}, sink, at,
            available_now=True,
        ),
    )
    return distinct_requests(found, "o_orderkey")


@query(
    "reconcile_stream",
    """SELECT c_custkey, c_name,
          CASE WHEN c_acctbal < 0 OR c_mktsegment = 'HOUSEHOLD' THEN 0.0 ELSE c_acctbal END AS c_acctbal,
          CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'CREATE' WHEN c_acctbal < 0 THEN 'UPDATE' ELSE 'NOOP' END AS action,
          CASE WHEN c_mktsegment <> 'HOUSEHOLD' AND c_acctbal < 0 THEN 'c_acctbal' ELSE '' END AS changed_cols
       FROM customer WHERE c_custkey IN (SELECT user_id FROM events WHERE event_type = 'purchase')""",
)
def _(spark, sf):
    requests = feed(spark, sf, "events").filter("event_type = 'purchase'").select(F.col("user_id").alias("c_custkey"))

    def desired():
        return table(spark, sf, "customer").select("c_custkey", "c_name", F.lit(0.0).alias("c_acctbal"))

    def actual():
        return table(spark, sf, "customer").filter("c_mktsegment <> 'HOUSEHOLD'").select(
            "c_custkey", "c_name", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal")
        )

    plan = _written(
        spark,
        "reconcile",
        lambda sink, at: reconcile_stream(
            requests, desired, actual, "c_custkey", sink, at, policy=fill_if_missing("c_acctbal"), available_now=True
        ),
    )
    latest = rows_dedup(plan, "c_custkey", [F.desc("batch_id")]).drop("batch_id")
    return latest.withColumn("changed_cols", K.join_items("changed_cols"))


@query("track_conditions", TRANSITIONS_SQL)
def _(spark, sf):
    rows = condition_log(feed(spark, sf, "events"))
    log = _written(
        spark, "conditions", lambda sink, at: track_conditions(rows, sink, at, f"{at}-state", ["object", "type"], available_now=True)
    )
    return latest_rows(log.filter("NOT late"), ["object", "type"], ["ts", "seq"]).select("object", "type", "status", "last_transition_time")


def _suppressed(spark, rows, content):
    return _written(
        spark, "changed",
        lambda sink, at: suppress_unchanged(rows, sink, at, f"{at}-state", "user_id", content, "ts", "event_id", available_now=True),
    )


@query(
    "suppress_unchanged",
    """SELECT user_id, ts, event_id, event_type FROM (
         SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
       WHERE event_type IS DISTINCT FROM before""",
)
def _(spark, sf):
    return _suppressed(spark, feed(spark, sf, "events"), ["event_type"]).drop("batch_id", "late")


@query(
    "suppress_unchanged_times",
    """SELECT user_id, ts, event_id FROM (
         SELECT *, lag((date_trunc('day', ts), props)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
       WHERE (date_trunc('day', ts), props) IS DISTINCT FROM before""",
)
def _(spark, sf):
    """Content of a time and a map: a key's day and its properties."""
    content = feed(spark, sf, "events").select(
        "user_id", "ts", "event_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"),
        F.from_json("props", "map<string,int>").alias("props"),
    )
    return _suppressed(spark, content, ["day", "props"]).select("user_id", "ts", "event_id")


TRACKED_SQL = r"""WITH RECURSIVE seen AS (
          SELECT user_id, ts, event_id, event_type,
                 CASE WHEN event_type = 'base' THEN ['base'] ELSE ['base', event_type, 'k' || regexp_extract(props, '"k": (\d+)', 1)] END AS wanted,
                 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
          FROM events),
        walk AS (
          SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR[]) AS job, CAST([] AS VARCHAR[]) AS installed,
                 CAST(NULL AS VARCHAR) AS action, CAST([] AS VARCHAR[]) AS items, CAST(NULL AS TIMESTAMP) AS ts, CAST(NULL AS BIGINT) AS event_id
          FROM (SELECT DISTINCT user_id FROM events)
          UNION ALL
          SELECT user_id, n, CASE action WHEN 'CLEAR' THEN NULL WHEN 'START' THEN todo ELSE job END,
                 CASE WHEN action = 'CLEAR' THEN list_concat(installed, job) ELSE installed END,
                 action, CASE action WHEN 'CLEAR' THEN job WHEN 'START' THEN todo ELSE [] END, ts, event_id
          FROM (SELECT *, CASE WHEN job IS NOT NULL AND event_type IN ('purchase', 'signup') THEN 'CLEAR'
                               WHEN job IS NOT NULL AND event_type = 'view' THEN 'WAIT'
                               WHEN job IS NOT NULL AND event_type = 'error' THEN 'FAILED'
                               WHEN len(todo) > 0 THEN 'START' ELSE 'DONE' END AS action
                FROM (SELECT w.user_id, s.n, w.job, w.installed, s.event_type, s.ts, s.event_id,
                             list_filter(s.wanted, lambda x: NOT list_contains(w.installed, x)) AS todo
                      FROM walk w JOIN seen s ON s.user_id = w.user_id AND s.n = w.n + 1)))
        SELECT user_id, ts, event_id, action, array_to_string(items, ',') AS items,
               CASE WHEN action = 'CLEAR' THEN array_to_string(installed, ',') END AS installed,
               CASE action WHEN 'START' THEN 30 WHEN 'CLEAR' THEN 30 WHEN 'WAIT' THEN 15 END AS retry_after_s
        FROM walk WHERE n > 0"""


def _observations(spark, sf):
    kind = F.col("event_type")
    k = F.from_json("props", "k int")["k"].cast("string")
    return feed(spark, sf, "events").select(
        "user_id", "ts", "event_id",
        F.array(F.lit("base"), kind, F.concat(F.lit("k"), k)).alias("desired"),
        (kind == "view").cast("int").alias("active"),
        kind.isin("purchase", "signup").cast("int").alias("succeeded"),
        (kind == "error").cast("int").alias("failed"),
    )


@query("track_jobs", TRACKED_SQL)
def _(spark, sf):
    log = _replayed(spark, "jobs", track_jobs(_observations(spark, sf), "user_id", "ts", "event_id"))
    return log.select(
        "user_id", "ts", "event_id", "action", K.join_items("items").alias("items"),
        K.join_items("installed").alias("installed"), "retry_after_s",
    )


def _job_steps(spark, sf):
    rows = _observations(spark, sf)
    return _written(spark, "steps", lambda sink, at: job_steps(rows, sink, at, f"{at}-state", "user_id", "ts", "event_id", available_now=True))


@query("job_steps", f"SELECT * EXCLUDE (installed) FROM ({TRACKED_SQL})")
def _(spark, sf):
    return _job_steps(spark, sf).select("user_id", "ts", "event_id", "action", K.join_items("items").alias("items"), "retry_after_s")


@query(
    "job_steps_installed",
    f"""SELECT user_id, ts, event_id, unnest(range(len(list))) AS item_no, unnest(list) AS item
        FROM (SELECT user_id, ts, event_id, string_split(items, ',') AS list FROM ({TRACKED_SQL}) WHERE action = 'CLEAR')""",
)
def _(spark, sf):
    """The installed list of each user as rows."""
    log = _job_steps(spark, sf)
    return installed_items(log, "user_id", "items", ["ts", "event_id"], F.col("action") == "CLEAR").select(
        "user_id", "ts", "event_id", F.col("item_no").cast("long").alias("item_no"), "item"
    )


def _namespace(key):
    return F.concat(F.lit("ns-"), key % 8)


def _slots(spark, sf):
    """Orders as objects that use a customer's content and what it owns."""
    orders = table(spark, sf, "orders")
    return orders.select(_namespace(F.col("o_custkey")).alias("namespace"), F.col("o_orderkey").cast("string").alias("name"), "o_custkey", "o_orderstatus", "o_totalprice")


def run_change_stream(spark, sf, place):
    """(status log, actual table) of changes of customers and orders, micro-batch by micro-batch."""
    refs = {"content": ["o_custkey"], "owned": ["o_custkey"]}

    def objects(where):
        found = _slots(spark, sf)
        return found if where is None else found.filter(where)

    def desired(where):
        return objects(where).select("namespace", "name", F.col("o_totalprice").alias("price"))

    events = feed(spark, sf, "events")
    changes = filter_changes(change_feed(events), change_rules()).select(_namespace(F.col("user_id")).alias("namespace"), "kind", F.col("user_id").cast("string").alias("name"), "op")
    edges = edge_table(spark, f"{place}/edges", objects(None), ["namespace", "name"])
    edges.begin(reference_lists(objects(None), edges.keys, refs, "namespace"), -1)
    actual = RowVersions(spark, f"{place}/actual", ["namespace", "name"], "namespace string, name string, price double", "namespace")
    old = F.when(F.col("o_orderstatus") == "F", F.lit(0.0)).otherwise(F.col("o_totalprice"))
    actual.begin(objects(None).filter("o_orderstatus != 'O'").select("namespace", "name", old.alias("price")), -1)
    to_the_end(
        change_stream(
            changes, edges, desired, actual, batch_folder(f"{place}/status"), f"{place}/progress", objects=objects, object_kind="plain", refs=refs, available_now=True
        )
    )
    return spark.read.parquet(f"{place}/status"), actual


@query(
    "change_to_status",
    f"""WITH changes AS ({FILTERED_SQL}),
        timed AS (SELECT c.*, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) //
                    ((SELECT max(epoch_us(ts)) - min(epoch_us(ts)) FROM events) // {FEED_SLICES} + 1) AS part FROM changes c JOIN events USING (event_id)),
        hits AS (SELECT o_orderkey, o_orderstatus, o_totalprice, part FROM orders JOIN timed ON o_custkey = timed.user_id AND kind <> 'plain'
                 UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice, part FROM orders JOIN timed ON o_orderkey = timed.user_id AND o_custkey % 8 = o_orderkey % 8 AND kind = 'plain')
        SELECT o_orderkey::VARCHAR AS name, CASE o_orderstatus WHEN 'O' THEN 'CREATE' WHEN 'F' THEN 'UPDATE' ELSE 'NOOP' END AS first_action,
          count(DISTINCT part) AS looked_at, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END::BIGINT AS applied, o_totalprice AS price
        FROM hits GROUP BY o_orderkey, o_orderstatus, o_totalprice""",
)
def _(spark, sf):
    """What the changes did to each order that they affect, however often it was looked at."""
    log, actual = run_change_stream(spark, sf, shared_dir(spark, "change"))
    first = F.min_by(F.when(F.col("created") > 0, "CREATE").when(F.col("updated") > 0, "UPDATE").otherwise("NOOP"), "batch_id")
    seen = log.groupBy("namespace", "name").agg(first.alias("first_action"), F.count("*").alias("looked_at"), F.sum(F.col("created") + F.col("updated")).alias("applied"))
    return seen.join(actual.read(), ["namespace", "name"]).drop("namespace")
