"""Queries that take declared objects from end to end; an order stands for an object and a
customer for a secret."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel import declared, settling
from evenkeel import functions as K
from evenkeel.operators import Child, affected_by, condition_transitions, current_conditions, expand_children, filter_changes
from evenkeel.plans.columns import change_feed
from evenkeel.plans.registry import query, table
from evenkeel.session import shared_dir

APP = "shop"


def _typed(value, dtype):
    """A column of the declared type; fields that are not given are null."""
    if isinstance(value, dict):
        return F.struct(*[_typed(value.get(f.name), f.dataType).alias(f.name) for f in dtype])
    return (F.lit(None) if value is None else value).cast(dtype)


def declared_objects(spark, sf):
    """Objects whose references, inline values and paths depend on the order."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    secret = F.concat(F.lit("c-"), F.col("o_custkey"))
    name = F.concat(F.lit("app-"), F.col("o_orderkey"))

    def ref(key, when):
        return F.when(when, F.struct(secret.alias("name"), F.lit(key).alias("key")))

    given = {
        "namespace": F.lit("default"),
        "name": name,
        "spec": {
            "name": name,
            "database": {
                "host": F.when(status == "P", F.lit("inline")),
                "host_ref": ref("host", priority.isin("1-URGENT", "2-HIGH")),
                "port_ref": ref("port", status == "F"),
                "password_ref": ref("password", priority != "5-LOW"),
            },
            "config": {
                "admin_password_secret": secret,
                "debug_mode": F.when(status == "F", F.lit(True)),
                "extra_addons_paths": F.when(status == "P", F.array(F.lit("/mnt/a"), F.lit("/mnt/b"))),
            },
            "modules": F.split(F.concat_ws(" ", F.lit("base"), F.lower(status), F.lit("base")), " "),
            "filestore": {},
        },
        "status": {
            "modules_installed": F.when(status != "O", F.array(F.lit("base"), F.lit("f"))),
            "current_job": {
                "name": F.when(F.col("o_orderkey") % 2 == 0, K.derived_name(name, "-init")), "namespace": F.lit("default"),
                "modules": F.array(F.lit("base")),
            },
        },
    }
    schema = T.StructType.fromDDL(declared.OBJECTS)
    return table(spark, sf, "orders").select(*[_typed(given[f.name], f.dataType).alias(f.name) for f in schema])


def secrets(spark, sf):
    """Customers in credit; the port of one segment cannot be read."""
    data = F.create_map(
        F.lit("host"), F.concat(F.lit("db-"), F.col("c_nationkey")),
        F.lit("port"), F.when(F.col("c_mktsegment") == "BUILDING", F.lit("none")).otherwise(F.lit("5433")),
        F.lit("password"), F.col("c_name"),
    )
    return table(spark, sf, "customer").filter("c_acctbal >= 0").select(
        F.lit("default").alias("namespace"), F.concat(F.lit("c-"), F.col("c_custkey")).alias("name"), data.alias("data")
    )


_FAILED = """(c_custkey IS NULL OR (o_orderstatus = 'F' AND c_mktsegment = 'BUILDING') OR o_orderpriority = '5-LOW')"""
_JOINED = "orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) ON c_custkey = o_custkey"


@query(
    "declared_config",
    f"""SELECT 'app-' || o_orderkey AS name, replace('[options]~admin_passwd = ' || c_name || '~data_dir=/var/lib/shop~~db_host = '
          || CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'db-' || c_nationkey WHEN o_orderstatus = 'P' THEN 'inline' ELSE 'postgresql' END
          || '~db_port = ' || CASE WHEN o_orderstatus = 'F' THEN '5433' ELSE '5432' END || '~db_user = shop~db_password = ' || c_name
          || '~db_maxconn = 20~db_name= shop~~debug_mode = ' || CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END
          || '~without_demo = true~proxy_mode = true~workers = 2~limit_memory_soft = 2147483648~limit_memory_hard = 2684354560'
          || '~limit_request = 8192~limit_time_cpu = 60~limit_time_real = 120~max_cron_threads = 1~'
          || CASE WHEN o_orderstatus = 'P' THEN 'addons_path = /mnt/a,/mnt/b~' ELSE '' END, '~', chr(10)) AS text
        FROM {_JOINED} WHERE NOT {_FAILED}""",
)
def _(spark, sf):
    ready = declared.resolved(declared.prepared(declared_objects(spark, sf), APP), secrets(spark, sf))
    return ready.filter("error IS NULL").select("name", declared.config_text().alias("text"))


_VOLUME = '{"size":"10Gi","storage_class":"standard","access_modes":["ReadWriteOnce"]}'


def existing_children(spark, sf):
    """What is there for the orders before 2001: no jobs, and workloads of an older form."""
    name = F.concat(F.lit("app-"), F.col("o_orderkey"))

    def service(port):
        return F.to_json(F.struct(F.lit(port).alias("port"), F.col("name").alias("app")))

    orders = table(spark, sf, "orders").filter(F.col("o_orderdate") < F.lit("2001-01-01").cast("timestamp_ntz"))
    orders = orders.select(F.lit("default").alias("namespace"), name.alias("name"), "o_custkey", "o_orderkey")
    templates = [
        # Admin secrets with and without a value, config secrets of an older text, volumes of another size.
        Child("secret", F.concat(F.lit("c-"), F.col("o_custkey")), F.when(F.col("o_custkey") % 2 == 0, F.lit("kept"))),
        Child("secret", K.derived_name("name", "-config"), F.lit("old"), when=F.col("o_orderkey") % 2 == 0),
        Child("volume", "name", F.when(F.col("o_custkey") % 3 == 0, F.lit(_VOLUME.replace("10Gi", "20Gi"))).otherwise(F.lit(_VOLUME))),
        Child("workload", "name", F.lit("{}")),
        Child("service", K.derived_name("name", "-http"), service(8069)),
        Child("service", K.derived_name("name", "-poll"), service(8072)),
    ]
    return expand_children(orders, templates, ["namespace", "name"])


@query(
    "declared_plan",
    f"""SELECT 'app-' || o_orderkey AS name, kind,
          CASE WHEN suffix IS NULL THEN 'c-' || o_custkey ELSE 'app-' || o_orderkey || suffix END AS child,
          CASE WHEN o_orderdate >= TIMESTAMP '2001-01-01' OR kind = 'job' OR (suffix = '-config' AND o_orderkey % 2 = 1) THEN 'CREATE'
               WHEN kind = 'workload' OR suffix = '-config' THEN 'UPDATE' ELSE 'NOOP' END AS action,
          CASE WHEN o_orderdate < TIMESTAMP '2001-01-01' AND (kind = 'workload' OR (suffix = '-config' AND o_orderkey % 2 = 0)) THEN 'payload' ELSE '' END AS changed_cols,
          CASE WHEN suffix IS NULL AND o_orderdate < TIMESTAMP '2001-01-01' AND o_custkey % 2 = 0 THEN 'kept'
               WHEN kind = 'volume' THEN replace('{_VOLUME}', '10Gi', CASE WHEN o_orderdate < TIMESTAMP '2001-01-01' AND o_custkey % 3 = 0 THEN '20Gi' ELSE '10Gi' END) END AS payload
        FROM {_JOINED}, (VALUES ('secret', NULL), ('secret', '-config'), ('volume', ''), ('job', '-init'), ('workload', ''),
                                ('service', '-http'), ('service', '-poll')) t(kind, suffix)
        WHERE suffix IS NULL OR NOT {_FAILED} AND (kind <> 'job' OR o_orderstatus <> 'F')""",
)
def _(spark, sf):
    desired = declared.desired_children(declared_objects(spark, sf), secrets(spark, sf), APP)
    plan = declared.plan_children(desired, existing_children(spark, sf))
    # The texts that are made for config secrets and workloads are those of declared_config.
    payload = F.when((F.col("kind") == "volume") | (F.col("kind") == "secret") & ~F.col("child").endswith("-config"), F.col("payload"))
    return plan.select("name", "kind", "child", "action", K.join_items("changed_cols").alias("changed_cols"), payload.alias("payload"))


@query(
    "declared_affected",
    """SELECT 'app-' || o_orderkey AS name FROM orders
       WHERE o_custkey IN (SELECT user_id FROM events WHERE event_type = 'error')
          OR o_orderkey IN (SELECT user_id FROM events WHERE event_type IN ('purchase', 'signup'))""",
)
def _(spark, sf):
    """Objects to look at again after changes of secrets, workloads and services."""
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    app = F.concat(F.lit("app-"), user)
    changed = table(spark, sf, "events").filter(kind.isin("error", "purchase", "signup")).select(
        F.lit("default").alias("namespace"),
        F.when(kind == "error", "secret").when(kind == "purchase", "workload").otherwise("service").alias("kind"),
        F.when(kind == "error", F.concat(F.lit("c-"), user)).when(kind == "purchase", app).otherwise(K.derived_name(app, "-http")).alias("name"),
    )
    objects = declared_objects(spark, sf)
    return affected_by(objects, changed, ["namespace", "name"], declared.references(), "namespace").select("name")


@query(
    "declared_changes",
    r"""SELECT event_id, kind, op FROM (
          SELECT event_id, CAST(regexp_extract(props, '"k": (\d+)', 1) AS INTEGER) AS k,
                 CASE WHEN value < 20 THEN 'secret' WHEN value < 50 THEN 'workload' WHEN value < 80 THEN 'service' WHEN value < 100 THEN 'volume' ELSE 'other' END AS kind,
                 CASE WHEN event_type = 'signup' THEN 'create' WHEN event_type IN ('click', 'view') THEN 'update'
                      WHEN event_type = 'error' THEN 'delete' ELSE 'generic' END AS op FROM events)
        WHERE kind <> 'other' AND NOT (kind = 'secret' AND op = 'update' AND k < 50) AND NOT (kind IN ('secret', 'workload') AND op = 'generic' AND k < 50)""",
)
def _(spark, sf):
    """Changes of children and secrets that matter."""
    value = F.col("value")
    kind = F.when(value < 20, "secret").when(value < 50, "workload").when(value < 80, "service").when(value < 100, "volume").otherwise("other")
    events = table(spark, sf, "events")
    changes = change_feed(events).drop("kind").join(events.select("event_id", kind.alias("kind")), "event_id")
    return filter_changes(changes, declared.change_rules("Parent", "v1")).select("event_id", "kind", "op")


def recorded_jobs(spark, sf):
    """Jobs of every other object; a third each runs, has succeeded, has failed."""
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").filter(key % 2 == 0).select(
        F.lit("default").alias("namespace"), F.concat(F.lit("app-"), key, F.lit("-init")).alias("name"),
        *((key % 6 == k).cast("int").alias(c) for k, c in ((0, "active"), (2, "succeeded"), (4, "failed"))),
    )


_STEP = """CASE o_orderkey % 6 WHEN 0 THEN 'WAIT' WHEN 2 THEN 'CLEAR' WHEN 4 THEN 'FAILED'
           ELSE CASE WHEN o_orderstatus = 'F' THEN 'DONE' ELSE 'START' END END"""


def _pass(spark, sf):
    return declared.whole_pass(declared_objects(spark, sf), secrets(spark, sf), recorded_jobs(spark, sf), existing_children(spark, sf), APP)


@query(
    "declared_pass",
    f"""SELECT 'app-' || o_orderkey AS name, kind,
          CASE WHEN suffix IS NULL THEN 'c-' || o_custkey ELSE 'app-' || o_orderkey || suffix END AS child,
          CASE WHEN o_orderdate >= TIMESTAMP '2001-01-01' OR kind = 'job' OR (suffix = '-config' AND o_orderkey % 2 = 1) THEN 'CREATE'
               WHEN kind = 'workload' OR suffix = '-config' THEN 'UPDATE' ELSE 'NOOP' END AS action
        FROM (SELECT *, {_STEP} AS step FROM {_JOINED}),
             (VALUES ('secret', NULL), ('secret', '-config'), ('volume', ''), ('job', '-init'), ('workload', ''),
                     ('service', '-http'), ('service', '-poll')) t(kind, suffix)
        WHERE suffix IS NULL OR NOT {_FAILED} AND CASE WHEN kind = 'job' THEN step = 'START' WHEN kind IN ('workload', 'service') THEN step = 'DONE' ELSE true END""",
)
def _(spark, sf):
    """What one pass over all stages does to the children of every object."""
    return _pass(spark, sf)[0].select("name", "kind", "child", "action")


@query(
    "declared_outcomes",
    f"""SELECT 'app-' || o_orderkey AS name,
          CASE WHEN bad OR step = 'FAILED' THEN 'FAILED' WHEN step = 'DONE' THEN 'SUCCEEDED' ELSE 'WAITING' END AS outcome,
          CASE WHEN bad THEN 'references' WHEN step <> 'DONE' THEN 'job' END AS stopped_stage,
          CASE WHEN bad THEN 15 WHEN step = 'DONE' THEN NULL WHEN step IN ('START', 'CLEAR') THEN 30 ELSE 15 END AS retry_after_s
        FROM (SELECT *, {_STEP} AS step, {_FAILED} AS bad FROM {_JOINED})""",
)
def _(spark, sf):
    """Where each object's pass ended."""
    return _pass(spark, sf)[1].select("name", "outcome", "stopped_stage", "retry_after_s")


BEGAN = datetime(2024, 1, 1)


def children_with_jobs(spark, sf):
    """What is there, with labels: also the jobs of every fourth object, two pods of each, and a pod
    of another job."""
    key = F.col("o_orderkey")
    name = F.concat(F.lit("app-"), key)
    job = K.derived_name(name, "-init")
    pod = lambda n: Child("pod", F.concat(job, F.lit(f"-pod{n}")), F.lit("{}"))
    rows = table(spark, sf, "orders").filter(key % 4 == 0).select(F.lit("default").alias("namespace"), name.alias("name"), "o_orderkey")
    work = expand_children(rows, [Child("job", job, F.lit("{}")), pod(1), pod(2), pod("-of-another")], ["namespace", "name"])
    owner = F.when(F.col("child").endswith("another"), F.lit("another")).otherwise(K.derived_name("name", "-init"))
    work = work.withColumn("labels", F.when(F.col("kind") == "pod", F.create_map(F.lit(settling.JOB_LABEL), owner)))
    return existing_children(spark, sf).withColumn("labels", F.lit(None).cast("map<string,string>")).unionByName(work)


def job_progress(children):
    """The jobs that are there: those of some objects fail or run on, all others have succeeded."""
    key = F.regexp_extract("child", "app-([0-9]+)-init", 1).cast("long") % 10
    return children.filter("kind = 'job'").select(
        "namespace", F.col("child").alias("name"), (key == 6).cast("int").alias("active"),
        (~key.isin(4, 6)).cast("int").alias("succeeded"), (key == 4).cast("int").alias("failed"),
    )


def known_secrets(spark, sf):
    """Customers in credit, and the admin secrets that passes have made for others."""
    base = secrets(spark, sf)

    def found(children):
        made = children.filter("kind = 'secret' AND child LIKE 'c-%'").select("namespace", F.col("child").alias("name")).distinct()
        made = made.join(base, ["namespace", "name"], "left_anti")
        return base.unionByName(made.withColumn("data", F.create_map(F.lit("password"), F.lit("made"))))

    return found


def settled(spark, sf):
    return settling.settle(
        declared_objects(spark, sf), children_with_jobs(spark, sf), known_secrets(spark, sf), job_progress, APP, shared_dir(spark, "settled"), BEGAN
    )


# How each object ends: its references fail, its job fails or runs on, or all is done.
_ENDS = f"""SELECT o.*, neg, bad, fails, runs, made, begins, job_there,
    CASE WHEN o_orderstatus = 'O' THEN [] ELSE ['base', 'f'] END AS had,
    list_filter(['base', lower(o_orderstatus)], lambda m: NOT list_contains(CASE WHEN o_orderstatus = 'O' THEN [] ELSE ['base', 'f'] END, m)) AS todo
  FROM (SELECT orders.*, c_custkey IS NULL AS neg, o_orderkey % 4 = 0 AS job_there, o_orderkey % 10 = 4 AS fails, o_orderkey % 10 = 6 AS runs,
          o_orderpriority = '5-LOW' OR CASE WHEN c_custkey IS NULL THEN o_orderpriority IN ('1-URGENT', '2-HIGH') OR o_orderstatus = 'F'
                                            ELSE o_orderstatus = 'F' AND c_mktsegment = 'BUILDING' END AS bad,
          c_custkey IS NULL AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01') AS made,
          CASE WHEN c_custkey IS NULL AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01') THEN 2 ELSE 1 END AS begins
        FROM {_JOINED}) o"""
# Lists that were installed by the recorded job (base) and by one for what is still missing after it.
_PATHS = f"""SELECT *, CASE WHEN bad OR NOT job_there OR fails OR runs THEN had ELSE list_concat(had, ['base']) END AS first_list,
    NOT bad AND job_there AND (fails OR runs) AS stuck FROM ({_ENDS})"""
_LATER = f"""SELECT *, list_filter(['base', lower(o_orderstatus)], lambda m: NOT list_contains(first_list, m)) AS rest FROM ({_PATHS})"""


@query(
    "declared_settled",
    f"""SELECT 'app-' || o_orderkey AS name,
          CASE WHEN bad OR stuck OR len(rest) = 0 OR fails OR runs THEN array_to_string(first_list, ',') ELSE array_to_string(list_concat(first_list, rest), ',') END AS installed,
          CASE WHEN bad OR stuck THEN CASE WHEN o_orderkey % 2 = 0 THEN 'base' END
               WHEN len(rest) > 0 THEN CASE WHEN fails OR runs THEN array_to_string(rest, ',') END
               WHEN o_orderkey % 2 = 0 AND NOT job_there THEN 'base' END AS running,
          (bad AND job_there) OR (NOT bad AND (stuck OR len(rest) > 0 AND (fails OR runs))) AS has_job,
          CASE WHEN NOT job_there THEN 0 WHEN bad OR stuck THEN 3 ELSE 1 END::BIGINT AS pods,
          NOT bad AND NOT stuck AND (len(rest) = 0 OR NOT (fails OR runs)) OR o_orderdate < TIMESTAMP '2001-01-01' AS has_workload,
          CASE WHEN o_orderdate < TIMESTAMP '2001-01-01' AND o_orderkey % 2 = 0 OR NOT bad THEN true ELSE false END AS has_config
        FROM ({_LATER})""",
)
def _(spark, sf):
    """Objects and their children once passes change nothing any more."""
    end = settled(spark, sf)
    kind, is_config = F.col("kind"), F.col("child") == K.derived_name("name", "-config")
    there = end.children.groupBy("namespace", "name").agg(
        F.bool_or(kind == "job").alias("has_job"), F.count_if(kind == "pod").alias("pods"), F.bool_or(kind == "workload").alias("has_workload"),
        F.bool_or(is_config).alias("has_config"),
    )
    objects = end.objects.select(
        "namespace", "name", K.join_items("status.modules_installed").alias("installed"),
        F.when(F.col("status.current_job.name").isNotNull(), K.join_items("status.current_job.modules")).alias("running"),
    )
    return objects.join(there, ["namespace", "name"]).drop("namespace")


_ROW = "SELECT 'app-' || o_orderkey AS name, '{kind}' AS type, {status} AS status, {reason} AS reason, TIMESTAMP '2024-01-01' + to_seconds({at}) AS since FROM ({rows}) WHERE {when}"


@query(
    "declared_status",
    " UNION ALL ".join([
        _ROW.format(kind="OperatorDegraded", status="'False'", reason="'FailedReferences'", at="begins", rows=_LATER, when="bad"),
        _ROW.format(kind="OperatorDegraded", status="'False'", reason="'FailedInitJob'", rows=_LATER, at="begins + CASE WHEN stuck THEN 0 ELSE 1 END",
                    when="NOT bad AND fails AND (stuck OR len(rest) > 0)"),
        _ROW.format(kind="OperatorSucceeded", status="'True'", rows=_LATER, at="begins", when="NOT bad AND NOT stuck",
                    reason="CASE WHEN len(rest) > 0 AND (fails OR runs) THEN 'InitJobCreated' ELSE 'ReconcileSucceeded' END"),
    ]),
)
def _(spark, sf):
    """The conditions of every object after all passes, and since when they hold."""
    log = settled(spark, sf).conditions.select("namespace", "object", "type", "status", "reason", "message", "ts", "seq")
    now, since = current_conditions(log), condition_transitions(log).drop("status")
    return now.join(since, ["namespace", "object", "type"]).select(
        F.col("object").alias("name"), "type", "status", "reason", F.col("last_transition_time").alias("since")
    )
