"""Passes over declared objects that write what they find, until nothing changes.

A pass plans the children of every object, removes finished jobs with what belongs to them, and
gives the status and the conditions that follow. ``settle`` applies one pass after the other; the
tables are kept as row versions by pass, so a pass writes the rows that it changes and may be run
again after a lost driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace as changed_copy
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.declared import POLICIES, admin_secret_name, child_templates, defaults, prepared, resolved
from evenkeel.functions import derived_name
from evenkeel.functions.names import blank_to_null
from evenkeel.operators import apply_defaults, children_of, expand_children, job_state, reconcile_plan, stage_rollup
from evenkeel.operators.jobs import CLEAR, DONE, FAILED, START
from evenkeel.operators.reconcile import DELETE, NOOP
from evenkeel.operators.references import KEY_NOT_FOUND, NOT_FOUND
from evenkeel.operators.stages import ERROR_RETRY_S
from evenkeel.session import stored
from evenkeel.sources import RowVersions, batch_folder

KEYS = ["namespace", "name"]
CHILD_KEYS = [*KEYS, "kind", "child"]
STATUS = "struct<config_secret: string, data_volume: string, modules_installed: array<string>, current_job: struct<name: string, namespace: string, modules: array<string>>, admin_secret: string>"
CHILDREN = "namespace string, name string, kind string, child string, payload string, labels map<string,string>"

# The label by which pods name their job, condition types, reasons and messages.
JOB_LABEL = "job-name"
SUCCEEDED_TYPE, DEGRADED_TYPE = "OperatorSucceeded", "OperatorDegraded"
ADMIN_SECRET_MADE = "ADMIN_SECRET_MADE"


@dataclass
class Pass:
    """plan: children as in ``plan_children``, and DELETE rows for what a finished job leaves;
    outcomes: those of ``stage_rollup``; status: (namespace, name, status) of the objects whose
    status changes; conditions: rows of a condition log."""

    plan: DataFrame
    outcomes: DataFrame
    status: DataFrame
    conditions: DataFrame


def one_pass(objects: DataFrame, secrets: DataFrame, jobs: DataFrame, actual: DataFrame, app: str, at: Column, seq: int) -> Pass:
    """One pass over all stages of all objects: admin secret, references, job, and what follows it.

    ``jobs`` has (namespace, name, active, succeeded, failed); a job counts as recorded only with
    name and namespace. ``actual`` has the columns of CHILDREN; pods are rows of it, found by their
    label within the job's namespace. An admin secret that this pass makes can be read in the next
    one: the object is WAITING until then. The stages after a stop change nothing, the status
    included. ``at`` and ``seq`` order the condition rows; an object that only waits gives none.
    """
    ready = _ready(objects, app)
    return _pass(_asked(ready), ready, secrets, jobs, actual, app, at, seq)


def _ready(objects: DataFrame, app: str) -> DataFrame:
    """Prepared objects with the name of their admin secret, and with a number by which one row of
    several with the same keys finds its own spec."""
    return prepared(objects, app).select(*KEYS, "spec", "status", admin_secret_name().alias("_admin"), F.xxhash64("spec").alias("_spec"))


def _asked(ready: DataFrame) -> DataFrame:
    """Prepared objects with what references and jobs need of their specs."""
    config = F.struct("spec.config.admin_password_secret").alias("config")
    return ready.withColumn("spec", F.struct("spec.database", config, "spec.modules"))


def _pass(ready: DataFrame, specs: DataFrame, secrets: DataFrame, jobs: DataFrame, actual: DataFrame, app: str, at: Column, seq: int) -> Pass:
    """``one_pass`` over objects as ``_asked`` gives them. Their whole specs, which are wide, come from
    ``specs``, which may have other objects too, and only to where children are made."""
    spark = ready.sparkSession
    old = "status.current_job"
    recorded = F.when(blank_to_null(F.col(f"{old}.namespace")).isNotNull(), F.col(f"{old}.name"))
    steps = job_state(
        ready, jobs, KEYS, "spec.modules", "status.modules_installed", recorded, f"{old}.modules", job_namespace=f"{old}.namespace"
    ).select(*KEYS, F.col("action").alias("step"), "items", "installed", F.col("retry_after_s").alias("step_retry_s"))
    found = stored(spark, resolved(ready, secrets, ["status", "_admin", "_spec"]).join(steps, KEYS), "pass")

    made = (F.col("error_field") == "admin_password") & F.col("error").isin(NOT_FOUND, KEY_NOT_FOUND)
    ok, waits = F.col("error").isNull(), F.coalesce(made, F.lit(False))
    held = F.col("step") != DONE

    def stage(number: int, name: str, good: Column, wait: Column, reason: Column, retry: Column) -> Column:
        return F.struct(F.lit(number).alias("ord"), F.lit(name).alias("stage"), good.alias("ok"), wait.alias("wait"), reason.alias("reason"), retry.alias("retry"))

    stages = F.array(
        stage(1, "admin", F.lit(True), waits, F.lit(ADMIN_SECRET_MADE), F.lit(ERROR_RETRY_S)),
        stage(2, "references", ok | waits, F.lit(False), F.col("error"), F.lit(None).cast("int")),
        stage(3, "job", F.col("step") != FAILED, held, F.col("step"), F.col("step_retry_s")),
    )
    outcomes = stage_rollup(found.select(*KEYS, F.inline(stages)), KEYS, wait="wait", reason="reason", retry_after_s="retry")

    own = [*KEYS, "_spec"]
    specs = specs.select(*own, "spec").repartition(*own).groupBy(*own).agg(F.any_value("spec").alias("spec"))
    templates = child_templates(app, F.col("step"))
    desired = expand_children(found.join(specs, own), templates, KEYS).withColumn("labels", F.lit(None).cast("map<string,string>"))
    config = derived_name("name", "-config")
    role = F.when(F.col("kind") != "secret", F.col("kind")).otherwise(F.when(F.col("child") == config, "config").otherwise("admin"))
    policies = {kind: changed_copy(p, carried=(*p.carried, "labels")) for kind, p in POLICIES.items()}
    there = actual.filter(F.col("kind").isin(sorted({t.kind for t in templates})))
    plan = reconcile_plan(desired.withColumn("role", role), there, CHILD_KEYS, policies, ["payload", "labels"], "role")

    finished = found.filter(ok & (F.col("step") == CLEAR)).select(F.col(f"{old}.namespace").alias("namespace"), F.col(f"{old}.name").alias("job")).distinct()
    finished = stored(spark, finished, "finished")
    job_rows = actual.filter("kind = 'job'").join(finished.withColumnRenamed("job", "child"), ["namespace", "child"], "left_semi")
    pods = children_of(actual.filter("kind = 'pod'"), finished, JOB_LABEL, parent_name="job")
    gone = job_rows.select(*actual.columns).unionByName(pods).select(
        *CHILD_KEYS, "payload", "labels", F.lit(DELETE).alias("action"), F.array().cast("array<string>").alias("changed_cols")
    )
    return Pass(plan.unionByName(gone), outcomes, _status(found, ok), _conditions(found, ok, waits, at, seq))


def _status(found: DataFrame, ok: Column) -> DataFrame:
    """The status of each object after the pass, where it changes."""
    job = F.col("status.current_job")
    started = F.struct(derived_name("name", "-init").alias("name"), F.col("namespace").alias("namespace"), F.col("items").alias("modules"))
    none = F.lit(None).cast(found.select(job.alias("j")).schema["j"].dataType)
    after = F.struct(
        F.when(ok, derived_name("name", "-config")).otherwise(F.col("status.config_secret")).alias("config_secret"),
        F.when(ok, F.col("name")).otherwise(F.col("status.data_volume")).alias("data_volume"),
        F.when(ok & (F.col("step") == CLEAR), F.col("installed")).otherwise(F.col("status.modules_installed")).alias("modules_installed"),
        F.when(ok & (F.col("step") == START), started).when(ok & (F.col("step") == CLEAR), none).otherwise(job).alias("current_job"),
        F.col("_admin").alias("admin_secret"),
    )
    return found.select(*KEYS, "status", after.cast(STATUS).alias("_after")).filter(~F.col("status").cast(STATUS).eqNullSafe(F.col("_after"))).select(
        *KEYS, F.col("_after").alias("status")
    )


def _conditions(found: DataFrame, ok: Column, waits: Column, at: Column, seq: int) -> DataFrame:
    """A row per object that ends in more than a wait."""

    def row(kind: str, status: str, reason: str, message: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), F.lit(status).alias("status"), F.lit(reason).alias("reason"), message.alias("message"))

    step, job = F.col("step"), F.col("status.current_job")
    said = (
        F.when(waits, F.lit(None))
        .when(~ok, row(DEGRADED_TYPE, "False", "FailedReferences", F.concat_ws(": ", "error_field", "error")))
        .when(step == START, row(SUCCEEDED_TYPE, "True", "InitJobCreated", F.concat(F.lit("InitJob "), derived_name("name", "-init"), F.lit(" created"))))
        .when(step == CLEAR, row(SUCCEEDED_TYPE, "True", "InitJobSucceeded", F.lit("InitJob succeeded, clearing")))
        .when(step == FAILED, row(DEGRADED_TYPE, "False", "FailedInitJob", F.concat(F.lit("Init job "), job["name"], F.lit(" in namespace "), job["namespace"], F.lit(" failed"))))
        .when(step == DONE, row(SUCCEEDED_TYPE, "True", "ReconcileSucceeded", F.lit("Reconcile succeeded")))
    )
    rows = found.select("namespace", F.col("name").alias("object"), said.alias("c")).filter("c IS NOT NULL")
    return rows.select("namespace", "object", "c.*", F.lit(None).cast("bigint").alias("observed_generation"), at.alias("ts"), F.lit(seq).cast("bigint").alias("seq"))


@dataclass
class Settled:
    """objects with the status after the last pass, children, the condition log, the number of passes."""

    objects: DataFrame
    children: DataFrame
    conditions: DataFrame
    passes: int


def settle(
    objects: DataFrame,
    actual: DataFrame,
    secrets: Callable[[DataFrame], DataFrame],
    jobs: Callable[[DataFrame], DataFrame],
    app: str,
    place: str,
    began: datetime,
    most: int = 50,
) -> Settled:
    """Passes until one changes nothing, or ``most`` of them; pass n has seq n and the time
    ``began`` + n seconds.

    ``secrets`` and ``jobs`` are functions of the children as they are, called before each pass:
    what there is to look up, and how far the jobs have come. Objects are prepared once; the result
    has them as they were given, read again, with their status. After the first pass only objects
    are looked at that changed, or that asked to be tried again. Versions of status and children
    are kept below ``place``, a new folder.
    """
    spark = objects.sparkSession
    status = RowVersions(spark, f"{place}/status", KEYS, f"namespace string, name string, status {STATUS}")
    children = RowVersions(spark, f"{place}/children", CHILD_KEYS, CHILDREN, sort_by="kind")
    log = batch_folder(f"{place}/conditions")
    children.begin(actual, 0)
    ready = stored(spark, _ready(objects, app), "objects")  # read by every pass
    own_defaults = {path: value for path, value in defaults(app).items() if path.startswith("status.")}
    moving, number = None, 0
    while number < most:
        number += 1
        there = children.read_sorted(number)
        asked = _asked(ready) if moving is None else _asked(ready).join(moving, KEYS, "left_semi")
        now = apply_defaults(_with_status(asked, status.read_sorted(number)), own_defaults)
        at = F.lit(began + timedelta(seconds=number)).cast("timestamp_ntz")
        found = _pass(now, ready, secrets(there), jobs(there), there, app, at, number)
        plan = stored(spark, found.plan.filter(F.col("action") != NOOP), "plan")
        children.write(plan.select(*children.columns, (F.col("action") == DELETE).alias("_gone")), number)
        status.write(found.status, number)
        log(found.conditions, number)
        changed = plan.select(*KEYS).unionByName(status.written(number).select(*KEYS))
        again = found.outcomes.filter("retry_after_s IS NOT NULL").select(*KEYS)
        if changed.isEmpty():
            break
        moving = stored(spark, changed.unionByName(again).distinct(), "moving")
    return Settled(_with_status(objects, status.read_sorted()), children.read_sorted(), spark.read.parquet(f"{place}/conditions"), number)


def _with_status(objects: DataFrame, status: DataFrame) -> DataFrame:
    """Objects with their latest status where a pass has written one."""
    latest = status.withColumnRenamed("status", "_status")
    joined = objects.join(latest, KEYS, "left")
    return joined.withColumn("status", F.coalesce(F.col("_status"), F.col("status").cast(STATUS))).drop("_status")
