"""Passes that write status and conditions, until nothing changes."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F
from test_declared import ALL_REFS, SECRET, obj, table

from evenkeel import settling as S
from evenkeel.operators import condition_transitions, current_conditions
from evenkeel.session import shared_dir

BEGAN = datetime(2024, 1, 1)
LOOKUP = "namespace string, name string, data map<string,binary>"


def world(spark, failing=()):
    """(secrets, jobs) of the children as they are: admin secrets get a value, jobs succeed or fail."""
    base = spark.createDataFrame([("default", "test-db-secret", SECRET)], LOOKUP)

    def secrets(children):
        made = children.filter("kind = 'secret' AND child LIKE '%-admin-password'").select("namespace", F.col("child").alias("name"))
        return base.unionByName(made.withColumn("data", F.create_map(F.lit("password"), F.lit("pw").cast("binary"))))

    def jobs(children):
        fails = F.col("child").isin(*failing) if failing else F.lit(False)
        return children.filter("kind = 'job'").select(
            "namespace", F.col("child").alias("name"), F.lit(0).alias("active"), (~fails).cast("int").alias("succeeded"), fails.cast("int").alias("failed")
        )

    return secrets, jobs


def settled(spark, objects, actual=(), failing=(), **more):
    children = spark.createDataFrame(list(actual), S.CHILDREN)
    return S.settle(objects, children, *world(spark, failing), "app", shared_dir(spark, "settled"), BEGAN, **more)


def test_from_nothing_over_start_and_clear_to_the_workload(spark):
    end = settled(spark, table(spark, obj(refs=ALL_REFS, modules=["base", "web", "base"])))
    # Admin secret, start, clear, workload and services, and a pass that finds nothing to do.
    assert end.passes == 5
    status = end.objects.first().status
    assert status.modules_installed == ["base", "web"] and status.current_job is None
    assert (status.admin_secret, status.config_secret, status.data_volume) == ("my-app-admin-password", "my-app-config", "my-app")
    kinds = sorted((r.kind, r.child) for r in end.children.collect())
    assert kinds == [
        ("secret", "my-app-admin-password"), ("secret", "my-app-config"), ("service", "my-app-http"), ("service", "my-app-poll"),
        ("volume", "my-app"), ("workload", "my-app"),
    ]
    log = [(r.seq, r.type, r.status, r.reason) for r in end.conditions.orderBy("seq").collect()]
    reasons = [(2, "InitJobCreated"), (3, "InitJobSucceeded"), (4, "ReconcileSucceeded"), (5, "ReconcileSucceeded")]
    assert log == [(n, "OperatorSucceeded", "True", reason) for n, reason in reasons]
    rows = end.conditions.drop("batch_id")
    assert current_conditions(rows).first().reason == "ReconcileSucceeded"
    assert condition_transitions(rows).first().last_transition_time == datetime(2024, 1, 1, 0, 0, 2)


def test_clear_removes_the_job_and_its_pods_and_the_next_start_creates(spark):
    status = {"modules_installed": ["base"], "current_job": {"name": "my-app-init", "namespace": "default", "modules": ["web"]}}
    objects = table(spark, obj(refs=ALL_REFS, modules=["base", "web", "crm"], status=status), obj("other", refs=ALL_REFS, modules=["base"], status={"modules_installed": ["base"]}))
    pod = lambda name, job, ns="default": (ns, "my-app", "pod", name, "{}", {S.JOB_LABEL: job})
    actual = [("default", "my-app", "job", "my-app-init", "{}", None), ("default", "x", "job", "x-init", "{}", None)]
    actual += [pod("p1", "my-app-init"), pod("p2", "my-app-init"), pod("p3", "x-init"), pod("p4", "my-app-init", "elsewhere")]
    actual += [("default", n, "secret", f"{n}-admin-password", "kept", None) for n in ("my-app", "other")]
    children = spark.createDataFrame(actual, S.CHILDREN)
    secrets, jobs = world(spark)
    first = S.one_pass(objects, secrets(children), jobs(children), children, "app", F.lit(BEGAN), 1)
    gone = sorted((r.kind, r.child) for r in first.plan.filter("action = 'DELETE'").collect())
    assert gone == [("job", "my-app-init"), ("pod", "p1"), ("pod", "p2")]
    assert first.status.filter("name = 'my-app'").first().status.modules_installed == ["base", "web"]
    end = settled(spark, objects, actual)
    assert end.objects.filter("name = 'my-app'").first().status.modules_installed == ["base", "web", "crm"]
    left = {r.child for r in end.children.filter("kind IN ('job', 'pod')").collect()}
    assert left == {"x-init", "p3", "p4"}
    reasons = [r.reason for r in end.conditions.filter("object = 'my-app'").orderBy("seq").collect()]
    assert reasons == ["InitJobSucceeded", "InitJobCreated", "InitJobSucceeded", "ReconcileSucceeded", "ReconcileSucceeded"]


def test_failures_stop_and_are_written_down(spark):
    bad = {**ALL_REFS, "port": ("test-db-secret", "nothing")}
    objects = table(spark, obj("bad", refs=bad), obj("fails", refs=ALL_REFS, modules=["base"]))
    end = settled(spark, objects, failing=["fails-init"])
    found = {(r.object, r.type, r.status, r.reason, r.message) for r in current_conditions(end.conditions).collect()}
    assert found == {
        ("bad", "OperatorDegraded", "False", "FailedReferences", "db_port: KEY_NOT_FOUND"),
        ("fails", "OperatorSucceeded", "True", "InitJobCreated", "InitJob fails-init created"),
        ("fails", "OperatorDegraded", "False", "FailedInitJob", "Init job fails-init in namespace default failed"),
    }
    status = {r.name: r.status for r in end.objects.collect()}
    assert status["bad"].config_secret is None or status["bad"].config_secret == ""
    assert status["fails"].current_job.name == "fails-init" and status["fails"].modules_installed == []


def test_a_new_admin_secret_is_waited_for_and_a_job_needs_its_namespace(spark):
    status = {"current_job": {"name": "b-init", "namespace": "", "modules": ["base"]}}
    objects = table(spark, obj("a", refs=ALL_REFS), obj("b", refs=ALL_REFS, modules=["base"], status=status))
    children = spark.createDataFrame([("default", "b", "secret", "b-admin-password", "kept", None), ("default", "b", "job", "b-init", "{}", None)], S.CHILDREN)
    secrets, jobs = world(spark)
    found = S.one_pass(objects, secrets(children), jobs(children), children, "app", F.lit(BEGAN), 1)
    rows = {r.name: (r.outcome, r.stopped_stage, r.reason, r.retry_after_s) for r in found.outcomes.collect()}
    assert rows == {"a": ("WAITING", "admin", "ADMIN_SECRET_MADE", 15), "b": ("WAITING", "job", "START", 30)}
    assert {r.object for r in found.conditions.collect()} == {"b"}


def test_most_passes(spark):
    assert settled(spark, table(spark, obj(refs=ALL_REFS)), most=2).passes == 2


def test_looking_up_moves_no_whole_specs_and_its_code_is_small_enough_to_be_compiled(spark, monkeypatch):
    """The JVM interprets a method of more than 8000 bytes, row for row."""
    written = {}

    def stored(session, df, purpose):
        stats = session._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$")
        parts = stats.codegenStringSeq(df._jdf.queryExecution().executedPlan())
        sizes = [parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size())]
        written.setdefault(purpose, []).append((df.columns, max(sizes, default=0)))
        return store(session, df, purpose)

    store = S.stored
    monkeypatch.setattr(S, "stored", stored)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        end = settled(spark, table(spark, obj(refs=ALL_REFS), obj("b", refs=ALL_REFS, modules=["base"])))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert end.passes == len(written["pass"]) == 5
    assert all("spec" not in columns for columns, _ in written["pass"])
    assert max(size for purpose, found in written.items() for _, size in found if purpose != "objects") < 8000, written


def test_an_object_that_comes_twice_has_children_of_one_of_its_rows(spark):
    both = table(spark, obj(refs=ALL_REFS, modules=["base"])).withColumn("_n", F.explode(F.array(F.lit(1), F.lit(2))))
    none = F.lit(None).cast("struct<name: string, key: string>")
    database = F.col("spec.database").withField("max_conn_ref", none).withField("max_conn", F.col("_n"))
    spec = F.col("spec").withField("image", F.concat(F.lit("v"), F.col("_n"))).withField("database", database)
    kept = spark.createDataFrame([("default", "my-app", "secret", "my-app-admin-password", "kept", None)], S.CHILDREN)
    secrets, jobs = world(spark)
    status = F.struct(F.array(F.lit("base")).alias("modules_installed"))
    objects = both.withColumn("spec", spec).select("namespace", "name", "spec", F.from_json(F.to_json(status), S.STATUS).alias("status"))
    plan = S.one_pass(objects, secrets(kept), jobs(kept), kept, "app", F.lit(BEGAN), 1).plan
    rows = plan.filter("kind = 'workload' OR child LIKE '%-config'").select("kind", "payload").distinct().collect()
    found = {r.kind: r.payload for r in rows}
    assert len(rows) == 2
    number = found["workload"].split('"image":"v')[1].split('"')[0]
    assert f"db_maxconn = {number}\n" in found["secret"]


def test_objects_are_given_back_as_they_came(spark):
    objects = table(spark, obj("bad", refs={**ALL_REFS, "port": ("test-db-secret", "nothing")}))
    end = settled(spark, objects)
    assert end.objects.columns == objects.columns
    assert end.objects.first().spec == objects.first().spec
