"""Operators on literal cases."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from evenkeel import operators as O
from evenkeel import shared_dir
from evenkeel.operators import rules as V
from evenkeel.operators.changes import content_rules, owned_generic_rules
from evenkeel.operators.conditions import latest_rows
from evenkeel.operators.defaults import EMPTY
from evenkeel.sources import read_changes, read_snapshot

T0 = datetime(2024, 1, 1)


# -- defaults -------------------------------------------------------------------------------


def test_defaults_fill_only_what_is_missing(spark):
    df = spark.createDataFrame(
        [(None, None, None), (3, ["web"], (None, False)), (None, [], ("h", None))],
        "replicas int, modules array<string>, db struct<host string, ssl boolean>",
    )
    got = O.apply_defaults(
        df, {"replicas": 1, "modules": ["base"], "db.host": "postgresql", "db.ssl": True}
    ).collect()
    assert [r.replicas for r in got] == [1, 3, 1]
    assert [r.modules for r in got] == [["base"], ["web"], []]
    assert [r.db and tuple(r.db) for r in got] == [None, ("postgresql", False), ("h", True)]


def test_defaulted_parent_struct_takes_its_fields_defaults(spark):
    df = spark.createDataFrame([(None,), ((None, 9),)], "c struct<workers int, cron int>")
    got = O.apply_defaults(df, {"c": EMPTY, "c.workers": 2}).collect()
    assert [tuple(r.c) for r in got] == [(2, None), (2, 9)]


def test_defaults_keep_the_schema(spark):
    df = spark.createDataFrame([((None, (None,)),)], "a struct<x bigint, b struct<y string>>")
    out = O.apply_defaults(df, {"a.x": 2147483648, "a.b.y": "z"})
    assert out.schema["a"].dataType.simpleString() == df.schema["a"].dataType.simpleString()
    assert out.first().a == ((2147483648, ("z",)))


# -- validation -----------------------------------------------------------------------------

PATHS = [
    (["/mnt/extra-addons"], True),
    (["/mnt/addons-a", "/mnt/addons-b"], True),
    (["extra-addons"], False),
    (["/mnt/ex,tra"], False),
    (["/mnt/add#ons"], False),
    (["/mnt/extra addons"], False),
    (["/mnt/add\nons"], False),
    (["/mnt/a", "/mnt/a"], False),
    (["/mnt/a\n"], False),
    ([], True),
    (None, True),
]


def test_path_validation(spark):
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(PATHS)], "i int, paths array<string>")
    rules = [V.items_match("paths", r"/[^,\n\r# ]+"), V.unique_items("paths")]
    ok, bad = O.split_valid(df, rules)
    assert sorted(r.i for r in ok.collect()) == [i for i, (_, good) in enumerate(PATHS) if good]
    assert ok.columns == df.columns
    assert bad.count() + ok.count() == df.count()
    names = {r.i: r.violations for r in bad.collect()}
    assert names[7] == ["paths:unique"] and names[2] == ["paths:item_pattern"]


def test_every_rule(spark):
    df = spark.createDataFrame(
        [(1, "ab", ["x"], "True", None, "k"), (0, None, [], "Maybe", "n", None), (None, "", None, None, None, None)],
        "n int, s string, items array<string>, status string, ref string, key string",
    )
    rules = [
        V.required("s"), V.minimum("n", 1), V.min_items("items", 1),
        V.one_of("status", ["True", "False", "Unknown"]), V.length_between("s", 1, 10),
        V.matches("s", "[a-z]+"), V.required_with("key", "ref"),
        V.items_satisfy("items", lambda x: x == "x", "no_x"),
    ]
    got = [r.violations for r in O.validate(df, rules).collect()]
    assert got == [
        ["no_x"],
        ["s:required", "n:minimum", "items:min_items", "status:enum", "key:required"],
        ["s:length", "s:pattern"],
    ]


# -- fan-out --------------------------------------------------------------------------------


def test_expand_children(spark, rows):
    df = spark.createDataFrame([("ns", "a", True), ("ns", "b", False)], "namespace string, name string, job boolean")
    out = O.expand_children(
        df,
        [
            O.Child("config", F.concat("name", F.lit("-config")), F.lit("x")),
            O.Child("main", "name"),
            O.Child("init", F.concat("name", F.lit("-init")), when=F.col("job")),
        ],
        keep=["namespace", "name"],
    )
    assert rows(out) == [
        ("ns", "a", "config", "a-config", "x"), ("ns", "a", "init", "a-init", None), ("ns", "a", "main", "a", None),
        ("ns", "b", "config", "b-config", "x"), ("ns", "b", "main", "b", None),
    ]


# -- changes --------------------------------------------------------------------------------


def test_change_matrix(spark):
    kinds, ops = ["content", "owned", "plain", "other"], ["create", "update", "delete", "generic"]
    mine = [("Parent", "v1", "p", True)]
    data, i = [], 0
    for kind in kinds:
        for op in ops:
            for owners in (mine, []):
                for after in ("same", "new"):
                    data.append((i, kind, op, {"k": b"same"}, {"k": after.encode()}, owners))
                    i += 1
    df = spark.createDataFrame(
        data,
        "i int, kind string, op string, before map<string,binary>, after map<string,binary>, "
        "owners array<struct<kind string, api_version string, name string, controller boolean>>",
    )
    rules = {
        "content": content_rules("before", "after", "owners", "Parent", "v1"),
        "owned": owned_generic_rules("owners", "Parent", "v1"),
        "plain": O.ChangeRules(),
    }
    got = {r.i for r in O.filter_changes(df, rules).collect()}

    def passes(kind, op, owners, before, after):
        if kind == "other":
            return False
        if op == "generic":
            return kind == "plain" or bool(owners)
        return not (kind == "content" and op == "update") or before != after

    assert got == {d[0] for d in data if passes(d[1], d[2], d[5], d[3]["k"], d[4]["k"])}


def test_needs_work(spark):
    df = spark.createDataFrame(
        [(1, ["base", "web"], ["base"]), (2, ["base"], ["base", "web"]), (3, ["a"], None), (4, None, ["a"])],
        "i int, want array<string>, have array<string>",
    )
    assert sorted(r.i for r in O.needs_work(df, "want", "have").collect()) == [1, 3]


# -- references -----------------------------------------------------------------------------

REFS = ["host", "port", "user", "password", "dbname", "ssl", "maxconn"]


@pytest.fixture
def one_object(spark):
    row = ("default", "my-app", *[f"my-db-{r}-secret" for r in REFS], None, "my-pvc-name")
    cols = ", ".join(f"{c} string" for c in ["namespace", "name", *[f"{r}_ref" for r in REFS], "admin", "pvc"])
    return spark.createDataFrame([row], cols)


@pytest.mark.parametrize(
    "kind, name, matches",
    [("pvc", "another-pvc-name", 0), ("pvc", "my-pvc-name", 1), ("secret", "another-secret", 0)]
    + [("secret", f"my-db-{r}-secret", 1) for r in REFS]
    + [("secret", "", 0)]
    + [("deployment", "another-deployment", 0), ("deployment", "my-app", 1)]
    + [("service", "another-service", 0), ("service", "my-app-http", 1), ("service", "my-app-poll", 1)],
)
def test_reverse_dependency(spark, one_object, kind, name, matches):
    refs = {
        "secret": [*[f"{r}_ref" for r in REFS], "admin"],
        "pvc": ["pvc"],
        "deployment": ["name"],
        "service": [F.concat("name", F.lit("-http")), F.concat("name", F.lit("-poll"))],
    }
    changed = spark.createDataFrame([("default", kind, name)], "namespace string, kind string, name string")
    got = O.affected_by(one_object, changed, ["namespace", "name"], refs, "namespace")
    assert got.count() == matches
    elsewhere = changed.withColumn("namespace", F.lit("other"))
    assert O.affected_by(one_object, elsewhere, ["namespace", "name"], refs, "namespace").count() == 0
    assert one_object.filter(O.uses(name, *refs[kind])).count() == matches


def test_affected_once_even_if_used_twice(spark, rows):
    objects = spark.createDataFrame([("a", "s", "s"), ("b", "s", "t"), ("c", None, "u")], "o string, r1 string, r2 string")
    changed = spark.createDataFrame([("secret", "s"), ("secret", "t"), ("secret", "s")], "kind string, name string")
    assert rows(O.affected_by(objects, changed, "o", {"secret": ["r1", "r2"]})) == [("a",), ("b",)]


def resolve(spark, objects, lookup):
    fields = [
        O.Field("host", "host", "host_ref", "host_key"),
        O.Field("port", "port", "port_ref", "port_key", type="int"),
        O.Field("password", None, "pw_ref", "pw_key", required_ref=True),
    ]
    df = spark.createDataFrame(
        objects,
        "ns string, name string, host string, host_ref string, host_key string, port int, port_ref string, "
        "port_key string, pw_ref string, pw_key string",
    )
    table = spark.createDataFrame(lookup, "ns string, name string, data map<string,binary>")
    out = O.resolve_refs(df, table, fields, ["ns", "name"], "ns")
    return {r.name: (r.host, r.port, r.password, r.error_field, r.error) for r in out.collect()}


def test_resolve_refs(spark):
    secret = {"host": b"db", "port": b"5432", "pw": b"x", "text": b"abc"}
    got = resolve(
        spark,
        [
            ("n", "all", "h", "s", "host", 1, "s", "port", "s", "pw"),
            ("n", "inline", "h", None, None, 1, "", "port", "s", "pw"),
            ("n", "half", "h", "s", "", 1, "s", None, "s", "pw"),
            ("n", "no-row", "h", "gone", "host", 1, None, None, "s", "pw"),
            ("n", "no-key", "h", "s", "nope", 1, None, None, "s", "pw"),
            ("n", "no-pw", "h", None, None, 1, None, None, None, None),
            ("n", "bad-port", "h", None, None, 1, "s", "text", "s", "pw"),
            ("n", "first", "h", "s", "nope", 1, "gone", "port", None, None),
            ("m", "other-ns", "h", "s", "host", 1, None, None, "s", "pw"),
        ],
        [("n", "s", secret), ("m", "t", secret)],
    )
    assert got == {
        "all": ("db", 5432, "x", None, None),
        "inline": ("h", 1, "x", None, None),
        "half": ("h", 1, "x", None, None),
        "no-row": (None, None, None, "host", "NOT_FOUND"),
        "no-key": (None, None, None, "host", "KEY_NOT_FOUND"),
        "no-pw": (None, None, None, "password", "REF_MISSING"),
        "bad-port": (None, None, None, "port", "BAD_VALUE"),
        "first": (None, None, None, "host", "KEY_NOT_FOUND"),
        "other-ns": (None, None, None, "host", "NOT_FOUND"),
    }


def test_resolve_refs_keeps_columns(spark):
    df = spark.createDataFrame([(1, "a", "s", "k")], "id int, extra string, r string, k string")
    table = spark.createDataFrame([("s", {"k": "v"})], "name string, data map<string,string>")
    out = O.resolve_refs(df, table, [O.Field("x", None, "r", "k")], "id", keep=["extra"])
    assert [tuple(r) for r in out.collect()] == [(1, "a", "v", None, None)]


# -- children -------------------------------------------------------------------------------


def test_children_of(spark, rows):
    pods = spark.createDataFrame(
        [("n1", "p1", {"job-name": "j"}), ("n2", "p2", {"job-name": "j"}), ("n1", "p3", {"job-name": "k"}), ("n1", "p4", {})],
        "namespace string, pod string, labels map<string,string>",
    )
    jobs = spark.createDataFrame([("n1", "j"), ("n3", "j")], "namespace string, name string")
    names = lambda df: sorted(r.pod for r in df.collect())
    assert names(O.children_of(pods, jobs, "job-name")) == ["p1"]
    assert names(O.children_of(pods, jobs, "job-name", namespace=None)) == ["p1", "p2"]
    with_parent = O.children_of(pods, jobs.withColumn("done", F.lit(True)), "job-name", parent_columns=["done"])
    assert with_parent.columns == ["namespace", "pod", "labels", "done"] and with_parent.first().done


# -- reconcile ------------------------------------------------------------------------------


def plan_of(spark, desired, actual, policy=None):
    ddl = "k int, replicas int, command string"
    d, a = spark.createDataFrame(desired, ddl), spark.createDataFrame(actual, ddl)
    plan = O.reconcile_plan(d, a, "k", policy)
    return {r.k: (r.action, r.replicas, r.command, r.changed_cols) for r in plan.collect()}


DESIRED = [(1, 2, "run"), (2, 3, "run"), (3, 2, None), (4, 2, None)]
ACTUAL = [(2, 2, "run"), (3, 2, None), (4, 2, "x"), (9, 1, "extra")]


def test_replace(spark):
    assert plan_of(spark, DESIRED, ACTUAL) == {
        1: ("CREATE", 2, "run", []),
        2: ("UPDATE", 3, "run", ["replicas"]),
        3: ("NOOP", 2, None, []),
        4: ("UPDATE", 2, None, ["command"]),
    }


def test_carry_over(spark):
    assert plan_of(spark, DESIRED, ACTUAL, O.carry_over("command")) == {
        1: ("CREATE", 2, None, []),
        2: ("UPDATE", 3, "run", ["replicas"]),
        3: ("NOOP", 2, None, []),
        4: ("NOOP", 2, "x", []),
    }


def test_create_only(spark):
    assert plan_of(spark, DESIRED, ACTUAL, O.create_only()) == {
        1: ("CREATE", 2, "run", []),
        2: ("NOOP", 2, "run", []),
        3: ("NOOP", 2, None, []),
        4: ("NOOP", 2, "x", []),
    }


def test_fill_if_missing(spark):
    desired = [(1, 1, "new"), (2, 1, "new"), (3, 1, "new")]
    actual = [(2, 5, "old"), (3, 5, None)]
    assert plan_of(spark, desired, actual, O.fill_if_missing("command")) == {
        1: ("CREATE", 1, "new", []),
        2: ("NOOP", 5, "old", []),
        3: ("UPDATE", 1, "new", ["replicas", "command"]),
    }


def test_reconcile_compares_maps_and_structs(spark):
    ddl = "k int, data map<string,string>, spec struct<a int, b array<string>>"
    d = spark.createDataFrame([(1, {"x": "1", "y": "2"}, (1, ["p"])), (2, {"x": "1"}, (1, ["p"]))], ddl)
    a = spark.createDataFrame([(1, {"y": "2", "x": "1"}, (1, ["p"])), (2, {"x": "2"}, (1, ["q"]))], ddl)
    got = {r.k: (r.action, r.changed_cols) for r in O.reconcile_plan(d, a, "k").collect()}
    assert got == {1: ("NOOP", []), 2: ("UPDATE", ["data", "spec"])}


def test_apply_then_plan_is_noop_and_extras_stay(spark, rows):
    ddl = "k int, replicas int, command string"
    d, a = spark.createDataFrame(DESIRED, ddl), spark.createDataFrame(ACTUAL, ddl)
    plan = O.reconcile_plan(d, a, "k")
    after = O.apply_plan(a, plan, "k")
    assert rows(O.apply_plan(a, plan, "k", staged=shared_dir(spark, "plan"))) == rows(after)
    assert rows(after) == sorted(DESIRED + [(9, 1, "extra")], key=repr)
    again = O.reconcile_plan(d, after, "k")
    assert {r.action for r in again.collect()} == {"NOOP"}


def test_apply_drops_delete_rows_and_checks_columns(spark, rows):
    a = spark.createDataFrame(ACTUAL, "k int, replicas int, command string")
    plan = spark.createDataFrame([(9, None, None, "DELETE")], "k int, replicas int, command string, action string")
    assert rows(O.apply_plan(a, plan, "k")) == ACTUAL[:3]
    with pytest.raises(ValueError, match="command"):
        O.apply_plan(a, plan.drop("command"), "k")


# -- rows -----------------------------------------------------------------------------------


def test_rows_minus_keeps_duplicates_and_nulls(spark, rows):
    a = spark.createDataFrame([("base",), ("base",), ("web",), ("web",), (None,)], "m string")
    b = spark.createDataFrame([("base",), (None,), ("base",)], "m string")
    assert rows(O.rows_minus(a, b, "m")) == [("web",), ("web",), (None,)]
    assert O.rows_minus(a, a.filter("m is not null"), "m").count() == 1


def test_rows_dedup_and_requests(spark, rows):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 3, "z")], "k string, n int, v string")
    assert rows(O.rows_dedup(df, "k", "n")) == [("a", 1, "x"), ("b", 3, "z")]
    assert rows(latest_rows(df, ["k"], ["n"])) == [("a", 2, "y"), ("b", 3, "z")]
    assert rows(O.distinct_requests(df, "k")) == [("a",), ("b",)]


# -- conditions -----------------------------------------------------------------------------


def log_rows(seed, n=400, keys=5):
    rng = random.Random(seed)
    out = []
    for seq in range(n):
        # Half of the rows belong to one key.
        key = "hot" if rng.random() < 0.5 else f"k{rng.randrange(keys)}"
        ts = T0 + timedelta(seconds=rng.randrange(n // 3))
        status = rng.choices(["True", "False", "Unknown", None], [6, 2, 1, 1])[0]
        out.append((key, "Ready", status, f"r{seq}", ts, seq))
    rng.shuffle(out)
    return out


def brute(log):
    state = {}
    for key, kind, status, reason, ts, seq in sorted(log, key=lambda r: (r[4], r[5])):
        old = state.get((key, kind))
        since = old[2] if old and old[0] == status else ts
        state[(key, kind)] = (status, reason, since)
    return state


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_conditions_against_brute_force(spark, seed):
    data = log_rows(seed)
    log = spark.createDataFrame(data, "object string, type string, status string, reason string, ts timestamp_ntz, seq bigint")
    keys = ["object", "type"]
    current = O.current_conditions(log, keys, values=["status", "reason"])
    moved = O.condition_transitions(log, keys)
    expected = brute(data)
    assert {(r.object, r.type): (r.status, r.reason) for r in current.collect()} == {
        k: v[:2] for k, v in expected.items()
    }
    assert {(r.object, r.type): (r.status, r.last_transition_time) for r in moved.collect()} == {
        k: (v[0], v[2]) for k, v in expected.items()
    }


def test_new_reason_alone_keeps_the_transition_time(spark):
    log = spark.createDataFrame(
        [("o", "t", "True", "a", T0, 1), ("o", "t", "True", "b", T0 + timedelta(hours=1), 2)],
        "object string, type string, status string, reason string, ts timestamp_ntz, seq bigint",
    )
    assert O.condition_transitions(log, ["object", "type"]).first().last_transition_time == T0


# -- stages ---------------------------------------------------------------------------------


def test_stage_rollup(spark):
    df = spark.createDataFrame(
        [
            ("ok", 1, "a", True, False, None, None), ("ok", 2, "b", True, False, None, None),
            ("fail", 1, "a", True, False, None, None), ("fail", 2, "b", False, False, "boom", None), ("fail", 3, "c", False, False, "later", None),
            ("wait", 2, "b", True, False, None, None), ("wait", 1, "a", True, True, "running", 30),
            ("stuck", 1, "a", True, True, "job failed", None), ("own", 1, "a", False, False, "x", 30),
        ],
        "o string, ord int, stage string, ok boolean, wait boolean, reason string, retry int",
    ).withColumn("ts", F.lit(T0).cast("timestamp_ntz"))
    out = O.stage_rollup(df, "o", wait="wait", reason="reason", retry_after_s="retry", at="ts")
    got = {r.o: tuple(r)[1:] for r in out.collect()}
    assert got == {
        "ok": ("SUCCEEDED", None, None, None, 2, None),
        "fail": ("FAILED", "b", "boom", 15, 3, T0 + timedelta(seconds=15)),
        "wait": ("WAITING", "a", "running", 30, 2, T0 + timedelta(seconds=30)),
        "stuck": ("WAITING", "a", "job failed", None, 1, None),
        "own": ("FAILED", "a", "x", 30, 1, T0 + timedelta(seconds=30)),
    }


# -- jobs -----------------------------------------------------------------------------------


def test_installed_items(spark):
    df = spark.createDataFrame(
        [("o", 2, ["web", "base"], True), ("o", 1, ["base"], True), ("o", 3, ["crm"], False)],
        "o string, seq int, modules array<string>, ok boolean",
    )
    out = O.installed_items(df, "o", "modules", "seq", F.col("ok")).orderBy("seq", "item_no")
    assert [r.item for r in out.collect()] == ["base", "web", "base"]


def test_job_state(spark):
    cases = {
        "A": (["base", "web"], None, None, None, ("START", ["base", "web"], [], 30, False)),
        "B": (["base", "web"], ["base"], None, None, ("START", ["web"], ["base"], 30, False)),
        "B2": (["base", "crm"], ["base", "web"], None, None, ("START", ["crm"], ["base", "web"], 30, False)),
        "C": (["base", "web"], ["base", "web"], None, None, ("DONE", [], ["base", "web"], None, True)),
        "D": (["base", "web", "base", "web"], [], None, None, ("START", ["base", "web"], [], 30, False)),
        "E": (["base", "web"], ["base"], "ok", ["web"], ("CLEAR", ["web"], ["base", "web"], 30, False)),
        "run": (["base", "web"], ["base"], "active", ["web"], ("WAIT", [], ["base"], 15, False)),
        "bad": (["base", "web"], ["base"], "failed", ["web"], ("FAILED", [], ["base"], None, False)),
        "idle": (["base", "web"], ["base"], "idle", ["web"], ("START", ["web"], ["base"], 30, False)),
        "gone": (["base", "web"], ["base"], "gone", ["web"], ("START", ["web"], ["base"], 30, False)),
        "gone-done": (["base"], ["base"], "gone", ["web"], ("DONE", [], ["base"], None, True)),
        "empty-name": (["base"], ["base"], "", ["web"], ("DONE", [], ["base"], None, True)),
    }
    objects = spark.createDataFrame(
        [("n", k, want, have, job, items) for k, (want, have, job, items, _) in cases.items()],
        "namespace string, name string, desired array<string>, installed array<string>, job_name string, job_items array<string>",
    )
    jobs = spark.createDataFrame(
        [("n", "ok", 1, 1, 1), ("n", "active", 1, 0, 1), ("n", "failed", 0, 0, 1), ("n", "idle", 0, 0, 0), ("m", "gone", 0, 1, 0)],
        "namespace string, name string, active int, succeeded int, failed int",
    )
    out = O.job_state(objects, jobs, ["namespace", "name"])
    assert {r.name: tuple(r)[2:] for r in out.collect()} == {k: v[-1] for k, v in cases.items()}


def test_policies_per_kind_in_one_plan(spark, rows):
    ddl = "kind string, name string, a string, b string"
    desired = spark.createDataFrame(
        [("volume", "v", "20Gi", "x"), ("volume", "new", "20Gi", "x"), ("secret", "full", None, "x"), ("secret", "empty", "pw", "x"),
         ("service", "s", "port", "mine"), ("workload", "w", "2", "x"), (None, "n", "2", "x")], ddl)
    actual = spark.createDataFrame(
        [("volume", "v", "10Gi", "x"), ("secret", "full", "old", "y"), ("secret", "empty", None, "x"),
         ("service", "s", "port", "theirs"), ("workload", "w", "1", "x"), (None, "n", "1", "x")], ddl)
    policies = {"volume": O.create_only(), "secret": O.fill_if_missing("a"), "service": O.carry_over("b")}
    plan = O.reconcile_plan(desired, actual.withColumn("kind", F.coalesce("kind", F.lit("?"))).drop("kind"), "name", policies, values=["a", "b"])
    got = {r.name: (r.a, r.b, r.action, r.changed_cols) for r in plan.collect()}
    assert got == {
        "v": ("10Gi", "x", "NOOP", []), "new": ("20Gi", "x", "CREATE", []), "full": ("old", "y", "NOOP", []),
        "empty": ("pw", "x", "UPDATE", ["a"]), "s": ("port", "theirs", "NOOP", []), "w": ("2", "x", "UPDATE", ["a"]),
        "n": ("2", "x", "UPDATE", ["a"]),
    }


def test_a_recorded_job_is_found_in_its_own_namespace(spark):
    objects = spark.createDataFrame(
        [("n", "a", ["x"], [], "j", ["x"], "jobs"), ("n", "b", ["x"], [], "j", ["x"], None)],
        "namespace string, name string, desired array<string>, installed array<string>, job_name string, job_items array<string>, job_ns string",
    )
    jobs = spark.createDataFrame([("jobs", "j", 0, 1, 0), ("n", "j", 1, 0, 0)], "namespace string, name string, active int, succeeded int, failed int")
    found = O.job_state(objects, jobs, ["namespace", "name"], job_namespace="job_ns")
    assert {r.name: r.action for r in found.collect()} == {"a": "CLEAR", "b": "WAIT"}


def test_payloads_that_are_not_json(spark, tmp_path):
    spark.createDataFrame([(1, '{"a": 5}'), (2, "{oops"), (3, None)], "k int, body string").write.parquet(f"{tmp_path}/t")
    out = read_snapshot(spark, f"{tmp_path}/t", "k int, body string", payload="body", payload_schema="a int", payload_error="bad")
    assert sorted(tuple(r) for r in out.collect()) == [(1, 5, None), (2, None, "{oops"), (3, None, None)]
    with pytest.raises(ValueError):
        read_snapshot(spark, f"{tmp_path}/t", "k int, body string", payload="body", payload_schema="k int")


def test_one_bound_for_a_micro_batch(spark, tmp_path):
    with pytest.raises(ValueError):
        read_changes(spark, str(tmp_path), "k int", max_files=1, max_bytes=1)
