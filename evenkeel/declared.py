"""Declared application objects: schema, defaults, constraints, references, children.

An object is a row (namespace, name, spec, status). The functions below put the operators
together for such tables; ``app`` is the name of the application that the objects run, from
which its command, image, paths and database names derive.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.functions import (
    append_args,
    array_dedup,
    array_minus,
    derived_name,
    has_missing,
    join_items,
    line,
    name_or_override,
    render_config,
)
from evenkeel.operators import (
    ChangeRules,
    Child,
    Field,
    apply_defaults,
    create_only,
    expand_children,
    fill_if_missing,
    job_state,
    reconcile_plan,
    replace,
    resolve_refs,
    stage_rollup,
)
from evenkeel.operators.changes import content_rules, owned_generic_rules
from evenkeel.operators.jobs import DONE, FAILED, START
from evenkeel.operators.rules import (
    Rule,
    items_match,
    length_between,
    matches,
    min_items,
    minimum,
    one_of,
    required,
    required_with,
    unique_items,
)
from evenkeel.session import stored

_REF = "struct<name: string, key: string>"

DATABASE_FIELDS = ["host", "port", "user", "password", "name", "ssl", "max_conn"]

# Schemas as DDL, for read_snapshot.
OBJECTS = (
    "namespace string, name string, "
    "spec struct<name: string, command: array<string>, replicas: int, image: string, image_pull_policy: string, "
    "image_pull_secrets: array<struct<name: string>>, "
    "database: struct<host: string, port: int, user: string, name: string, ssl: boolean, max_conn: int, "
    + ", ".join(f"{f}_ref: {_REF}" for f in DATABASE_FIELDS)
    + ">, "
    "config: struct<admin_password_secret: string, debug_mode: boolean, data_dir: string, without_demo: boolean, "
    "proxy_mode: boolean, workers: int, limit_request: int, limit_time_real: int, limit_time_cpu: int, "
    "limit_memory_soft: bigint, limit_memory_hard: bigint, max_cron_threads: int, extra_addons_paths: array<string>>, "
    "modules: array<string>, "
    "filestore: struct<size: string, storage_class: string, access_modes: array<string>>>, "
    "status struct<config_secret: string, data_volume: string, modules_installed: array<string>, "
    "current_job: struct<name: string, namespace: string, modules: array<string>>, admin_secret: string>"
)

CONDITIONS = (
    "namespace string, object string, type string, status string, reason string, message string, "
    "observed_generation bigint, ts timestamp, seq bigint"
)


def defaults(app: str) -> dict[str, Any]:
    """Declared defaults, for ``apply_defaults``."""
    # Fixed values.
    return {
        "spec.command": [app],
        "spec.replicas": 1,
        "spec.image": f"{app}:18",
        "spec.image_pull_policy": "IfNotPresent",
        "spec.database.host": "postgresql",
        "spec.database.port": 5432,
        "spec.database.user": app,
        "spec.database.name": app,
        "spec.database.ssl": False,
        "spec.database.max_conn": 20,
        "spec.config.debug_mode": False,
        "spec.config.data_dir": f"/var/lib/{app}",
        "spec.config.without_demo": True,
        "spec.config.proxy_mode": True,
        "spec.config.workers": 2,
        "spec.config.limit_request": 8192,
        "spec.config.limit_time_real": 120,
        "spec.config.limit_time_cpu": 60,
        "spec.config.limit_memory_soft": 2147483648,
        "spec.config.limit_memory_hard": 2684354560,
        "spec.config.max_cron_threads": 1,
        "spec.modules": ["base"],
        "spec.filestore.size": "10Gi",
        "spec.filestore.storage_class": "standard",
        "spec.filestore.access_modes": ["ReadWriteOnce"],
        "status.modules_installed": [],
        "status.config_secret": "",
        "status.data_volume": "",
    }


# Patterns of whole values.
PATH_PATTERN = r"/[^,\n\r# ]+"
QUANTITY_PATTERN = r"(\+|-)?(([0-9]+(\.[0-9]*)?)|(\.[0-9]+))(([KMGTPE]i)|[numkMGTPE]|([eE](\+|-)?(([0-9]+(\.[0-9]*)?)|(\.[0-9]+))))?"  # noqa: E501
REASON_PATTERN = r"[A-Za-z]([A-Za-z0-9_,:]*[A-Za-z0-9_])?"
TYPE_PATTERN = r"([a-z0-9]([-a-z0-9]*[a-z0-9])?(\.[a-z0-9]([-a-z0-9]*[a-z0-9])?)*/)?(([A-Za-z0-9][-A-Za-z0-9_.]*)?[A-Za-z0-9])"


def object_rules() -> list[Rule]:
    """Constraints on an object, for ``validate``; apply the defaults first."""
    refs = [f"spec.database.{f}_ref" for f in DATABASE_FIELDS]
    return [
        required("spec.name"),
        required("spec.database"),
        required_with("spec.database.password_ref", "spec.database"),
        *[required_with(f"{r}.key", r) for r in refs],
        minimum("spec.replicas", 1),
        items_match("spec.config.extra_addons_paths", PATH_PATTERN),
        unique_items("spec.config.extra_addons_paths"),
        min_items("spec.modules", 1),
        matches("spec.filestore.size", QUANTITY_PATTERN),
        required_with("status.current_job.name", "status.current_job"),
        required_with("status.current_job.namespace", "status.current_job"),
    ]


def condition_rules() -> list[Rule]:
    """Constraints on a row of a condition log."""
    return [
        required("type"),
        length_between("type", most=316),
        matches("type", TYPE_PATTERN),
        required("status"),
        one_of("status", ["True", "False", "Unknown"]),
        required("reason"),
        length_between("reason", 1, 1024),
        matches("reason", REASON_PATTERN),
        required("message"),
        length_between("message", most=32768),
        minimum("observed_generation", 0),
        required("ts"),
    ]


def prepared(objects: DataFrame, app: str) -> DataFrame:
    """Objects with their defaults and with each module listed once."""
    filled = apply_defaults(objects, defaults(app))
    return filled.withColumn("spec", F.col("spec").withField("modules", array_dedup("spec.modules")))


def admin_secret_name():
    return name_or_override("spec.config.admin_password_secret", derived_name("name", "-admin-password"))


def references() -> dict[str, list]:
    """What an object uses, for ``affected_by``."""
    return {
        "secret": [*[F.col(f"spec.database.{f}_ref.name") for f in DATABASE_FIELDS], F.col("spec.config.admin_password_secret")],
        "volume": [F.col("status.data_volume")],
        "workload": [F.col("name")],
        "service": [derived_name("name", "-http"), derived_name("name", "-poll")],
    }


def change_rules(parent_kind: str, parent_version: str) -> dict[str, ChangeRules]:
    """Which changes of children and secrets matter, for ``filter_changes`` on a feed with
    columns kind, op, before, after and owners."""
    return {
        "secret": content_rules("before", "after", "owners", parent_kind, parent_version),
        "workload": owned_generic_rules("owners", parent_kind, parent_version),
        "service": ChangeRules(),
        "volume": ChangeRules(),
    }


def connection_fields() -> list[Field]:
    """The connection details in the order in which they are resolved."""
    types = {"port": "int", "max_conn": "int", "ssl": "boolean"}
    return [
        Field(
            f"db_{f}",
            None if f == "password" else f"spec.database.{f}",
            F.col(f"spec.database.{f}_ref.name"),
            F.col(f"spec.database.{f}_ref.key"),
            type=types.get(f, "string"),
            required_ref=f == "password",
        )
        for f in DATABASE_FIELDS
    ]


def resolved(objects: DataFrame, secrets: DataFrame, keep: Sequence[str] = ("spec", "status")) -> DataFrame:
    """Prepared objects with admin_password, db_* and, where something failed, error_field
    and error. ``secrets`` has (namespace, name, data)."""
    admin = Field("admin_password", None, admin_secret_name(), F.lit("password"), required_ref=True)
    return resolve_refs(
        objects, secrets, [admin, *connection_fields()], ["namespace", "name"], "namespace", keep=keep
    )


def config_text():
    """The configuration file of a resolved object."""

    def conf(key):
        return f"spec.config.{key}"

    # The lines and their spacing.
    return render_config(
        "[options]",
        line("admin_passwd = ", "admin_password"),
        line("data_dir=", conf("data_dir")),
        "",
        line("db_host = ", "db_host"),
        line("db_port = ", "db_port"),
        line("db_user = ", "db_user"),
        line("db_password = ", "db_password"),
        line("db_maxconn = ", "db_max_conn"),
        line("db_name= ", "db_name"),
        "",
        line("debug_mode = ", conf("debug_mode")),
        line("without_demo = ", conf("without_demo")),
        line("proxy_mode = ", conf("proxy_mode")),
        line("workers = ", conf("workers")),
        line("limit_memory_soft = ", conf("limit_memory_soft")),
        line("limit_memory_hard = ", conf("limit_memory_hard")),
        line("limit_request = ", conf("limit_request")),
        line("limit_time_cpu = ", conf("limit_time_cpu")),
        line("limit_time_real = ", conf("limit_time_real")),
        line("max_cron_threads = ", conf("max_cron_threads")),
        line(
            "addons_path = ",
            join_items(conf("extra_addons_paths")),
            when=F.size(F.coalesce(F.col(conf("extra_addons_paths")), F.array())) > 0,
        ),
    )


def child_templates(app: str, step: Column | None = None) -> list[Child]:
    """The children of a resolved object, in the order of the stages.

    An object whose references failed gets no further than its admin secret. Payloads are the
    configuration text, and JSON for the others. With ``step``, the next step of its job (see
    ``job_state``), a job is there only to be started, and what comes after it only once it is done.
    """
    ok = F.col("error").isNull()
    job = has_missing("spec.modules", "status.modules_installed") if step is None else step == START
    done = F.lit(True) if step is None else step == DONE
    command = append_args("spec.command", "-c", f"/opt/{app}/{app}.conf")
    todo = array_minus("spec.modules", "status.modules_installed")
    install = append_args(command, "--stop-after-init", "--no-http", "--init", join_items(todo))

    def as_json(**columns):
        return F.to_json(F.struct(*[c.alias(n) for n, c in columns.items()]))

    def service(port):
        return as_json(port=F.lit(port), app=F.col("name"))

    return [
        Child("secret", admin_secret_name(), F.lit(None).cast("string")),
        Child("secret", derived_name("name", "-config"), config_text(), when=ok),
        Child("volume", "name", F.to_json("spec.filestore"), when=ok),
        Child("job", derived_name("name", "-init"), as_json(command=install, modules=todo),
              when=ok & job),
        Child("workload", "name", as_json(
            replicas=F.col("spec.replicas"), image=F.col("spec.image"), pull=F.col("spec.image_pull_policy"), command=command,
        ), when=ok & done),
        Child("service", derived_name("name", "-http"), service(8069), when=ok & done),
        Child("service", derived_name("name", "-poll"), service(8072), when=ok & done),
    ]


def desired_children(objects: DataFrame, secrets: DataFrame, app: str) -> DataFrame:
    """(namespace, name, kind, child, payload): what should exist for each object.

    From declared objects to desired rows with one join: defaults, references and rendering
    happen on the way. ``reconcile_plan`` compares the result with what is there.
    """
    ready = resolved(prepared(objects, app), secrets)
    return expand_children(ready, child_templates(app), ["namespace", "name"])


# Which rule each child is kept under; the admin secret's value is made elsewhere and never lost,
# storage and jobs are only ever created.
POLICIES = {
    "admin": fill_if_missing("payload"),
    "config": replace(),
    "volume": create_only(),
    "job": create_only(),
    "workload": replace(),
    "service": replace(),
}


def plan_children(desired: DataFrame, actual: DataFrame) -> DataFrame:
    """(namespace, name, kind, child, payload, action, changed_cols): what to do about each desired
    child, every kind under its own rule, with one join."""
    config = derived_name("name", "-config")
    role = F.when(F.col("kind") != "secret", F.col("kind")).otherwise(F.when(F.col("child") == config, "config").otherwise("admin"))
    return reconcile_plan(desired.withColumn("role", role), actual, ["namespace", "name", "kind", "child"], POLICIES, ["payload"], "role")


def whole_pass(
    objects: DataFrame, secrets: DataFrame, jobs: DataFrame, actual: DataFrame, app: str
) -> tuple[DataFrame, DataFrame]:
    """(plan, outcomes) of one pass over all stages of all objects.

    The plan is that of ``plan_children``, with nothing of a stage that an earlier one holds up. The
    outcomes are those of ``stage_rollup`` over the stages references and job. An admin secret that
    is made in this pass is read in the next one, until which the object fails its references.
    ``jobs`` has (namespace, name, active, succeeded, failed). Objects with steps are written once,
    as plan and outcomes both read them.
    """
    keys = ["namespace", "name"]
    ready = prepared(objects, app)
    steps = job_state(
        ready, jobs, keys, "spec.modules", "status.modules_installed", "status.current_job.name",
        "status.current_job.modules", job_namespace="status.current_job.namespace",
    ).select(*keys, F.col("action").alias("step"), F.col("retry_after_s").alias("step_retry_s"))
    found = stored(objects.sparkSession, resolved(ready, secrets).join(steps, keys), "pass")
    desired = expand_children(found, child_templates(app, F.col("step")), keys)
    held = F.col("step") != DONE
    stages = F.array(
        F.struct(F.lit(1).alias("ord"), F.lit("references").alias("stage"), F.col("error").isNull().alias("ok"), F.lit(False).alias("wait"),
                 F.col("error").alias("reason"), F.lit(None).cast("int").alias("retry")),
        F.struct(F.lit(2).alias("ord"), F.lit("job").alias("stage"), (F.col("step") != FAILED).alias("ok"), held.alias("wait"),
                 F.col("step").alias("reason"), F.col("step_retry_s").alias("retry")),
    )
    outcomes = stage_rollup(found.select(*keys, F.inline(stages)), keys, wait="wait", reason="reason", retry_after_s="retry")
    return plan_children(desired, actual), outcomes
