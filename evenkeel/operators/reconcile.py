"""Desired against actual rows, and applying the resulting plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions._cols import as_list
from evenkeel.functions.maps import maps_equal
from evenkeel.session import stored

CREATE, UPDATE, DELETE, NOOP = "CREATE", "UPDATE", "DELETE", "NOOP"


@dataclass(frozen=True)
class Policy:
    """How differences are treated. Use the functions below to make one."""

    carried: tuple[str, ...] = field(default=())
    updates: bool = True
    only_if_missing: str | None = None


def replace() -> Policy:
    """Any difference gives UPDATE with all desired values."""
    return Policy()


def carry_over(*columns: str) -> Policy:
    """Take the listed columns from the actual row first: values that the other side assigns
    are never drift. A row to be created has them null."""
    return Policy(carried=columns)


def create_only() -> Policy:
    """Create what is missing, never update."""
    return Policy(updates=False)


def fill_if_missing(column: str) -> Policy:
    """UPDATE only where the actual value of the column is absent; a present row is kept."""
    return Policy(only_if_missing=column)


def reconcile_plan(
    desired: DataFrame,
    actual: DataFrame,
    keys: str | Sequence[str],
    policy: Policy | Mapping[str, Policy] | None = None,
    values: Sequence[str] | None = None,
    kind: str = "kind",
) -> DataFrame:
    """One row per desired row: keys, the values to hold afterwards, action, changed_cols.

    CREATE where the actual row is missing, UPDATE where it differs and the policy lets it,
    else NOOP with the actual values. Rows that only ``actual`` has are never planned. ``keys``
    identify a row on both sides and are not null; values are compared null-safely.

    With a mapping, each row is under the policy of its column ``kind``, rows of other kinds under
    ``replace``; all kinds are planned together. One left join on the keys, by sorting: Spark guesses
    the size of expanded rows by that of the rows they come from, several times too small, and would
    collect ``actual`` on the driver. Where both tables are bucketed by the keys it needs no shuffle.
    """
    keys = as_list(keys)
    values = list(values) if values is not None else [c for c in desired.columns if c not in keys]
    types = {f.name: f.dataType for f in desired.schema}
    by_kind = policy if isinstance(policy, Mapping) else {}
    other = replace() if policy is None or by_kind else policy
    extra = [kind] if by_kind and kind not in [*keys, *values] else []

    have = actual.select(
        *keys, *[F.col(c).alias(f"_have_{c}") for c in values], F.lit(True).alias("_present")
    )
    joined = desired.select(*keys, *values, *extra).join(have.hint("merge"), keys, "left")
    missing = F.col("_present").isNull()
    none = F.array().cast("array<string>")

    def each(make):
        """What ``make`` gives for the policy that a row is under."""
        out = None
        for name, own in by_kind.items():
            out = F.when(F.col(kind) == name, make(own)) if out is None else out.when(F.col(kind) == name, make(own))
        return make(other) if out is None else out.otherwise(make(other))

    def differs(c: str):
        if isinstance(types[c], T.MapType):
            return ~maps_equal(c, f"_have_{c}")
        return ~F.col(c).eqNullSafe(F.col(f"_have_{c}"))

    def changes(p: Policy):
        names = [F.when(differs(c), F.lit(c)) for c in values if c not in p.carried]
        if not p.updates or not names:
            return none
        changed = F.array_compact(F.array(*names))
        return F.when(F.col(f"_have_{p.only_if_missing}").isNull(), changed).otherwise(none) if p.only_if_missing else changed

    acted = joined.withColumn("changed_cols", F.when(missing, none).otherwise(each(changes))).withColumn(
        "action",
        F.when(missing, F.lit(CREATE))
        .when(F.size("changed_cols") > 0, F.lit(UPDATE))
        .otherwise(F.lit(NOOP)),
    )
    keep_actual = F.col("action") == NOOP

    def held(c: str):
        mine, theirs = F.col(c), F.col(f"_have_{c}")
        return each(lambda p: theirs if c in p.carried else F.when(keep_actual, theirs).otherwise(mine)).alias(c)

    return acted.select(*keys, *[held(c) for c in values], "action", "changed_cols")


def apply_plan(
    actual: DataFrame, plan: DataFrame, keys: str | Sequence[str], staged: str | None = None
) -> DataFrame:
    """The actual table after the plan: created and updated rows from the plan, other rows as
    they are. DELETE rows, which only a caller can add, disappear.

    The plan has to carry every column of ``actual``. Only changed rows matter, once as keys
    in an anti join and once as rows; where they are few they are broadcast and ``actual`` is
    not shuffled. They are written to the shared folder first (or to ``staged``, a folder that
    does not exist yet), so that the plan is computed once and their size is known. The call
    writes; the folder has to stay as long as the result is read.
    """
    keys = as_list(keys)
    lacking = [c for c in actual.columns if c not in plan.columns]
    if lacking:
        raise ValueError(f"the plan lacks columns of the table: {lacking}")
    touched = plan.filter(F.col("action") != NOOP).select(*dict.fromkeys([*keys, *actual.columns, "action"]))
    if staged is None:
        touched = stored(touched.sparkSession, touched, "plan")
    else:
        touched.write.parquet(staged)
        touched = touched.sparkSession.read.schema(touched.schema).parquet(staged)
    written = touched.filter(F.col("action") != DELETE).select(*actual.columns)
    return actual.join(touched.select(*keys), keys, "left_anti").select(*actual.columns).unionByName(written)
