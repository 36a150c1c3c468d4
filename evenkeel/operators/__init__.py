from evenkeel.operators.changes import ChangeRules, filter_changes, needs_work
from evenkeel.operators.children import children_of
from evenkeel.operators.conditions import condition_transitions, current_conditions
from evenkeel.operators.defaults import apply_defaults
from evenkeel.operators.expand import Child, expand_children
from evenkeel.operators.jobs import installed_items, job_state
from evenkeel.operators.reconcile import (
    apply_plan,
    carry_over,
    create_only,
    fill_if_missing,
    reconcile_plan,
    replace,
)
from evenkeel.operators.references import Field, affected_by, reference_edges, reference_lists, resolve_refs, uses
from evenkeel.operators.rows import distinct_requests, last_runs, rows_dedup, rows_minus, with_previous
from evenkeel.operators.stages import stage_rollup
from evenkeel.operators.rules import split_valid, validate

__all__ = [
    "ChangeRules",
    "Child",
    "Field",
    "affected_by",
    "apply_defaults",
    "apply_plan",
    "carry_over",
    "children_of",
    "condition_transitions",
    "create_only",
    "current_conditions",
    "distinct_requests",
    "expand_children",
    "fill_if_missing",
    "filter_changes",
    "installed_items",
    "job_state",
    "last_runs",
    "needs_work",
    "reconcile_plan",
    "reference_edges",
    "reference_lists",
    "replace",
    "resolve_refs",
    "rows_dedup",
    "rows_minus",
    "split_valid",
    "stage_rollup",
    "uses",
    "validate",
    "with_previous",
]
