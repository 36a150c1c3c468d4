"""Deciding which change records cause work."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.functions._cols import ColumnLike, as_col
from evenkeel.functions.arrays import has_missing
from evenkeel.functions.maps import maps_equal
from evenkeel.functions.owners import owned_or


@dataclass(frozen=True)
class ChangeRules:
    """One condition per operation of one kind; None passes every record."""

    create: Column | None = None
    update: Column | None = None
    delete: Column | None = None
    generic: Column | None = None


def content_rules(before: ColumnLike, after: ColumnLike, owners: ColumnLike, kind: str, api_version: str) -> ChangeRules:
    """Updates count only if the content map differs, generic records only if owned."""
    return ChangeRules(
        update=~maps_equal(before, after), generic=owned_or(owners, kind, api_version)
    )


def owned_generic_rules(owners: ColumnLike, kind: str, api_version: str) -> ChangeRules:
    """Everything passes, generic records only if owned."""
    return ChangeRules(generic=owned_or(owners, kind, api_version))


def filter_changes(
    changes: DataFrame,
    rules: Mapping[str, ChangeRules],
    kind: ColumnLike = "kind",
    op: ColumnLike = "op",
) -> DataFrame:
    """Records that cause work. Kinds without rules are not watched and are dropped.

    A plain filter, so it works on tables and streams alike.
    """
    decision = None
    for watched, rule in rules.items():
        by_op = (
            F.when(as_col(op) == "create", _or_pass(rule.create))
            .when(as_col(op) == "update", _or_pass(rule.update))
            .when(as_col(op) == "delete", _or_pass(rule.delete))
            .when(as_col(op) == "generic", _or_pass(rule.generic))
            .otherwise(F.lit(False))
        )
        is_kind = as_col(kind) == watched
        decision = F.when(is_kind, by_op) if decision is None else decision.when(is_kind, by_op)
    if decision is None:
        return changes.filter(F.lit(False))
    return changes.filter(decision.otherwise(F.lit(False)))


def _or_pass(rule: Column | None) -> Column:
    return F.lit(True) if rule is None else rule


def needs_work(df: DataFrame, desired: ColumnLike, done: ColumnLike) -> DataFrame:
    """Only rows that have desired items not done yet."""
    return df.filter(has_missing(desired, done))
