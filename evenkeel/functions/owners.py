"""Owner references: ``array<struct<kind, api_version, name, controller>>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evenkeel.functions._cols import ColumnLike, as_col


def controller_owner(refs: ColumnLike, kind: str, api_version: str) -> Column:
    """Name of the controlling owner if its kind and version match, else null."""
    controlling = F.filter(as_col(refs), lambda r: F.coalesce(r["controller"], F.lit(False)))
    first = F.get(controlling, F.lit(0))
    return F.when(
        (first["kind"] == kind) & (first["api_version"] == api_version), first["name"]
    )


def owned_or(refs: ColumnLike, kind: str, api_version: str, predicate: Column | None = None) -> Column:
    """Owned by the parent kind, or the caller's predicate holds."""
    owned = controller_owner(refs, kind, api_version).isNotNull()
    return owned if predicate is None else owned | F.coalesce(predicate, F.lit(False))
