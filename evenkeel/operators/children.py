"""Children found by a label that names their parent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def children_of(
    children: DataFrame,
    parents: DataFrame,
    label: str,
    parent_name: str = "name",
    labels: str = "labels",
    namespace: str | None = "namespace",
    parent_columns: Sequence[str] = (),
) -> DataFrame:
    """Children whose ``label`` equals the name of one of ``parents``.

    With a namespace both sides must agree on it, and ``parent_columns`` may be added to the
    result. With ``namespace=None`` a child matches a parent of any namespace and is returned
    once, however many parents share the name.
    """
    tagged = children.withColumn("_parent", F.col(labels)[label]).filter("_parent IS NOT NULL")
    name = F.col(parent_name).cast("string").alias("_parent")
    if namespace is None:
        if parent_columns:
            raise ValueError("parent columns need a namespace: names alone are not unique")
        found = tagged.join(parents.select(name), ["_parent"], "left_semi")
    else:
        found = tagged.join(
            parents.select(namespace, name, *parent_columns), [namespace, "_parent"]
        )
    return found.select(*children.columns, *parent_columns)
