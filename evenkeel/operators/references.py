"""References between objects: who uses a name, who is affected, what a reference yields."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions._cols import ColumnLike, as_col, as_list
from evenkeel.functions.checks import BAD_VALUE
from evenkeel.functions.names import blank_to_null
from evenkeel.operators.skew import null_spread

REF_MISSING = "REF_MISSING"
NOT_FOUND = "NOT_FOUND"
KEY_NOT_FOUND = "KEY_NOT_FOUND"


def uses(name: ColumnLike | int, *refs: ColumnLike) -> Column:
    """True where any of the reference columns holds the name.

    ``name`` is a literal text or number, or a Column. Unset references match nothing.
    """
    wanted = name if isinstance(name, Column) else F.lit(name)
    return F.coalesce(F.array_contains(F.array(*[as_col(r) for r in refs]), wanted), F.lit(False))


def reference_edges(
    objects: DataFrame,
    keys: str | Sequence[str],
    refs: Mapping[str, Sequence[ColumnLike]],
    namespace: str | None = None,
) -> DataFrame:
    """(keys, namespace, ref_kind, ref_name): one row per reference of an object that is set.

    Names keep their type where all reference columns share one, else they become text.
    """
    types = {_type(objects, c) for cols in refs.values() for c in cols}
    plain = len(types) == 1
    items = [
        F.struct(
            F.lit(kind).alias("ref_kind"),
            (as_col(c) if plain else as_col(c).cast("string")).alias("ref_name"),
        )
        for kind, cols in refs.items()
        for c in cols
    ]
    kept = as_list(keys)
    if namespace and namespace not in kept:
        kept.append(namespace)
    edges = objects.select(*kept, F.inline(F.array(*items)))
    if edges.schema["ref_name"].dataType == T.StringType():
        return edges.filter(F.col("ref_name") != "")
    return edges.filter(F.col("ref_name").isNotNull())


REFERENCE = "struct<ref_kind: string, ref_name: string>"


def reference_lists(objects: DataFrame, keys: str | Sequence[str], refs: Mapping[str, Sequence[ColumnLike]], namespace: str) -> DataFrame:
    """(keys, namespace, refs): the references of each object as one list, for a table of edges that
    is kept by object; unset ones are left out, names are text."""
    items = [
        F.when(F.coalesce(as_col(c).cast("string"), F.lit("")) != "", F.struct(F.lit(kind).alias("ref_kind"), as_col(c).cast("string").alias("ref_name")))
        for kind, cols in refs.items()
        for c in cols
    ]
    kept = list(dict.fromkeys([*as_list(keys), namespace]))
    return objects.select(*kept, F.array_distinct(F.array_compact(F.array(*items))).cast(f"array<{REFERENCE}>").alias("refs"))


def _type(df: DataFrame, c: ColumnLike) -> T.DataType:
    return df.select(as_col(c).alias("x")).schema["x"].dataType


def affected_by(
    objects: DataFrame,
    changed: DataFrame,
    keys: str | Sequence[str],
    refs: Mapping[str, Sequence[ColumnLike]],
    namespace: str | None = None,
) -> DataFrame:
    """Keys of the objects that use anything in ``changed``, each at most once.

    ``changed`` has columns kind, name and, when given, the namespace; only references within
    the same namespace count. The references are unpivoted so that the test is an equi join
    (an OR over the columns would be a nested loop). Spark broadcasts ``changed`` when it is
    small; else a name shared by very many objects is split by adaptive execution, which can
    do so because the deduplication that follows is on other keys.
    """
    on_ns = [namespace] if namespace else []
    edges = reference_edges(objects, keys, refs, namespace)
    name_type = edges.schema["ref_name"].dataType
    if changed.schema["name"].dataType != name_type:
        name_type = T.StringType()
        edges = edges.withColumn("ref_name", F.col("ref_name").cast(name_type))
    names = changed.select(
        *on_ns, F.col("kind").alias("ref_kind"), F.col("name").cast(name_type).alias("ref_name")
    )
    used = edges.join(names, [*on_ns, "ref_kind", "ref_name"], "left_semi")
    return used.select(*as_list(keys)).distinct()


@dataclass(frozen=True)
class Field:
    """A value given inline or by a (row name, key) reference into the lookup table."""

    name: str
    inline: ColumnLike | None = None
    ref_name: ColumnLike | None = None
    ref_key: ColumnLike | None = None
    type: str = "string"
    required_ref: bool = False


def resolve_refs(
    objects: DataFrame,
    lookup: DataFrame,
    fields: Sequence[Field],
    keys: str | Sequence[str],
    namespace: str | None = None,
    lookup_name: str = "name",
    lookup_data: str = "data",
    keep: Sequence[str] = (),
) -> DataFrame:
    """``keys`` and ``keep`` plus one column per field, ``error_field`` and ``error``.

    A field whose reference has both name and key takes the looked-up value, any other field
    its inline value. A reference that leads nowhere is an error, never a fallback:
    NOT_FOUND (no such row), KEY_NOT_FOUND, BAD_VALUE (not of the field's type), or
    REF_MISSING for a field that has to be a reference. The first failing field in declared
    order is reported, and then all values are null.

    ``lookup`` has one row per (namespace, name) with a ``map<string, string|binary>``;
    ``keys`` identify an object. All references go through one join, not one per field, as one row
    per object and different name; the first of an object's rows carries its inline values. An
    object without a set reference has one row, which needs no partner and is spread over the
    tasks. The rows meet by ``keys`` and are sorted only there.
    """
    keys, keep = as_list(keys), list(keep)
    on_ns = [namespace] if namespace else []
    referenced = [(i, f) for i, f in enumerate(fields) if f.ref_name is not None]

    inline = F.struct(
        *[
            (F.lit(None) if f.inline is None else as_col(f.inline)).cast(f.type).alias(f"v{i}")
            for i, f in enumerate(fields)
        ],
        *[F.col(k) for k in keep if k not in keys],
    )
    none = F.lit(None).cast("string")
    carried = list(dict.fromkeys([*keys, *on_ns]))
    asked = objects.select(
        *carried,
        inline.alias("_base"),
        *[blank_to_null(as_col(f.ref_name).cast("string")).alias(f"_n{i}") for i, f in referenced],
        *[blank_to_null(as_col(f.ref_key).cast("string")).alias(f"_k{i}") for i, f in referenced],
    )
    names = [F.when(F.col(f"_k{i}").isNotNull(), F.col(f"_n{i}")) for i, _ in referenced]
    names = F.array_distinct(F.array_compact(F.array(*names))) if names else F.array().cast("array<string>")
    rows = (
        asked.select("*", F.posexplode_outer(names).alias("_no", "_name"))
        .select(
            *carried,
            "_name",
            F.when(F.coalesce(F.col("_no"), F.lit(0)) == 0, F.col("_base")).alias("_base"),
            *[F.when(F.col(f"_n{i}") == F.col("_name"), F.col(f"_k{i}")).alias(f"_k{i}") for i, _ in referenced],
        )
        .withColumn("_spread", null_spread([F.col("_name")], [F.col(k) for k in keys]))
    )

    values = lookup.select(
        *on_ns,
        F.col(lookup_name).cast("string").alias("_name"),
        F.lit(0).alias("_spread"),
        F.col(lookup_data).alias("_data"),
        F.lit(True).alias("_found"),
    )
    joined = rows.join(values, [*on_ns, "_name", "_spread"], "left")

    def got_of(key: Column) -> Column:
        has_key = F.coalesce(F.map_contains_key(F.col("_data"), key), F.lit(False))
        got = F.struct(
            F.try_element_at(F.col("_data"), key).cast("string").alias("value"),
            F.when(F.col("_found").isNull(), F.lit(NOT_FOUND)).when(~has_key, F.lit(KEY_NOT_FOUND)).alias("error"),
        )
        return F.when(key.isNotNull(), got)

    looked = joined.select(*keys, "_base", *[got_of(F.col(f"_k{i}")).alias(f"_r{i}") for i, _ in referenced])
    aggs = [F.any_value("_base", True).alias("_base"), *[F.max(f"_r{i}").alias(f"_r{i}") for i, _ in referenced]]
    # Few objects have several rows: aggregating before they move would sort them all once more.
    grouped = looked.repartition(*keys).groupBy(*keys).agg(*aggs)

    with_ref = {i for i, _ in referenced}
    out_values, errors = [], []
    for i, f in enumerate(fields):
        plain = F.col(f"_base.v{i}")
        if i not in with_ref:
            out_values.append(plain)
            errors.append(F.lit(REF_MISSING) if f.required_ref else none)
            continue
        got = F.col(f"_r{i}")
        typed = got["value"].try_cast(f.type)
        out_values.append(F.when(got.isNotNull(), typed).otherwise(plain))
        errors.append(
            F.when(got.isNull(), F.lit(REF_MISSING) if f.required_ref else none)
            .when(got["error"].isNotNull(), got["error"])
            .when(got["value"].isNotNull() & typed.isNull(), F.lit(BAD_VALUE))
        )
    # In steps, so that the code for a row stays small enough to be compiled.
    kept = [k for k in keep if k not in keys]
    worked = grouped.select(
        *keys,
        *[F.col(f"_base.{k}").alias(f"_keep_{k}") for k in kept],
        *[v.alias(f"_v{i}") for i, v in enumerate(out_values)],
        *[e.alias(f"_e{i}") for i, e in enumerate(errors)],
    )
    known = range(len(fields))
    failed = F.coalesce(*[F.when(F.col(f"_e{i}").isNotNull(), F.lit(i)) for i in known], F.lit(None).cast("int"))
    marked = worked.withColumn("_failed", failed)
    names = F.array(*[F.lit(f.name) for f in fields])
    return marked.select(
        *keys,
        *[F.col(f"_keep_{k}").alias(k) for k in kept],
        *[F.when(F.col("_failed").isNull(), F.col(f"_v{i}")).alias(f.name) for i, f in enumerate(fields)],
        F.get(names, F.col("_failed")).alias("error_field"),
        F.coalesce(*[F.col(f"_e{i}") for i in known], none).alias("error"),
    )
