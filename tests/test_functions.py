"""Column functions on literal cases."""

import pytest
from pyspark.sql import functions as F

from evenkeel import functions as K


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def arr(items):
    if items is None:
        return F.lit(None).cast("array<string>")
    return F.array(*[F.lit(i) for i in items]).cast("array<string>")


@pytest.mark.parametrize(
    "a, b, expected",
    [
        (["base", "web", "sale"], [], ["base", "web", "sale"]),
        (["base", "web"], ["base", "web"], []),
        (["base", "web", "sale"], ["base", "web"], ["sale"]),
        ([], ["base"], []),
        (["base", "web"], ["base", "crm"], ["web"]),
        (["base", "base", "web"], ["base"], ["web"]),
        (["base", "web", "web"], ["base"], ["web", "web"]),
        (["base", "web"], None, ["base", "web"]),
        (None, ["base"], []),
        (["base", "web"], ["base", None], ["web"]),
        (["base", None], ["base"], [None]),
        (["base", None, "base"], ["base"], [None]),
        (["base", None, "base"], [None], ["base", "base"]),
        (["base", None], [None], ["base"]),
    ],
)
def test_array_minus(spark, a, b, expected):
    assert one(spark, K.array_minus(arr(a), arr(b))) == expected


def test_array_minus_of_itself_is_empty(spark):
    assert one(spark, K.array_minus(arr(["a", "a", "b"]), arr(["a", "a", "b"]))) == []


@pytest.mark.parametrize(
    "items, expected",
    [
        (["base", "web", "sale"], ["base", "web", "sale"]),
        (["base", "web", "base", "sale", "web"], ["base", "web", "sale"]),
        (["base", "base", "base"], ["base"]),
        ([], []),
    ],
)
def test_array_dedup(spark, items, expected):
    assert one(spark, K.array_dedup(arr(items))) == expected


def test_join_items_has_no_trailing_comma(spark):
    assert one(spark, K.join_items(arr(["a", "b"]))) == "a,b"
    assert one(spark, K.join_items(arr([]))) == ""


def test_append_list_keeps_duplicates(spark):
    assert one(spark, K.append_list(arr(["base"]), arr(["web", "base"]))) == ["base", "web", "base"]
    assert one(spark, K.append_list(arr(None), arr(["web"]))) == ["web"]
    assert one(spark, K.append_list(arr(["web"]), arr(None))) == ["web"]


@pytest.mark.parametrize("command", [["app"], ["/entrypoint.sh"], ["/usr/bin/env", "app"]])
def test_append_args(spark, command):
    assert one(spark, K.append_args(arr(command), "-c", "/opt/app.conf")) == [*command, "-c", "/opt/app.conf"]


def test_maps_equal(spark):
    df = spark.sql(
        """
        SELECT * FROM VALUES
          (1, map('a', X'01', 'b', X'02'), map('b', X'02', 'a', X'01')),
          (2, map('a', X'01'), map('a', X'03')),
          (3, map('a', X'01'), map('b', X'01')),
          (4, map('a', X'01'), map('a', X'01', 'b', X'01')),
          (5, CAST(NULL AS map<string, binary>), map()),
          (6, CAST(NULL AS map<string, binary>), map('a', X'01'))
        AS t(i, a, b)"""
    )
    got = {r.i: r.e for r in df.select("i", K.maps_equal("a", "b").alias("e")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: True, 6: False}
    changed = K.content_changed([("i", "i")], [("a", "b")])
    assert {r.i: r.e for r in df.select("i", changed.alias("e")).collect()} == {k: not v for k, v in got.items()}


def test_controller_owner(spark):
    df = spark.createDataFrame(
        [
            (1, [("Parent", "v1", "p", True)]),
            (2, [("Parent", "v1", "p", False)]),
            (3, [("Other", "v1", "p", True)]),
            (4, [("Parent", "v2", "p", True)]),
            (5, []),
            (6, None),
            (7, [("Other", "v1", "o", False), ("Parent", "v1", "q", True)]),
        ],
        "i int, owners array<struct<kind string, api_version string, name string, controller boolean>>",
    )
    owner = K.controller_owner("owners", "Parent", "v1")
    got = {r.i: r.o for r in df.select("i", owner.alias("o")).collect()}
    assert got == {1: "p", 2: None, 3: None, 4: None, 5: None, 6: None, 7: "q"}
    either = K.owned_or("owners", "Parent", "v1", F.col("i") == 5)
    assert [r.i for r in df.filter(either).orderBy("i").collect()] == [1, 5, 7]


def test_typed_value(spark):
    df = spark.createDataFrame([("5432",), ("x",), (None,), ("99999999999",)], "s string")
    got = df.select(K.typed_value("s", "int"), K.typed_error("s", "int")).collect()
    assert [tuple(r) for r in got] == [(5432, None), (None, "BAD_VALUE"), (None, None), (None, "BAD_VALUE")]
    flags = spark.createDataFrame([("true",), ("false",), ("maybe",)], "s string")
    assert [r[0] for r in flags.select(K.typed_value("s", "boolean")).collect()] == [True, False, None]


def test_collect_errors(spark):
    none = F.lit(None).cast("string")
    assert one(spark, K.collect_errors(none, F.lit("a"), none, F.lit("b"))) == ["a", "b"]
    assert one(spark, K.collect_errors(none, none)) == []


def test_names(spark):
    df = spark.createDataFrame([("x", "mine"), ("x", ""), ("x", None)], "name string, given string")
    named = K.derive_names(df, "name", {"config": "-config", "http": "-http", "own": ""}).withColumn(
        "admin", K.name_or_override("given", K.derived_name("name", "-admin-password"))
    )
    assert [tuple(r)[2:] for r in named.collect()] == [
        ("x-config", "x-http", "x", "mine"),
        ("x-config", "x-http", "x", "x-admin-password"),
        ("x-config", "x-http", "x", "x-admin-password"),
    ]


def test_render_config(spark):
    df = spark.createDataFrame(
        [(1, True, ["/mnt/a", "/mnt/b"]), (4, False, []), (None, None, None)],
        "n int, flag boolean, paths array<string>",
    )
    text = K.render_config(
        "[options]",
        K.line("threads = ", "n"),
        K.line("flag = ", "flag"),
        K.line("paths = ", K.join_items("paths"), when=F.size("paths") > 0),
    )
    assert [r[0] for r in df.select(text).collect()] == [
        "[options]\nthreads = 1\nflag = true\npaths = /mnt/a,/mnt/b\n",
        "[options]\nthreads = 4\nflag = false\n",
        "[options]\nthreads = \nflag = \n",
    ]
