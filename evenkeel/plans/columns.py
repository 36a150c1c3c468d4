
from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel import functions as K
from evenkeel.operators import (
    ChangeRules,
    Child,
    apply_defaults,
    expand_children,
    filter_changes,
    needs_work,
    split_valid,
    uses,
    validate,
)
from evenkeel.operators import rules as V
from evenkeel.operators.changes import content_rules, owned_generic_rules
from evenkeel.plans.registry import SCHEMAS, query, table
from evenkeel.session import shared_dir
from evenkeel.sources import (
    append_status,
    in_namespace,
    lookup,
    lookup_many,
    read_snapshot,
    with_labels,
)

# -- sources --------------------------------------------------------------------------------


@query(
    "read_snapshot",
    r"""SELECT event_id, ts, user_id, event_type,
               CAST(regexp_extract(props, '"k": (\d+)', 1) AS INTEGER) AS k FROM events""",
)
def _(spark, sf):
    df = read_snapshot(
        spark, f"{sf}/events.parquet", SCHEMAS["events"],
        blank_as_null=["event_type"], payload="props", payload_schema="k int",
    )
    return df.select("event_id", "ts", "user_id", "event_type", "k")


@query("lookup", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_name = 'NATION_7' AND n_nationkey = 7")
def _(spark, sf):
    return lookup(table(spark, sf, "nation"), {"n_name": "NATION_7", "n_nationkey": 7})


@query(
    "lookup_many",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_brand, p_partkey IS NOT NULL AS found
       FROM lineitem LEFT JOIN (SELECT p_partkey, p_brand FROM part WHERE p_size > 25) p
         ON p_partkey = l_partkey""",
)
def _(spark, sf):
    wanted = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    parts = table(spark, sf, "part").filter("p_size > 25")
    return lookup_many(wanted, parts.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")


@query("in_namespace", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(spark, sf):
    return in_namespace(table(spark, sf, "customer"), "BUILDING", "c_mktsegment").select(
        "c_custkey", "c_name", "c_mktsegment"
    )


def _labelled_events(spark, sf):
    k = F.from_json("props", "k int")["k"]
    return table(spark, sf, "events").select(
        "event_id",
        "user_id",
        F.create_map(F.lit("type"), F.col("event_type"), F.lit("k"), k.cast("string")).alias("labels"),
    )


@query(
    "with_labels",
    """SELECT event_id, user_id FROM events
       WHERE event_type = 'error' AND regexp_extract(props, '"k": (\\d+)', 1) = '7'""",
)
def _(spark, sf):
    return with_labels(_labelled_events(spark, sf), {"type": "error", "k": "7"}).drop("labels")


@query("append_status", "SELECT event_id, user_id, event_type FROM events")
def _(spark, sf):
    log = shared_dir(spark, "status")
    df = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    append_status(df.filter("event_type = 'error'"), log)
    append_status(df.filter(~F.col("event_type").eqNullSafe("error")), log)
    return read_snapshot(spark, log, "event_id bigint, user_id bigint, event_type string")


# -- projections ----------------------------------------------------------------------------


@query(
    "apply_defaults",
    """SELECT p_partkey,
              CASE WHEN p_type = 'PROMO' THEN 1 ELSE p_size END AS p_size,
              CASE WHEN p_size > 40 THEN 'Brand#0' ELSE p_brand END AS p_brand,
              CASE WHEN p_type = 'ECONOMY' THEN NULL WHEN p_size > 40 THEN 'Brand#1' ELSE p_brand END AS spec_brand,
              CASE WHEN p_type = 'ECONOMY' THEN NULL WHEN p_type = 'PROMO' THEN 2 ELSE p_size END AS spec_size,
              CASE WHEN p_type = 'ECONOMY' OR p_size > 40 THEN 'none' ELSE p_name END AS limits_name
       FROM part""",
)
def _(spark, sf):
    part = table(spark, sf, "part")
    size = F.when(F.col("p_type") != "PROMO", F.col("p_size"))
    brand = F.when(F.col("p_size") <= 40, F.col("p_brand"))
    declared = part.select(
        "p_partkey",
        size.alias("p_size"),
        brand.alias("p_brand"),
        F.when(F.col("p_type") != "ECONOMY", F.struct(brand.alias("brand"), size.alias("size"))).alias("spec"),
        F.when(
            F.col("p_type") != "ECONOMY", F.struct(F.when(F.col("p_size") <= 40, F.col("p_name")).alias("name"))
        ).alias("limits"),
    )
    filled = apply_defaults(
        declared,
        {"p_size": 1, "p_brand": "Brand#0", "spec.brand": "Brand#1", "spec.size": 2, "limits": {}, "limits.name": "none"},
    )
    return filled.select(
        "p_partkey", "p_size", "p_brand",
        F.col("spec.brand").alias("spec_brand"), F.col("spec.size").alias("spec_size"), F.col("limits.name").alias("limits_name"),
    )


def _part_rules():
    words = F.split(F.concat_ws(" ", "p_name", F.lower("p_type")), " ")
    return [
        V.required(F.when(F.col("p_size") > 5, F.col("p_brand")), name="brand_required"),
        V.minimum("p_size", 10, name="size_minimum"),
        V.one_of("p_type", ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "STANDARD"], name="type_enum"),
        V.length_between("p_name", 1, 11, name="name_length"),
        V.matches("p_brand", r"Brand#[0-9]", name="brand_pattern"),
        V.min_items(words, 3, name="word_count"),
        V.items_match(words, r"[a-ln-z]+", name="word_pattern"),
        V.unique_items(words, name="word_unique"),
    ]


_VIOLATIONS = """concat_ws(',',
    CASE WHEN p_size <= 5 OR p_brand IS NULL THEN 'brand_required' END,
    CASE WHEN p_size < 10 THEN 'size_minimum' END,
    CASE WHEN p_type NOT IN ('ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'STANDARD') THEN 'type_enum' END,
    CASE WHEN length(p_name) NOT BETWEEN 1 AND 11 THEN 'name_length' END,
    CASE WHEN NOT regexp_full_match(p_brand, 'Brand#[0-9]') THEN 'brand_pattern' END,
    CASE WHEN len(string_split(p_name || ' ' || lower(p_type), ' ')) < 3 THEN 'word_count' END,
    CASE WHEN (p_name || lower(p_type)) LIKE '%m%' THEN 'word_pattern' END,
    CASE WHEN len(list_distinct(string_split(p_name || ' ' || lower(p_type), ' ')))
            < len(string_split(p_name || ' ' || lower(p_type), ' ')) THEN 'word_unique' END)"""


@query("validate", f"SELECT p_partkey, {_VIOLATIONS} AS violations FROM part")
def _(spark, sf):
    checked = validate(table(spark, sf, "part"), _part_rules())
    return checked.select("p_partkey", K.join_items("violations").alias("violations"))


@query("split_valid", f"SELECT p_partkey, p_name FROM part WHERE {_VIOLATIONS} = ''")
def _(spark, sf):
    return split_valid(table(spark, sf, "part"), _part_rules())[0].select("p_partkey", "p_name")


@query("split_rejected", f"SELECT p_partkey, {_VIOLATIONS} AS violations FROM part WHERE {_VIOLATIONS} <> ''")
def _(spark, sf):
    rejected = split_valid(table(spark, sf, "part"), _part_rules())[1]
    return rejected.select("p_partkey", K.join_items("violations").alias("violations"))


@query(
    "derive_names",
    """SELECT s_suppkey, s_name || '-config' AS config, s_name || '-http' AS http, s_name || '-poll' AS poll,
              s_name || '-init' AS init, s_name AS main FROM supplier""",
)
def _(spark, sf):
    named = K.derive_names(
        table(spark, sf, "supplier"), "s_name",
        {"config": "-config", "http": "-http", "poll": "-poll", "init": "-init", "main": ""},
    )
    return named.select("s_suppkey", "config", "http", "poll", "init", "main")


@query(
    "name_or_override",
    """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'shared-password'
                              ELSE c_name || '-admin-password' END AS secret FROM customer""",
)
def _(spark, sf):
    given = F.when(F.col("c_mktsegment") == "BUILDING", F.lit("shared-password")).otherwise(F.lit(""))
    return table(spark, sf, "customer").select(
        "c_custkey", K.name_or_override(given, K.derived_name("c_name", "-admin-password")).alias("secret")
    )


@query(
    "expand_children",
    """SELECT c_custkey, kind, c_name || suffix AS child,
              CASE WHEN kind = 'config' THEN c_mktsegment WHEN kind = 'service' THEN substr(suffix, 2) END AS payload
       FROM customer, (VALUES ('admin', '-admin-password'), ('config', '-config'), ('data', ''), ('job', '-init'),
                              ('deployment', ''), ('service', '-http'), ('service', '-poll')) t(kind, suffix)
       WHERE kind <> 'job' OR c_acctbal >= 0""",
)
def _(spark, sf):
    name = F.col("c_name")
    templates = [
        Child("admin", K.derived_name(name, "-admin-password")),
        Child("config", K.derived_name(name, "-config"), F.col("c_mktsegment")),
        Child("data", name),
        Child("job", K.derived_name(name, "-init"), when=F.col("c_acctbal") >= 0),
        Child("deployment", name),
        Child("service", K.derived_name(name, "-http"), F.lit("http")),
        Child("service", K.derived_name(name, "-poll"), F.lit("poll")),
    ]
    return expand_children(table(spark, sf, "customer"), templates, keep="c_custkey")


@query(
    "render_config",
    """SELECT p_partkey, '[options]' || chr(10) || 'name = ' || p_name || chr(10) || 'size = ' || p_size || chr(10)
         || 'large = ' || CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END || chr(10)
         || CASE WHEN p_type = 'PROMO' THEN 'words = ' || replace(p_name, ' ', ',') || chr(10) ELSE '' END AS text
       FROM part""",
)
def _(spark, sf):
    words = F.when(F.col("p_type") == "PROMO", F.split("p_name", " ")).otherwise(F.array())
    text = K.render_config(
        "[options]",
        K.line("name = ", "p_name"),
        K.line("size = ", "p_size"),
        K.line("large = ", F.col("p_size") > 25),
        K.line("words = ", K.join_items(words), when=F.size(words) > 0),
    )
    return table(spark, sf, "part").select("p_partkey", text.alias("text"))


def _turns(spark, sf):
    """Each turn's words and the words of the turn before."""
    turns = table(spark, sf, "conversations")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.split("text", " ").alias("done"))
    return turns.select("conv_id", "turn", F.split("text", " ").alias("wanted")).join(before, ["conv_id", "turn"], "left")


_FRESH = """array_to_string(list_filter(string_split(t.text, ' '),
    lambda w: NOT coalesce(list_contains(string_split(b.text, ' '), w), false)), ' ')"""
_TURNS = "conversations t LEFT JOIN conversations b ON b.conv_id = t.conv_id AND b.turn = t.turn - 1"


@query("array_minus", f"SELECT t.conv_id, t.turn, coalesce({_FRESH}, '') AS fresh FROM {_TURNS}")
def _(spark, sf):
    return _turns(spark, sf).select(
        "conv_id", "turn", K.join_items(K.array_minus("wanted", "done"), " ").alias("fresh")
    )


@query(
    "needs_work",
    f"""SELECT t.conv_id, t.turn FROM {_TURNS}
        WHERE len(list_filter(string_split(t.text, ' '),
                  lambda w: NOT coalesce(list_contains(string_split(b.text, ' '), w), false))) > 0""",
)
def _(spark, sf):
    return needs_work(_turns(spark, sf), "wanted", "done").select("conv_id", "turn")


@query(
    "array_dedup",
    """SELECT doc_id, string_agg(w, ' ' ORDER BY nth) AS words
       FROM (SELECT doc_id, w, min(i) AS nth
             FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w,
                          generate_subscripts(string_split(text, ' '), 1) AS i FROM documents)
             GROUP BY doc_id, w)
       GROUP BY doc_id""",
)
def _(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", K.join_items(K.array_dedup(F.split("text", " ")), " ").alias("words")
    )


@query("join_items", "SELECT page_id, replace(url, '/', ',') AS parts FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", K.join_items(F.split("url", "/")).alias("parts"))


def _event_pairs(spark, sf):
    """Each event with the content of the event before it."""
    events = table(spark, sf, "events").withColumn("k", F.from_json("props", "k int")["k"].cast("string"))
    after = events.select(
        "event_id", "event_type", F.create_map(F.lit("type"), "event_type", F.lit("band"), F.substring("k", 1, 1)).alias("after")
    )
    before = events.select(
        (F.col("event_id") + 1).alias("event_id"),
        F.col("event_type").alias("type_before"),
        F.create_map(F.lit("band"), F.substring("k", 1, 1), F.lit("type"), "event_type").alias("before"),
    )
    return after.join(before, "event_id", "left")


_PAIRS = """events a LEFT JOIN events b ON b.event_id = a.event_id - 1"""
_SAME = r"""(b.event_id IS NOT NULL AND a.event_type = b.event_type
    AND substr(regexp_extract(a.props, '"k": (\d+)', 1), 1, 1) = substr(regexp_extract(b.props, '"k": (\d+)', 1), 1, 1))"""


@query("maps_equal", f"SELECT a.event_id, {_SAME} AS same FROM {_PAIRS}")
def _(spark, sf):
    return _event_pairs(spark, sf).select("event_id", K.maps_equal("before", "after").alias("same"))


@query("content_changed", f"SELECT a.event_id, a.event_type FROM {_PAIRS} WHERE NOT {_SAME}")
def _(spark, sf):
    pairs = _event_pairs(spark, sf)
    changed = K.content_changed([("type_before", "event_type")], [("before", "after")])
    return pairs.filter(changed).select("event_id", "event_type")


def _owned_orders(spark, sf):
    """Orders with two owners: the customer and, as controller where finished, the priority."""
    owner = "struct<kind:string,api_version:string,name:string,controller:boolean>"
    return table(spark, sf, "orders").withColumn(
        "owners",
        F.array(
            F.struct(F.lit("Customer"), F.lit("v1"), F.col("o_custkey").cast("string"), F.lit(False)).cast(owner),
            F.struct(
                F.when(F.col("o_orderpriority") == "5-LOW", F.lit("Other")).otherwise(F.lit("Queue")),
                F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit("v2")).otherwise(F.lit("v1")),
                F.col("o_orderpriority"),
                F.col("o_orderstatus") == "F",
            ).cast(owner),
        ),
    )


_OWNED = "o_orderstatus = 'F' AND o_orderpriority NOT IN ('5-LOW', '4-NOT SPECIFIED')"


@query(
    "controller_owner",
    f"SELECT o_orderkey, CASE WHEN {_OWNED} THEN o_orderpriority END AS owner FROM orders",
)
def _(spark, sf):
    return _owned_orders(spark, sf).select("o_orderkey", K.controller_owner("owners", "Queue", "v1").alias("owner"))


@query("owned_or", f"SELECT o_orderkey FROM orders WHERE ({_OWNED}) OR o_totalprice > 300000")
def _(spark, sf):
    keep = K.owned_or("owners", "Queue", "v1", F.col("o_totalprice") > 300000)
    return _owned_orders(spark, sf).filter(keep).select("o_orderkey")


@query(
    "typed_value",
    """SELECT p_partkey, CASE WHEN p_type <> 'PROMO' THEN CAST(substr(p_brand, 7) AS INTEGER) END AS number,
              CASE WHEN p_type = 'PROMO' THEN 'BAD_VALUE' END AS number_error,
              p_size > 25 AS flag FROM part""",
)
def _(spark, sf):
    text = F.when(F.col("p_type") == "PROMO", F.col("p_name")).otherwise(F.substr("p_brand", F.lit(7)))
    flag = F.when(F.col("p_size") > 25, F.lit("true")).otherwise(F.lit("false"))
    return table(spark, sf, "part").select(
        "p_partkey",
        K.typed_value(text, "int").alias("number"),
        K.typed_error(text, "int").alias("number_error"),
        K.typed_value(flag, "boolean").alias("flag"),
    )


@query(
    "collect_errors",
    """SELECT c_custkey, concat_ws(';', CASE WHEN c_acctbal < 0 THEN 'debt' END,
                                      CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'closed' END,
                                      CASE WHEN c_acctbal > 9000 THEN 'audit' END) AS errors FROM customer""",
)
def _(spark, sf):
    errors = K.collect_errors(
        F.when(F.col("c_acctbal") < 0, F.lit("debt")),
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.lit("closed")),
        F.when(F.col("c_acctbal") > 9000, F.lit("audit")),
    )
    return table(spark, sf, "customer").select("c_custkey", K.join_items(errors, ";").alias("errors"))


@query(
    "append_list",
    """SELECT p_partkey, replace(p_name, ' ', ',') || CASE WHEN p_size > 25 THEN ',' || p_type || ',' || p_brand ELSE '' END AS items
       FROM part""",
)
def _(spark, sf):
    more = F.when(F.col("p_size") > 25, F.array("p_type", "p_brand"))
    return table(spark, sf, "part").select(
        "p_partkey", K.join_items(K.append_list(F.split("p_name", " "), more)).alias("items")
    )


@query("append_args", "SELECT p_partkey, p_name || ' -c /opt/app.conf --init ' || p_type AS command FROM part")
def _(spark, sf):
    command = K.append_args(F.split("p_name", " "), "-c", "/opt/app.conf", "--init", F.col("p_type"))
    return table(spark, sf, "part").select("p_partkey", K.join_items(command, " ").alias("command"))


# -- filters --------------------------------------------------------------------------------


def change_feed(events):
    """Events as change records: kinds by value, operations by event type."""
    value, kind = F.col("value"), F.col("event_type")
    owner = "struct<kind:string,api_version:string,name:string,controller:boolean>"
    k = F.from_json("props", "k int")["k"]
    return events.select(
        "event_id",
        "user_id",
        F.when(value < 20, F.lit("content")).when(value < 50, F.lit("owned")).when(value < 100, F.lit("plain")).otherwise(F.lit("other")).alias("kind"),
        F.when(kind == "signup", F.lit("create")).when(kind.isin("click", "view"), F.lit("update"))
        .when(kind == "error", F.lit("delete")).otherwise(F.lit("generic")).alias("op"),
        F.create_map(F.lit("k"), F.lit("1")).alias("before"),
        F.create_map(F.lit("k"), F.when(k < 50, F.lit("1")).otherwise(F.lit("2"))).alias("after"),
        F.array(F.struct(F.lit("Parent"), F.lit("v1"), F.col("user_id").cast("string"), k >= 50).cast(owner)).alias("owners"),
    )


def change_rules():
    return {
        "content": content_rules("before", "after", "owners", "Parent", "v1"),
        "owned": owned_generic_rules("owners", "Parent", "v1"),
        "plain": ChangeRules(),
    }


FILTERED_SQL = r"""SELECT event_id, user_id, kind, op FROM (
    SELECT event_id, user_id, CAST(regexp_extract(props, '"k": (\d+)', 1) AS INTEGER) AS k,
           CASE WHEN value < 20 THEN 'content' WHEN value < 50 THEN 'owned' WHEN value < 100 THEN 'plain' ELSE 'other' END AS kind,
           CASE WHEN event_type = 'signup' THEN 'create' WHEN event_type IN ('click', 'view') THEN 'update'
                WHEN event_type = 'error' THEN 'delete' ELSE 'generic' END AS op
    FROM events)
  WHERE kind <> 'other' AND NOT (kind = 'content' AND op = 'update' AND k < 50)
    AND NOT (kind IN ('content', 'owned') AND op = 'generic' AND k < 50)"""


@query("filter_changes", FILTERED_SQL)
def _(spark, sf):
    feed = change_feed(table(spark, sf, "events"))
    return filter_changes(feed, change_rules()).select("event_id", "user_id", "kind", "op")


@query(
    "uses",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE 7 IN (l_partkey, l_suppkey)""",
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem").filter(uses(7, "l_partkey", "l_suppkey"))
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
