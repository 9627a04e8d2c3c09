"""Paths, templates, casts, predicates and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import casts
from ..operators import datasets, frames
from ..plans.expressions import Scope
from ..plans.predicates import OPERATORS
from ..plans.templates import compile_template, filter_rows, project
from ._registry import query

#: Events of a user as a list, in order.
LISTS = "SELECT user_id, list({'id': event_id, 'kind': event_type, 'value': value} ORDER BY event_id) AS items FROM events GROUP BY user_id"


def lists(t):
    rows = F.array_sort(F.collect_list(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), "value")))
    return t("events").groupBy("user_id").agg(rows.alias("items"))


def labelled(t):
    return t("documents").select("doc_id", "lang").join(t("labels").dropDuplicates(["doc_id"]), "doc_id", "left")


LABELLED = "(SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN (SELECT DISTINCT ON (doc_id) * FROM labels) l ON d.doc_id = l.doc_id)"


@query(f"SELECT doc_id, coalesce(quality, -1)::BIGINT AS quality, coalesce(lang, 'none') AS lang FROM {LABELLED}")
def expr_path_default(t):
    return project(labelled(t), {"doc_id": "${item.doc_id}", "quality": "${item.quality as integer | -1}", "lang": "${item.lang | none}"})


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, NULL::VARCHAR AS missing FROM events")
def expr_json_path(t):
    df = t("events").withColumn("props", F.parse_json("props"))
    return project(df, {"event_id": "${event_id}", "k": "${props.k as integer}", "missing": "${props.none.there as string}"})


@query(f"SELECT user_id, items[1].id AS first_id, items[len(items)].id AS last_id, items[3].kind AS third, items[100000].id AS beyond FROM ({LISTS})")
def expr_array_index(t):
    return project(lists(t), {"user_id": "${user_id}", "first_id": "${items[0].id}", "last_id": "${items[-1].id}", "third": "${items[2].kind}", "beyond": "${items[99999].id}"})


@query(f"SELECT user_id, array_to_string(list_transform(items[2:4], lambda x: x.id::VARCHAR), ',') AS middle, array_to_string(list_transform(items[greatest(len(items) - 1, 1):len(items)], lambda x: x.id::VARCHAR), ',') AS tail FROM ({LISTS})")
def expr_array_slice(t):
    df = project(lists(t), {"user_id": "${user_id}", "middle": "${items[1:4]}", "tail": "${items[-2:]}"})
    return df.select("user_id", *[F.array_join(F.transform(c, lambda x: x["id"].cast("string")), ",").alias(c) for c in ("middle", "tail")])


@query(f"SELECT user_id, array_to_string(list_transform(items, lambda x: x.kind), '|') AS kinds FROM ({LISTS})")
def expr_array_wildcard(t):
    return project(lists(t), {"user_id": "${user_id}", "kinds": "${items[*].kind}"}).withColumn("kinds", F.array_join("kinds", "|"))


@query(f"SELECT doc_id, 'doc ' || doc_id || ' [' || coalesce(lang, '') || '] q=' || coalesce(quality::VARCHAR, '') AS label FROM {LABELLED}")
def expr_interpolate(t):
    return project(labelled(t), {"doc_id": "${doc_id}", "label": "doc ${doc_id} [${lang}] q=${quality}"})


@query("SELECT o_orderkey AS id, o_orderstatus AS status, round(o_totalprice, 2) AS total, 'order' AS kind FROM orders")
def proj_template(t):
    df = project(t("orders"), {"id": "${item.o_orderkey}", "status": "${item.o_orderstatus}", "total": "${item.o_totalprice as number}", "kind": "order"})
    return df.withColumn("total", F.round("total", 2))


@query("SELECT n_nationkey, upper(n_name) IS NOT NULL AS known, 'n' || n_nationkey AS n_name, n_regionkey FROM nation")
def proj_spread(t):
    return project(t("nation").withColumn("known", F.col("n_name").isNotNull()), {"...": "${item}", "n_name": "n${n_nationkey}"})


@query(f"SELECT user_id, array_to_string(list_concat(['head'], list_transform(items, lambda x: x.kind), ['tail']), ',') AS kinds FROM ({LISTS})")
def expr_list_spread(t):
    df = project(lists(t), {"user_id": "${user_id}", "kinds": ["head", "...${items[*].kind}", "tail"]})
    return df.withColumn("kinds", F.array_join("kinds", ","))


@query("SELECT event_id, event_type AS kind, value * 1.0 AS amount FROM events")
def map_project(t):
    df = lists(t).select("user_id", compile_template({"*": "${items}", "event_id": "${item.id}", "kind": "${item.kind}", "amount": "${item.value as number}"}, Scope.of(lists(t))).column.alias("x"))
    return df.select(F.explode("x").alias("x")).select("x.*")


@query(f"SELECT user_id, i AS pos, x.id AS event_id FROM (SELECT user_id, unnest(items) AS x, unnest(range(len(items))) AS i FROM ({LISTS})) WHERE x.value > 50 AND i >= 1")
def map_where_index(t):
    template = {"*": {"input": "${items}", "where": {"all": [{"input": "${item.value}", "operator": "gt", "value": 50}, {"input": "${index}", "operator": "gte", "value": 1}]}}, "pos": "${index}", "event_id": "${item.id}"}
    df = lists(t)
    return df.select("user_id", F.explode(compile_template(template, Scope.of(df)).column).alias("x")).select("user_id", "x.pos", "x.event_id")


@query(f"SELECT user_id, array_to_string(list_transform(items, lambda x: x.id::VARCHAR), ',') AS ids, array_to_string(list_transform(items, lambda x: x.kind), ',') AS kinds FROM ({LISTS})")
def split_columns(t):
    df = lists(t)
    out = df.select("user_id", compile_template({"|": "${items}", "ids": "${item.id as string}", "kinds": "${item.kind}"}, Scope.of(df)).column.alias("x"))
    return out.select("user_id", F.array_join("x.ids", ",").alias("ids"), F.array_join("x.kinds", ",").alias("kinds"))


@query(f"SELECT user_id, array_to_string(list_concat(list_transform(items[1:2], lambda x: x.kind), list_transform(items[len(items):len(items)], lambda x: x.kind)), ',') AS kinds FROM ({LISTS})")
def concat_lists(t):
    df = project(lists(t), {"user_id": "${user_id}", "kinds": {"+": ["${items[0:2][*].kind}", "${items[-1:][*].kind}"]}})
    return df.withColumn("kinds", F.array_join("kinds", ","))


@query(f"SELECT doc_id, lang || '/' || coalesce(quality::VARCHAR, '') AS both FROM {LABELLED}")
def concat_strings(t):
    return project(labelled(t), {"doc_id": "${doc_id}", "both": {"+": ["${lang}", "/", "${quality as string}"]}})


@query("SELECT o_orderkey, o_orderpriority AS a, 'set' AS b, o_orderstatus AS c FROM orders")
def merge_dicts(t):
    df = t("orders").select("o_orderkey", F.struct(F.col("o_orderstatus").alias("a"), F.lit("set").alias("b")).alias("x"), F.struct(F.col("o_orderpriority").alias("a"), F.col("o_orderstatus").alias("c")).alias("y"))
    out = project(df, {"o_orderkey": "${o_orderkey}", "m": {"+": ["${x}", "${y}"]}})
    return out.select("o_orderkey", "m.a", "m.b", "m.c")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'low' END AS band FROM orders")
def case_when_chain(t):
    entries = [{"input": "${o_totalprice}", "operator": "gt", "value": 300000, "if_true": "high"}, {"input": "${o_totalprice}", "operator": "gt", "value": 100000, "if_true": "middle", "if_false": "low"}, {"input": 1, "operator": "eq", "value": 1, "if_true": "never"}]
    return project(t("orders"), {"o_orderkey": "${o_orderkey}", "band": {"?": entries}})


@query(f"SELECT user_id, array_to_string(list_transform(items, lambda x: x.id || ':' || x.kind), ',') AS picked FROM ({LISTS})")
def project_object_array(t):
    df = project(lists(t), {"user_id": "${user_id}", "picked": "${items as object[]/id,kind}"})
    return df.withColumn("picked", F.array_join(F.transform("picked", lambda x: F.concat_ws(":", x["id"].cast("string"), x["kind"])), ","))


@query("SELECT event_id, trunc(value)::BIGINT AS as_integer, user_id::DOUBLE AS as_number, user_id::VARCHAR AS as_string, lower(user_id::VARCHAR) IN ('true', '1') AS as_boolean, lower(event_type) IN ('true', '1') AS text_boolean FROM events")
def cast_matrix(t):
    return project(t("events"), {"event_id": "${event_id}", "as_integer": "${value as integer}", "as_number": "${user_id as number}", "as_string": "${user_id as string}", "as_boolean": "${user_id as boolean}", "text_boolean": "${event_type as boolean}"})


@query("SELECT lang, doc_id, source FROM documents")
def datasets_select_columns(t):
    return datasets.select(t("documents"), ["lang", "doc_id", "source"])


@query("SELECT n_nationkey, 'Nation ' || n_name || ' in region ' || n_regionkey || ' {none}' AS prompt FROM nation")
def datasets_map_template(t):
    return datasets.map_template(t("nation"), "Nation {n_name} in region {n_regionkey} {none}", "prompt", ["n_name", "n_regionkey"])


def _filter(t, table, where, columns):
    return filter_rows(t(table), where).select(*columns)


@query("SELECT event_id FROM events WHERE value >= 75")
def filter_numeric(t):
    return _filter(t, "events", {"input": "${item.value as number}", "operator": "gte", "value": 75}, ["event_id"])


@query("SELECT event_id FROM events WHERE event_type = 'purchase'")
def filter_string(t):
    return _filter(t, "events", {"input": "${item.event_type}", "operator": "eq", "value": "purchase"}, ["event_id"])


@query("SELECT event_id FROM events WHERE (value > 90 OR event_type = 'error') AND NOT (user_id = 7) AND (true)")
def filter_all_any_not(t):
    where = {"all": [{"any": [{"input": "${value}", "operator": "gt", "value": 90}, {"input": "${event_type}", "operator": "eq", "value": "error"}]}, {"not": {"input": "${user_id}", "operator": "eq", "value": 7}}, {"all": []}]}
    return _filter(t, "events", where, ["event_id"])


@query(f"SELECT doc_id, (quality IS NOT DISTINCT FROM NULL) AS none, (quality IS NOT DISTINCT FROM 1) AS one, (quality IS DISTINCT FROM 1) AS not_one, false AS text_one FROM {LABELLED}")
def pred_eq_null(t):
    df = labelled(t)
    scope = Scope.of(df)
    c = lambda x: compile_template(x, scope)
    q = c("${quality}")
    return df.where("true").select("doc_id", q.column.eqNullSafe(F.lit(None)).alias("none"), OPERATORS["eq"](q, c(1)).alias("one"), OPERATORS["neq"](q, c(1)).alias("not_one"), (OPERATORS["eq"](q, c("1")) & q.column.isNotNull()).alias("text_one"))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 50000 AND o_totalprice <= 150000 AND o_custkey >= 10 AND o_custkey < 1000")
def pred_range(t):
    where = {"all": [{"input": "${o_totalprice}", "operator": "gt", "value": 50000}, {"input": "${o_totalprice}", "operator": "lte", "value": 150000}, {"input": "${o_custkey}", "operator": "gte", "value": 10}, {"input": "${o_custkey}", "operator": "lt", "value": 1000}]}
    return _filter(t, "orders", where, ["o_orderkey"])


@query("SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND user_id NOT IN (1, 2, 3)")
def pred_in(t):
    return _filter(t, "events", {"all": [{"input": "${event_type}", "operator": "in", "value": ["click", "view"]}, {"input": "${user_id}", "operator": "not-in", "value": [1, 2, 3]}]}, ["event_id"])


@query("SELECT p_partkey FROM part WHERE contains(p_type, 'EEL') OR contains('Brand#11,Brand#12', p_brand)")
def pred_in_substring(t):
    return _filter(t, "part", {"any": [{"input": "EEL", "operator": "in", "value": "${p_type}"}, {"input": "${p_brand}", "operator": "in", "value": "Brand#11,Brand#12"}]}, ["p_partkey"])


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '^(?:The|And [a-z]+)')")
def pred_match(t):
    return _filter(t, "documents", {"input": "${text}", "operator": "match", "value": "The|And [a-z]+"}, ["doc_id"])


@query("SELECT doc_id FROM documents WHERE starts_with(source, 'src1') AND ends_with(text, '.')")
def pred_starts_ends(t):
    return _filter(t, "documents", {"all": [{"input": "${source}", "operator": "starts-with", "value": "src1"}, {"input": "${text}", "operator": "ends-with", "value": "."}]}, ["doc_id"])


@query("SELECT doc_id, lang FROM documents WHERE lang = 'fr' AND n_chars > 1000")
def datasets_filter(t):
    return datasets.filter_where(t("documents"), {"all": [{"input": "${lang}", "operator": "eq", "value": "fr"}, {"input": "${n_chars}", "operator": "gt", "value": 1000}]}).select("doc_id", "lang")


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'alert' WHEN value > 80 THEN 'big' ELSE 'rest' END AS route FROM events")
def route_if_rows(t):
    return frames.route(t("events"), [(F.col("event_type") == "error", "alert"), (F.col("value") > 80, "big")], "rest").select("event_id", "route")


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'a' WHEN 'view' THEN 'b' END AS route FROM events")
def route_switch_rows(t):
    return frames.route(t("events"), [(F.col("event_type") == "click", "a"), (F.col("event_type") == "view", "b")]).select("event_id", "route")


@query()
def route_random(t):
    return frames.route_random(t("events"), {"a": 3, "b": 1, "c": 0, "d": None}, "event_id", seed=7).groupBy("route").agg(F.count("*").alias("n"))


@query("SELECT event_id, base64(encode(event_type)) AS encoded, event_type AS decoded FROM events")
def base64_roundtrip(t):
    df = project(t("events"), {"event_id": "${event_id}", "encoded": "${event_type as base64}"})
    return df.withColumn("decoded", F.decode(F.unbase64("encoded"), "UTF-8"))


#: Literals in every notation, one per event.
DURATIONS = ("90", "1.5h", "250ms", "2d", "3m", "1:02:03", "02:30", "45s", "bad")
SIZES = ("10", "10KB", "1.5M", "3g", "7B", "2GB", "bad")
DECIMALS = ("3k", "1.5M", "2G", "7")


def _literals(t, values):
    pick = F.try_element_at(F.array(*map(F.lit, values)), (F.col("event_id") % len(values) + 1).cast("int"))
    return t("events").select("event_id", pick.alias("raw"))


def _chosen(values):
    return f"(SELECT event_id, [{', '.join(repr(v) for v in values)}][event_id % {len(values)} + 1] AS raw FROM events)"


@query(f"SELECT event_id, CASE raw WHEN '90' THEN 90.0 WHEN '1.5h' THEN 5400.0 WHEN '250ms' THEN 0.25 WHEN '2d' THEN 172800.0 WHEN '3m' THEN 180.0 WHEN '1:02:03' THEN 3723.0 WHEN '02:30' THEN 150.0 WHEN '45s' THEN 45.0 END::DOUBLE AS seconds FROM {_chosen(DURATIONS)}")
def parse_duration(t):
    return _literals(t, DURATIONS).select("event_id", casts.parse_duration(F.col("raw")).alias("seconds"))


@query(f"SELECT s.event_id, CASE s.raw WHEN '10' THEN 10 WHEN '10KB' THEN 10240 WHEN '1.5M' THEN 1572864 WHEN '3g' THEN 3221225472 WHEN '7B' THEN 7 WHEN '2GB' THEN 2147483648 END::BIGINT AS bytes, CASE d.raw WHEN '3k' THEN 3000 WHEN '1.5M' THEN 1500000 WHEN '2G' THEN 2000000000 END::BIGINT AS number FROM {_chosen(SIZES)} s JOIN {_chosen(DECIMALS)} d ON s.event_id = d.event_id")
def parse_size(t):
    s, d = _literals(t, SIZES), _literals(t, DECIMALS).withColumnRenamed("raw", "dec")
    return s.join(d, "event_id").select("event_id", casts.parse_size(F.col("raw")).alias("bytes"), casts.parse_decimal(F.col("dec")).alias("number"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_type(props) = 'OBJECT' AS is_object FROM events")
def json_decode(t):
    df = t("events").withColumn("decoded", F.try_parse_json("props"))
    return df.select("event_id", F.try_variant_get("decoded", "$.k", "bigint").alias("k"), F.startswith(F.schema_of_variant("decoded"), F.lit("OBJECT")).alias("is_object"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL WHEN event_id % 3 = 1 THEN 'text/plain' ELSE 'application/json' END AS content_type, CASE WHEN event_id % 3 = 2 THEN NULL WHEN event_id % 3 = 1 THEN event_type || ' x' ELSE props END AS content FROM events")
def data_uri_parse(t):
    k = F.col("event_id") % 3
    uri = F.when(k == 0, F.concat(F.lit("data:application/json;base64,"), F.base64(F.encode("props", "UTF-8")))).when(k == 1, F.concat(F.lit("data:,"), F.col("event_type"), F.lit("%20x"))).otherwise(F.col("event_type"))
    out = t("events").select("event_id", casts.data_uri(uri).alias("u"))
    return out.select("event_id", "u.content_type", F.decode("u.content", "UTF-8").alias("content"))
