"""Expressions, predicates, templates and pipelines on small rows."""

import pytest
from pyspark.sql import functions as F

from weftline.functions import casts
from weftline.plans import expressions as E
from weftline.plans import pipeline as P
from weftline.plans.predicates import field_conditions, predicate
from weftline.plans.templates import compile_template, filter_rows, project


@pytest.fixture(scope="module")
def row(spark):
    return spark.createDataFrame(
        [(7, 2.5, "text", None, [1, 2, 3, 4], {"a": {"b": "deep"}}, [{"k": "x", "v": 1}, {"k": "y", "v": 2}], True)],
        "n long, f double, s string, none string, list array<long>, obj struct<a:struct<b:string>>, items array<struct<k:string,v:long>>, flag boolean",
    )


def value(df, template, **params):
    scope = E.Scope.of(df, params)
    out = df.select(compile_template(template, scope).column.alias("x")).first()["x"]
    return out.asDict(True) if hasattr(out, "asDict") else [x.asDict(True) if hasattr(x, "asDict") else x for x in out] if isinstance(out, list) else out


@pytest.mark.parametrize(
    "template, want",
    [
        ("${n}", 7), ("${item.n}", 7), ("n=${n} ${none}!", "n=7 !"), ("${none | 5}", "5"), ("${missing.a[0].b | x}", "x"), ("${n | 9}", 7), ("${list[0]}", 1), ("${list[-1]}", 4), ("${list[9]}", None),
        ("${list[-9]}", None), ("${list[1:3]}", [2, 3]), ("${list[-2:]}", [3, 4]), ("${list[:-1]}", [1, 2, 3]), ("${list[3:1]}", []), ("${list[2:99]}", [3, 4]), ("${obj.a.b}", "deep"), ("${obj.x.b}", None),
        ("${items[*].k}", ["x", "y"]), ("${items[1].v}", 2), ("${f as integer}", 2), ("${n as number}", 7.0), ("${s as boolean}", False), ("${flag as boolean}", True), ("${none as boolean}", None), ("${n as string}", "7"),
        ("${list as string}", "[1,2,3,4]"), ("${list as string[]}", ["1", "2", "3", "4"]), ("${s as base64}", "dGV4dA=="), ("${input.p}", 3), ("${input.q.r}", "deep"), ("plain", "plain"), (5, 5), (None, None),
        (["a", "${s}", "...${items[*].k}", "z"], ["a", "text", "x", "y", "z"]), ({"a": "${n}", "b": {"c": "${s}"}}, {"a": 7, "b": {"c": "text"}}), ({"...": "${obj.a}", "c": 1}, {"b": "deep", "c": 1}),
        ({"+": ["${list[0:1]}", "${list[3:4]}"]}, [1, 4]), ({"+": ["a", "${none}", "b"]}, "ab"), ({"+": ["${none}", "${none}"]}, None), ({"|": "${items}", "ks": "${item.k}", "at": "${index}"}, {"ks": ["x", "y"], "at": [0, 1]}),
        ({"*": {"input": "${items}", "where": {"input": "${item.v}", "operator": "gt", "value": 1}}, "k": "${item.k}", "i": "${index}"}, [{"k": "y", "i": 1}]),
        ({"?": [{"input": "${n}", "operator": "gt", "value": 9, "if_true": "big"}, {"input": "${n}", "operator": "gt", "value": 5, "if_true": "middle", "if_false": "low"}, {"input": 1, "value": 1, "if_true": "no"}]}, "middle"),
        ({"?": {"input": "${n}", "operator": "gt", "value": 9, "if_true": "big"}}, None), ("${items as object[]/k}", [{"k": "x"}, {"k": "y"}]),
    ],
)
def test_templates(row, template, want):
    assert value(row, template, p=3, q={"r": "deep"}) == want


def test_parse_errors():
    for bad in ("", "9x", "a b"):
        with pytest.raises(ValueError):
            E.parse(bad)
    assert E.references({"a": "${input.x} ${item.y}", "b": ["${z}"]}) == {"input.x", "item.y", "z"}


CASES = [
    ("eq", "${none}", None, True), ("eq", "${n}", 7.0, True), ("eq", "${n}", "7", False), ("neq", "${none}", "a", True), ("gt", "${n}", 6, True), ("lte", "${n}", 6, False), ("gt", "${none}", "a", None),
    ("in", "${s}", ["text", "b"], True), ("in", "ex", "${s}", True), ("in", "${none}", ["a"], False), ("not-in", "${none}", ["a"], True), ("in", 3, "${list}", True), ("in", "3", "${list}", False),
    ("match", "${s}", "te", True), ("match", "${s}", "ex", False), ("match", "${s}", "a|te", True), ("starts-with", "${s}", "te", True), ("ends-with", "${s}", "xt", True), ("eq", "${flag}", 1, True),
]


@pytest.mark.parametrize("operator, left, right, want", CASES)
def test_operators(row, operator, left, right, want):
    scope = E.Scope.of(row)
    c = predicate({"input": left, "operator": operator, "value": right}, lambda t: compile_template(t, scope))
    assert row.select(c.alias("x")).first()["x"] == want


def test_combiners(row):
    yes, no = {"input": 1, "operator": "eq", "value": 1}, {"input": 1, "operator": "eq", "value": 2}
    for node, want in (({"all": []}, 1), ({"any": []}, 0), ({"not": no}, 1), ({"all": [yes, {"any": [no, yes]}]}, 1), ({"not": {"input": "${none}", "operator": "gt", "value": "a"}}, 1), (None, 1)):
        assert filter_rows(row, node).count() == want
    for bad in ({"all": [], "any": []}, {"operator": "eq"}, {"input": 1, "operator": "like", "value": 1}):
        with pytest.raises(ValueError):
            filter_rows(row, bad)
    assert row.where(field_conditions({"n": {"gte": 7, "in": [7, 8]}, "s": "text"}, E.Scope.of(row))).count() == 1
    assert row.where(field_conditions([{"field": "nothing", "operator": "eq", "value": "x"}], E.Scope.of(row))).count() == 0


def test_filters_reach_the_scan(spark, sf_dir):
    df = filter_rows(spark.read.parquet(f"{sf_dir}/orders.parquet"), {"input": "${item.o_custkey}", "operator": "eq", "value": 5})
    plan = project(df, {"id": "${item.o_orderkey}"})._jdf.queryExecution().toString()
    assert "EqualNullSafe(o_custkey,5)" in plan or "EqualTo(o_custkey,5)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan


def test_parsers(spark):
    rows = [("1:02:03", 3723.0), ("02:30", 150.0), ("90", 90.0), ("1.5h", 5400.0), ("250ms", 0.25), ("", None), ("x", None), (None, None), ("5 m", 300.0)]
    got = spark.createDataFrame(rows, "raw string, want double").select("want", casts.parse_duration(F.col("raw")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got), got
    rows = [("1.5M", 1572864, 1500000), ("10", 10, None), ("2kb", 2048, None), ("3k", 3072, 3000), ("x", None, None), (None, None, None)]
    got = spark.createDataFrame(rows, "raw string, size long, number long").select("size", "number", casts.parse_size(F.col("raw")).alias("a"), casts.parse_decimal(F.col("raw")).alias("b")).collect()
    assert all((r["size"], r["number"]) == (r["a"], r["b"]) for r in got), got


def numbers(spark):
    return {"in": spark.range(10).withColumnRenamed("id", "x")}


def test_pipeline(spark):
    spec = {
        "jobs": [
            {"id": "sum", "input": "even", "do": "aggregate", "total": "sum(x)"},
            {"id": "even", "input": "in", "do": "filter", "where": {"input": "${x}", "operator": "in", "value": [0, 2, 4, 6, 8]}},
            {"id": "out", "input": "even", "do": "map", "template": {"y": "${x as string}"}, "output": {"z": "v${y}${input.tail}"}},
        ]
    }
    out = P.compile_pipeline(spark, spec, {"tail": "!"}, numbers(spark))
    assert out["sum"].first()["total"] == 20
    assert sorted(r["z"] for r in out["out"].collect()) == ["v0!", "v2!", "v4!", "v6!", "v8!"]
    assert P.inputs_of(spec) == {"tail"}


@pytest.mark.parametrize("mode, want", [("a", "left"), ("b", "right"), ("c", None)])
def test_routes(spark, mode, want):
    spec = {
        "jobs": [
            {"id": "r", "input": "in", "do": "switch", "on": "${input.mode}", "routes": [{"value": "a", "to": "left"}, {"value": "b", "to": "right"}]},
            {"id": "left", "input": "in", "do": "limit", "n": 1},
            {"id": "right", "input": "in", "do": "limit", "n": 2},
        ]
    }
    out = P.compile_pipeline(spark, spec, {"mode": mode}, numbers(spark))
    assert set(out) - {"in", "r"} == ({want} if want else set())
    spec["jobs"][0] = {"id": "r", "input": "in", "do": "if", "routes": [{"input": "${input.mode}", "operator": "eq", "value": "a", "if_true": "left", "if_false": "right"}]}
    assert ("left" in P.compile_pipeline(spark, spec, {"mode": mode}, numbers(spark))) == (mode == "a")


def test_errors_and_retries(spark):
    calls = []

    def flaky(df, times):
        calls.append(1)
        if len(calls) < times:
            raise RuntimeError("not yet")
        return df

    P.OPERATIONS["flaky"] = flaky
    job = {"id": "f", "input": "in", "do": "flaky", "times": 3, "retry": {"max_attempt_count": 3}}
    assert P.compile_pipeline(spark, {"jobs": [job]}, None, numbers(spark))["f"].count() == 10 and len(calls) == 3
    calls.clear()
    with pytest.raises(RuntimeError):
        P.compile_pipeline(spark, {"jobs": [job | {"times": 9}]}, None, numbers(spark))
    out = P.compile_pipeline(spark, {"jobs": [job | {"times": 99, "retry": None, "on_error": {"to": "g"}}, {"id": "g", "input": "in", "do": "limit", "n": 1}]}, None, numbers(spark))
    assert out["g"].count() == 1 and "f" not in out
    waits = []
    with pytest.raises(ZeroDivisionError):
        P.attempt(lambda: 1 / 0, {"max_attempt_count": 4, "delay": 1, "backoff": "exponential", "max_delay": 3}, waits.append)
    assert waits == [1, 2, 3]


@pytest.mark.parametrize(
    "jobs",
    [
        [{"id": "a", "input": "in", "do": "nothing"}], [{"id": "a", "input": "zz", "do": "limit", "n": 1}], [{"id": "a", "input": "in", "do": "limit"}, {"id": "a", "input": "in", "do": "limit"}],
        [{"id": "a", "input": "b", "do": "distinct"}, {"id": "b", "input": "a", "do": "distinct"}], [{"id": "a", "input": "in", "do": "if", "routes": [{"if_true": "zz"}]}],
    ],
)
def test_bad_specs(jobs):
    with pytest.raises(P.SpecError):
        P.read_jobs({"jobs": jobs}, ["in"])


def test_command_line(tmp_path, spark, sf_dir, capsys):
    import json

    from weftline.__main__ import load, main, merge

    spec = {"sources": {"n": {"path": "${env.WEFT_DIR | " + sf_dir + "}/nation.parquet"}}, "jobs": [{"id": "f", "input": "n", "do": "filter", "where": {"input": "${n_regionkey}", "operator": "eq", "value": "${input.region as integer}"}}]}
    (tmp_path / "a.json").write_text(json.dumps(spec))
    (tmp_path / "b.json").write_text('{"seed": 4}')
    assert load([str(tmp_path / "a.json"), str(tmp_path / "b.json")], {"WEFT_DIR": "/x"}) == spec | {"seed": 4, "sources": {"n": {"path": "/x/nation.parquet"}}}
    assert merge({"a": {"b": 1, "c": 2}}, {"a": {"c": 3}, "d": 4}) == {"a": {"b": 1, "c": 3}, "d": 4}
    (tmp_path / "c.json").write_text('{"x": "${env.WEFT_NONE}"}')
    with pytest.raises(P.SpecError):
        load([str(tmp_path / "c.json")], {})
    assert main(["validate", str(tmp_path / "a.json")]) == 0 and "inputs: region" in capsys.readouterr().out


def test_models_keep_nulls(spark):
    from weftline.functions import models

    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "id int, t string")
    got = df.select("id", models.infer("text-to-text", "upper", F.col("t")).alias("u"), models.infer("text-embedding", "hashing", F.col("t"), batch=1).alias("e"), models.infer("text-classification", "length", F.col("t")).alias("c")).collect()
    assert [r["u"] for r in got] == ["A B", None, ""] and got[1]["e"] is None and len(got[0]["e"]) == 64 and got[2]["e"] == [0.0] * 64 and got[0]["c"]["label"] == "short"
    with pytest.raises(ValueError):
        models.infer("text-to-speech", "none", F.col("t"))


def test_failures_of_tasks_are_retried_and_routed(spark):
    """Errors that show only when rows are computed."""
    P.OPERATIONS["break"] = lambda df: df.withColumn("x", F.raise_error(F.lit("broken row")).cast("int"))
    jobs = [{"id": "f", "input": "in", "do": "break", "on_error": {"to": "g"}}, {"id": "g", "input": "in", "do": "limit", "n": 2}, {"id": "h", "input": "f", "do": "distinct"}]
    out = P.compile_pipeline(spark, {"jobs": jobs}, None, numbers(spark))
    assert out["g"].count() == 2 and "f" not in out and "h" not in out
    with pytest.raises(Exception, match="broken row"):
        P.compile_pipeline(spark, {"jobs": [{"id": "f", "input": "in", "do": "break", "retry": {"max_attempt_count": 2}}]}, None, numbers(spark))
    ignored = P.compile_pipeline(spark, {"jobs": [{"id": "f", "input": "in", "do": "break", "on_error": "ignore"}]}, None, numbers(spark))
    assert "f" not in ignored


def test_workflows_within_workflows(spark):
    inner = {"jobs": [{"id": "few", "input": "input", "do": "limit", "n": 4}, {"id": "n", "input": "few", "do": "aggregate", "n": "count(*)"}], "output": {"twice": "${n}"}}
    P.register_workflow("inner", inner)
    jobs = [{"id": "w", "input": "in", "do": "workflow", "workflow": "inner"}, {"id": "all", "input": "in", "do": "aggregate", "n": "count(*)"}]
    merged = P.result(spark, {"jobs": jobs}, None, numbers(spark))
    assert merged.first().asDict() == {"twice": 4, "n": 10}
    assert P.result(spark, {"jobs": jobs, "output": "w"}, None, numbers(spark)).columns == ["twice"]
    assert P.result(spark, {"jobs": jobs, "output": {"a": "${n}"}, "output_of": ["w", "all"]}, None, numbers(spark)).first()["a"] == 10
    with pytest.raises(P.SpecError, match="one row"):
        P.result(spark, {"jobs": [*jobs, {"id": "many", "input": "in", "do": "distinct"}]}, None, numbers(spark))
    with pytest.raises(P.SpecError, match="registered"):
        P.result(spark, {"jobs": [{"id": "w", "input": "in", "do": "workflow", "workflow": "none"}]}, None, numbers(spark))
    P.WORKFLOWS["loop"] = {"jobs": [{"id": "w", "input": "input", "do": "workflow", "workflow": "loop"}]}
    with pytest.raises(P.SpecError, match="deep"):
        P.result(spark, {"jobs": [{"id": "w", "input": "in", "do": "workflow", "workflow": "loop"}]}, None, numbers(spark))


def test_reruns_take_what_depends_along(spark):
    seen = []
    P.OPERATIONS["note"] = lambda df, name: seen.append(name) or df
    jobs = [{"id": "a", "input": "in", "do": "note", "name": "a"}, {"id": "b", "input": "a", "do": "note", "name": "b"}, {"id": "r", "input": "b", "do": "random-router", "routes": [{"to": "a", "weight": 1}, {"to": "end", "weight": 1}]}, {"id": "end", "input": "b", "do": "note", "name": "end"}]
    for seed in range(6):
        seen.clear()
        P.compile_pipeline(spark, {"jobs": jobs, "seed": seed}, None, numbers(spark))
        again = seen.count("a") - 1
        assert seen[-1] == "end" and [x for x in seen if x != "end"] == ["a", "b"] * (again + 1)
    with pytest.raises(P.SpecError, match="more than"):
        P.compile_pipeline(spark, {"jobs": [j if j["id"] != "r" else j | {"routes": [{"to": "a", "weight": 1}]} for j in jobs[:3]]}, None, numbers(spark))
    with pytest.raises(P.SpecError, match="never start"):
        P.compile_pipeline(spark, {"jobs": [{"id": "x", "do": "if", "otherwise": "y"}, {"id": "y", "input": "in", "do": "distinct"}, {"id": "z", "input": "x", "do": "distinct"}]}, None, numbers(spark))


def test_delays_and_tools():
    from datetime import UTC, datetime

    now = datetime(2024, 1, 1, tzinfo=UTC)
    assert P.waiting_time({"seconds": 2}) == 2 and P.waiting_time({"until": "2024-01-01T00:00:05"}, now) == 5 and P.waiting_time({"until": "2023-12-31T23:00:00+00:00"}, now) == 0
    spec = {"description": "finds", "inputs": {"k": {"type": "integer", "default": 3}, "q": {"description": "words"}}, "jobs": [{"id": "a", "input": "in", "do": "filter", "where": {"input": "${item.x}", "operator": "gt", "value": "${input.least}"}}]}
    tool = P.as_tool("find", spec)
    assert tool["parameters"]["required"] == ["least", "q"] and tool["parameters"]["properties"]["k"] == {"type": "integer", "default": 3} and tool["name"] == "find"


def test_status_patterns(spark):
    from weftline.plans.predicates import status_matches

    df = spark.createDataFrame([(200,), (204,), (404,), (503,), (None,)], "s int")
    fit = lambda p: [r["s"] for r in df.where(status_matches(F.col("s"), p)).collect()]
    assert fit("2xx") == [200, 204] and fit(["404", "5xx"]) == [404, 503] and fit("20x, 404") == [200, 204, 404] and fit(503) == [503]
    with pytest.raises(ValueError):
        status_matches(F.col("s"), "2x")


def test_every_task_has_a_working_interface(spark):
    """A model of each of the tasks gives results of the task's type, and null for null."""
    from pyspark.sql.types import _parse_datatype_string

    from weftline.functions import models

    def sample(kind):
        name = type(kind).__name__
        if name == "ArrayType":
            return [sample(kind.elementType)]
        if name == "StructType":
            return {f.name: sample(f.dataType) for f in kind}
        return {"StringType": "a", "DoubleType": 0.5, "BinaryType": b"x"}[name]

    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, t string")
    columns = []
    for task, kind in models.TASKS.items():
        value = sample(_parse_datatype_string(kind))
        models.MODELS[task, "sample"] = type("Sample", (), {"load": lambda self: None, "predict": lambda self, xs, v=value: [v for _ in xs]})
        columns.append(models.infer(task, "sample", F.col("t")).alias(task))
    rows = {r["id"]: r for r in df.select("id", *columns).collect()}
    for task, kind in models.TASKS.items():
        plain = lambda x: x.asDict() if hasattr(x, "asDict") else [plain(y) for y in x] if isinstance(x, list) else bytes(x) if isinstance(x, bytearray) else x
        assert plain(rows[1][task]) == sample(_parse_datatype_string(kind)) and rows[2][task] is None, task
