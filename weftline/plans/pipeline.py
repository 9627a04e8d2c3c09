"""Pipelines: a spec of sources and jobs compiled to one lazy frame per output.

A job reads ``input`` (a source or job id), names an operation and its arguments. Jobs run in the
order of ``depends_on`` and ``input``; an entry of ``depends_on`` that is a list needs any of its jobs.
Nothing is computed while a pipeline is compiled, except where a route asks for a value.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Mapping, Sequence
from contextvars import ContextVar
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import datasets, frames, memory, sequence
from ..operators import vectors as vector_ops
from ..sources import files
from .expressions import Scope, references
from .predicates import predicate
from .templates import compile_template, filter_rows, project

Operation = Callable[..., DataFrame]
OPERATIONS: dict[str, Operation] = {}
#: Runs of one job in a pipeline at most, and pipelines within pipelines.
MOST_RUNS, MOST_DEPTH = 25, 25
#: Specs that jobs call by name.
WORKFLOWS: dict[str, Mapping[str, Any]] = {}


def operation(name: str) -> Callable[[Operation], Operation]:
    """Registers a function (frame, **arguments) -> frame under a name."""

    def add(f: Operation) -> Operation:
        OPERATIONS[name] = f
        return f

    return add


operation("filter")(lambda df, where=None: filter_rows(df, where))
operation("map")(lambda df, template: project(df, template))
operation("explode")(lambda df, column, alias=None: df.select("*", F.posexplode(column).alias("index", alias or "item")))
operation("select")(lambda df, columns: datasets.select(df, columns))
operation("map-template")(lambda df, template, output, remove=(): datasets.map_template(df, template, output, remove))
operation("sort")(lambda df, by: df.orderBy(*[F.col(k).desc() if d else F.col(k) for k, d in ((x.removeprefix("-"), x.startswith("-")) for x in by)]))
operation("limit")(lambda df, n: df.limit(n))
operation("distinct")(lambda df, columns=None: df.dropDuplicates(columns) if columns else df.distinct())
operation("position")(lambda df, order, name="pos": frames.with_position(df, order, name))
operation("batches")(lambda df, order, size: frames.batches(df, order, size))
operation("aggregate")(lambda df, by=(), **measures: _grouped(df, by, measures))
operation("merge-gaps")(sequence.merge_gaps)
operation("segments")(sequence.segments)
operation("memory-window")(memory.window)


def _grouped(df: DataFrame, by: Sequence[str] | Mapping[str, Sequence[str]], measures: Mapping[str, str]) -> DataFrame:
    """``by``: columns, or {"rollup" | "cube": columns}; ``measures``: name -> SQL aggregate."""
    kind, columns = next(iter(by.items())) if isinstance(by, Mapping) else ("groupBy", by)
    return getattr(df, kind)(*columns).agg(*[F.expr(sql).alias(name) for name, sql in measures.items()])


@operation("join")
def join(df: DataFrame, other: DataFrame, on: Any, how: str = "inner") -> DataFrame:
    """A relational join on columns or a SQL condition; Spark picks the strategy by the sides' sizes."""
    names = [on] if isinstance(on, str) else list(on)
    return df.join(other, names if all(n in df.columns for n in names) else F.expr(str(on)), how)


@operation("union")
def union(df: DataFrame, other: DataFrame) -> DataFrame:
    """All rows of both frames."""
    return frames.concat_rows([df, other])


@operation("vector-search")
def vector_search(df: DataFrame, other: DataFrame, **arguments: Any) -> DataFrame:
    """Searches ``df`` for the queries ``other``."""
    return vector_ops.search(other, df, **arguments)


@operation("for-each")
def for_each(df: DataFrame, do: str | Operation, template: Mapping[str, Any] | None = None, **arguments: Any) -> DataFrame:
    """An operation on all rows; then, if given, a template on its result."""
    out = (OPERATIONS[do] if isinstance(do, str) else do)(df, **arguments)
    return project(out, template) if template else out


def register_workflow(name: str, spec: Mapping[str, Any]) -> None:
    """Makes a spec callable as the operation ``workflow`` under a name; it is read at once, so that its
    errors show here."""
    read_jobs(spec, ["input"])
    WORKFLOWS[name] = spec


_depth = ContextVar("depth", default=0)


@operation("workflow")
def workflow(df: DataFrame, workflow: str | Mapping[str, Any], params: Mapping[str, Any] | None = None, other: DataFrame | None = None) -> DataFrame:
    """The :func:`result` of another pipeline, whose source ``input`` is ``df`` (and ``other`` the second
    frame). It becomes part of the same lazy plan. A pipeline that calls itself without end is an error."""
    if isinstance(workflow, str) and workflow not in WORKFLOWS:
        raise SpecError(f"no workflow {workflow!r} is registered")
    depth = _depth.set(_depth.get() + 1)
    try:
        if _depth.get() > MOST_DEPTH:
            raise SpecError(f"workflows call each other more than {MOST_DEPTH} deep")
        spec = WORKFLOWS[workflow] if isinstance(workflow, str) else workflow
        return result(df.sparkSession, spec, params, {"input": df} | ({"other": other} if other is not None else {}))
    finally:
        _depth.reset(depth)


@dataclass
class Job:
    """A step of a pipeline."""

    id: str
    do: str
    input: str | None = None
    with_: str | None = None
    depends_on: list[str | list[str]] = field(default_factory=list)
    arguments: dict[str, Any] = field(default_factory=dict)
    output: Mapping[str, Any] | None = None
    routes: list[dict[str, Any]] = field(default_factory=list)
    on_error: Any = None
    retry: Mapping[str, Any] | None = None
    before: Callable[[DataFrame], DataFrame] | None = None
    after: Callable[[DataFrame], DataFrame] | None = None


class SpecError(ValueError):
    """A pipeline spec that can't be compiled."""


ROUTERS = ("if", "switch", "random-router")


def read_jobs(spec: Mapping[str, Any], given: Sequence[str] = ()) -> list[Job]:
    """The jobs of a spec; ``given`` names frames that exist. Unknown operations, repeated ids, dangling names and cycles are errors."""
    jobs = []
    for raw in spec.get("jobs", []):
        x = dict(raw)
        known = {k: x.pop(k) for k in ("id", "input", "depends_on", "output", "on_error", "retry", "before", "after") if k in x}
        job = Job(do=x.pop("do", "map"), with_=x.pop("with", None), routes=x.pop("routes", []), arguments=x, **known)
        if job.do not in OPERATIONS and job.do not in ROUTERS and job.do != "delay":
            raise SpecError(f"job {job.id}: unknown operation {job.do!r}")
        jobs.append(job)
    ids = [j.id for j in jobs]
    names = set(ids) | set(spec.get("sources", {})) | set(given)
    if len(ids) != len(set(ids)):
        raise SpecError("job ids repeat")
    for j in jobs:
        for name in needs(j, flat=True):
            if name not in names:
                raise SpecError(f"job {j.id} needs {name!r}, which does not exist")
        for r in j.routes:
            for k in ("if_true", "if_false", "to"):
                if r.get(k) is not None and r[k] not in ids:
                    raise SpecError(f"job {j.id} routes to {r[k]!r}, which does not exist")
    in_order(jobs)
    return jobs


def needs(job: Job, flat: bool = False) -> list[Any]:
    """What a job waits for: all entries, any job of an entry that is a list."""
    out = [x for x in (job.input, job.with_) if x] + list(job.depends_on)
    return [y for x in out for y in (x if isinstance(x, list) else [x])] if flat else out


def in_order(jobs: Sequence[Job]) -> list[Job]:
    """Jobs so that each comes after what it needs."""
    by = {j.id: j for j in jobs}
    done: list[Job] = []
    state: dict[str, int] = {}

    def visit(j: Job) -> None:
        if state.get(j.id) == 2:
            return
        if state.get(j.id) == 1:
            raise SpecError(f"jobs depend on each other in a circle through {j.id!r}")
        state[j.id] = 1
        for name in needs(j, flat=True):
            if name in by:
                visit(by[name])
        state[j.id] = 2
        done.append(j)

    for j in jobs:
        visit(j)
    return done


def attempt(f: Callable[[], Any], retry: Mapping[str, Any] | None, sleep: Callable[[float], None] = time.sleep) -> Any:
    """Calls again after a failure, up to ``max_attempt_count``; the delay is fixed or doubles up to
    ``max_delay``."""
    spec = retry or {}
    most, delay = int(spec.get("max_attempt_count", 1)), float(spec.get("delay", 0))
    for n in range(1, most + 1):
        try:
            return f()
        except Exception:
            if n == most:
                raise
            wait = delay * 2 ** (n - 1) if spec.get("backoff") == "exponential" else delay
            sleep(min(wait, float(spec.get("max_delay", wait))))
    raise SpecError("no attempt was made")


def pick_route(job: Job, params: Mapping[str, Any], spark: SparkSession, rng: random.Random) -> str | None:
    """The job that a router sends to. Conditions see parameters only; they are evaluated once."""
    if job.do == "random-router":
        live = [r for r in job.routes if r.get("weight", 1) and r.get("weight", 1) > 0]
        if not live:
            raise SpecError(f"job {job.id}: no route has a weight")
        return rng.choices([r["to"] for r in live], [r.get("weight", 1) for r in live])[0]
    one = spark.range(1)
    scope = Scope.of(one, params)
    compile_ = lambda t: compile_template(t, scope)
    for r in job.routes:
        if job.do == "switch":
            node = {"input": job.arguments.get("on"), "operator": "eq", "value": r.get("value")}
        else:
            node = {k: v for k, v in r.items() if k not in ("if_true", "if_false", "to")}
        held = bool(one.select(F.coalesce(predicate(node, compile_), F.lit(False))).first()[0])
        target = (r.get("if_true") or r.get("to")) if held else r.get("if_false")
        if target:
            return target
    return job.arguments.get("otherwise")


def compile_pipeline(spark: SparkSession, spec: Mapping[str, Any], params: Mapping[str, Any] | None = None, frames_in: Mapping[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The frame of every job that runs; jobs that routes name run only if they are chosen, and jobs that
    read a failed one do not run.

    A route to a job that has run reruns it and all that depends on it, routers included, up to
    ``MOST_RUNS`` times.
    """
    params, rng = dict(params or {}), random.Random(spec.get("seed", 0))
    jobs = read_jobs(spec, list(frames_in or ()))
    by = {j.id: j for j in jobs}
    out: dict[str, DataFrame] = dict(frames_in or {})
    for name, source in spec.get("sources", {}).items():
        if name not in out:
            out[name] = files.read(spark, source)
    targets = [(j, r[k]) for j in jobs for r in j.routes for k in ("if_true", "if_false", "to") if r.get(k)] + [(j, j.arguments["otherwise"]) for j in jobs if j.do in ROUTERS and j.arguments.get("otherwise")]
    routed = {name for j, name in targets if j.id not in dependents(jobs, name)}  # a way back is no condition
    routed |= {j.on_error["to"] for j in jobs if isinstance(j.on_error, Mapping) and j.on_error.get("to")}
    chosen: set[str] = set()
    done: set[str] = set()
    failed: set[str] = set()
    runs: dict[str, int] = {}
    waiting = [j for j in in_order(jobs)]
    while waiting:
        may = lambda j, y: y in out or y in done and y not in (j.input, j.with_) and (y not in failed or by[y].on_error == "ignore")
        ready = next((j for j in waiting if (j.id not in routed or j.id in chosen) and all(any(may(j, y) for y in (x if isinstance(x, list) else [x])) for x in needs(j))), None)
        if ready is None:
            break
        waiting.remove(ready)
        runs[ready.id] = runs.get(ready.id, 0) + 1
        if runs[ready.id] > MOST_RUNS:
            raise SpecError(f"job {ready.id} ran more than {MOST_RUNS} times")
        done.add(ready.id)
        if ready.do in ROUTERS:
            if ready.input:
                out[ready.id] = out[ready.input]
            target = pick_route(ready, params, spark, rng)
            if target:
                chosen.add(target)
                if target in done:
                    again = {target} | dependents(jobs, target)
                    done -= again
                    for name in again:
                        out.pop(name, None)
                    waiting += [by[j.id] for j in in_order(jobs) if j.id in again and by[j.id] not in waiting]
        elif not _run(ready, out, params, chosen):
            failed.add(ready.id)
    # what waits for a job that no route chose, or that failed and may, never starts; all else must
    never = {j.id for j in waiting if j.id in routed and j.id not in chosen} | failed
    while more := {j.id for j in waiting if j.id not in never and any(all(y in never for y in (x if isinstance(x, list) else [x])) for x in needs(j))}:
        never |= more
    if left := [j.id for j in waiting if j.id not in never]:
        raise SpecError(f"jobs that can never start: {left}")
    return out


def dependents(jobs: Sequence[Job], name: str) -> set[str]:
    """All jobs that need a job, directly or through others."""
    found: set[str] = set()
    while more := {j.id for j in jobs if j.id not in found and ({name} | found) & set(needs(j, flat=True))}:
        found |= more
    return found


def _run(job: Job, out: dict[str, DataFrame], params: Mapping[str, Any], chosen: set[str]) -> bool:
    """Runs a job; whether it gave a frame. A job with ``retry`` or ``on_error`` is computed and written
    within the attempt, so that failures of its tasks count as well as those of its plan."""

    def once() -> DataFrame:
        df = out[job.input] if job.input else None
        df = job.before(df) if job.before else df
        if job.do == "delay":
            time.sleep(waiting_time(job.arguments))
            return df
        more = {"other": out[job.with_]} if job.with_ else {}
        found = OPERATIONS[job.do](df, **more, **job.arguments)
        found = project(found, job.output, Scope.of(found, params)) if job.output else found
        found = job.after(found) if job.after else found
        return files.write_once(found, "job") if job.retry or job.on_error is not None else found

    try:
        out[job.id] = attempt(once, job.retry)
        return True
    except Exception:
        if job.on_error is None:
            raise
        if isinstance(job.on_error, Mapping) and job.on_error.get("to"):
            chosen.add(job.on_error["to"])
        return False


def waiting_time(arguments: Mapping[str, Any], now: datetime | None = None) -> float:
    """Seconds that a ``delay`` waits: ``seconds``, or up to the moment ``until`` (ISO; UTC without a
    zone; 0 once it has passed)."""
    if arguments.get("until") is not None:
        moment = datetime.fromisoformat(str(arguments["until"]))
        moment = moment if moment.tzinfo else moment.replace(tzinfo=UTC)
        return max((moment - (now or datetime.now(UTC))).total_seconds(), 0.0)
    return max(float(arguments.get("seconds", 0)), 0.0)


def result(spark: SparkSession, spec: Mapping[str, Any], params: Mapping[str, Any] | None = None, frames_in: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """What a pipeline gives as a whole.

    ``output`` of the spec names a job, or is a template over the merged results of the jobs in
    ``output_of`` (else the last ones). Last jobs are those that ran and that no other job needs. One
    alone gives its frame; several must give one row each, which are merged in the order of the spec,
    where a later column replaces an earlier one of its name.
    """
    out = compile_pipeline(spark, spec, params, frames_in)
    wanted = spec.get("output")
    if isinstance(wanted, str):
        return out[wanted]
    jobs = read_jobs(spec, list(frames_in or ()))
    needed = {x for j in jobs for x in needs(j, flat=True)}
    names = spec.get("output_of") or [j.id for j in jobs if j.id in out and j.id not in needed and j.do not in ROUTERS]
    if not names:
        raise SpecError("no job gives a result")
    merged = out[names[0]]
    for k, name in enumerate(names[1:]):
        for one, frame in ((name, out[name]), *([(names[0], merged)] if k == 0 else [])):
            if len(frame.take(2)) != 1:
                raise SpecError(f"results of several last jobs are merged row by row: {one!r} has not one row")
        merged = frames.broadcast_value(merged.drop(*out[name].columns), out[name])
    return project(merged, wanted, Scope.of(merged, dict(params or {}))) if wanted else merged


def inputs_of(spec: Mapping[str, Any]) -> set[str]:
    """Parameters that a spec reads (``input.name``): its signature."""
    found = set()
    for job in spec.get("jobs", []):
        found |= {r for r in references({k: v for k, v in job.items() if not callable(v)}) if r.startswith("input.")}
    return {r.removeprefix("input.") for r in found}


def as_tool(name: str, spec: Mapping[str, Any]) -> dict[str, Any]:
    """A pipeline as a callable tool: its name, description, and a JSON schema of the parameters that it
    reads. ``inputs`` of the spec may give their type, description and default."""
    known = spec.get("inputs", {})
    read = sorted(inputs_of(spec) | set(known))
    fields = {k: {"type": "string"} | {x: y for x, y in known.get(k, {}).items() if x in ("type", "description", "default", "enum")} for k in read}
    needed = [k for k in read if "default" not in fields[k] and known.get(k, {}).get("required", True)]
    return {"name": name, "description": spec.get("description", ""), "parameters": {"type": "object", "properties": fields, "required": needed}}
