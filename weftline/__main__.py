"""``python -m weftline run spec.json --input k=v --output folder`` and ``validate``.

A spec is JSON (YAML where a parser is installed). ``${env.NAME | default}`` is replaced before it is
read; further files are merged over the first.
"""

from __future__ import annotations

import argparse
import json
import os
import re
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from .plans.pipeline import SpecError, compile_pipeline, inputs_of, read_jobs

_ENV = re.compile(r"\$\{env\.(\w+)(?:\s*\|\s*([^}]*))?\}")


def substitute(text: str, env: Mapping[str, str]) -> str:
    """The text with environment values; one that is missing without a default is an error."""

    def one(m: re.Match) -> str:
        if m[1] in env:
            return env[m[1]]
        if m[2] is None:
            raise SpecError(f"environment variable {m[1]} is not set")
        return m[2].strip()

    return _ENV.sub(one, text)


def merge(base: Any, over: Any) -> Any:
    """Objects are merged key by key; all else is replaced."""
    if isinstance(base, Mapping) and isinstance(over, Mapping):
        return {k: merge(base[k], over[k]) if k in base and k in over else over.get(k, base.get(k)) for k in (*base, *(k for k in over if k not in base))}
    return over


def load(paths: list[str], env: Mapping[str, str] | None = None) -> Any:
    """The spec of one or more files."""
    out: Any = {}
    for path in paths:
        text = substitute(Path(path).read_text(), os.environ if env is None else env)
        if path.endswith((".yml", ".yaml")):
            import yaml

            out = merge(out, yaml.safe_load(text))
        else:
            out = merge(out, json.loads(text))
    return out


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="weftline", description=__doc__)
    parser.add_argument("command", choices=("run", "validate"))
    parser.add_argument("spec", nargs="+")
    parser.add_argument("--input", action="append", default=[], metavar="NAME=VALUE")
    parser.add_argument("--job", help="the job whose rows are the output (the last one else)")
    parser.add_argument("--output", help="a folder for Parquet files; rows are shown else")
    args = parser.parse_args(argv)
    spec = load(args.spec)
    jobs = read_jobs(spec)
    if args.command == "validate":
        print(f"{len(jobs)} jobs, inputs: {', '.join(sorted(inputs_of(spec))) or 'none'}")
        return 0
    from pyspark.sql import SparkSession

    params = dict(x.split("=", 1) for x in args.input)
    out = compile_pipeline(SparkSession.builder.getOrCreate(), spec, params)
    df = out[args.job or next(j.id for j in reversed(jobs) if j.id in out)]
    df.write.mode("overwrite").parquet(args.output) if args.output else df.show(50, truncate=80)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
