"""Command line: validate, catalog, describe, run, signal, views and an interactive line evaluator."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from ..errors import PanelError
from ..plans.parser import parse_line
from . import tools


def session() -> SparkSession:
    return SparkSession.builder.appName("quadrille").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _data(a: argparse.Namespace) -> dict:
    return {"config": a.config} if a.config else {"file": a.data}


def _show(out: dict) -> int:
    print(out["table"] if "table" in out else json.dumps(out, default=str, indent=2))
    return 1 if "error" in out or out.get("valid") is False else 0


def evaluate_line(spark: SparkSession, line: str, data: dict) -> dict:
    """A catalog request (`?`, `? field`) or an expression."""
    kind, what = parse_line(line)
    if kind == "catalog":
        return tools.functions()
    if kind == "describe":
        return tools.describe(spark, data, what)
    if kind == "decl":
        return tools.run(spark, what.name, data, program=line, format="markdown") if hasattr(what, "name") else {}
    return tools.evaluate(spark, line, data, format="markdown")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quadrille")
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, *args: [c := sub.add_parser(name), [c.add_argument(x) for x in args], c.add_argument("--config"), c.add_argument("--data"), c.add_argument("--out")][0]
    add("validate", "path")
    add("catalog").add_argument("--query")
    add("describe").add_argument("--field")
    add("run", "path").add_argument("--model", required=True)
    add("signal", "path").add_argument("--name", required=True)
    add("eval", "expression")
    add("views")
    add("repl")
    a = p.parse_args(argv)
    try:
        if a.command == "validate":
            with open(a.path, encoding="utf-8") as f:
                return _show(tools.validate(f.read(), path=a.path, data=_data(a) if a.config else None, spark=session() if a.config else None))
        if a.command == "catalog":
            return _show(tools.functions(a.query))
        spark = session()
        if a.command == "describe":
            return _show(tools.describe(spark, _data(a), a.field))
        how = {"to_file": a.out} if a.out else {"format": "markdown"}
        if a.command in ("run", "signal"):
            return _show(tools.run(spark, a.model if a.command == "run" else a.name, _data(a), path=a.path, **how))
        if a.command == "eval":
            return _show(tools.evaluate(spark, a.expression, _data(a), **how))
        if a.command == "views":
            return _show(tools.views(spark, _data(a)))
        for line in sys.stdin:
            if line.strip():
                try:
                    _show(evaluate_line(spark, line.strip(), _data(a)))
                except PanelError as e:
                    print(e)
        return 0
    except (PanelError, OSError) as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
