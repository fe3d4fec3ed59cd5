"""Command line: query, import, export, describe, info, schema, compact, bench and an interactive shell."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession

from lamina.dialect.nodes import CreateTable, CreateType
from lamina.dialect.parser import parse_script
from lamina.engine import Engine
from lamina.errors import LaminaError
from lamina.schema import TableSpec, from_json
from lamina.sources import readers, sinks


def session(master: str | None = None) -> SparkSession:
    b = SparkSession.builder.appName("lamina").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
    return (b.master(master) if master else b).getOrCreate()


def load_schema(engine: Engine, path: str) -> TableSpec | None:
    """A table's spec from a JSON or CQL file; CREATE TYPE statements before it are registered."""
    text = open(path, encoding="utf-8").read()
    if path.endswith(".json"):
        return from_json(text, engine.catalog.registry.names(engine.catalog.keyspace))
    spec = None
    for s in parse_script(text):
        if isinstance(s, CreateType):
            engine.run(s)
        elif isinstance(s, CreateTable):
            spec = engine.spec_of(s)
    return spec


def open_tables(engine: Engine, given: list[str], schema: str | None) -> None:
    """name=path pairs as tables; a schema declares the key of the one it names, or of the only one."""
    spec = load_schema(engine, schema) if schema else None
    for g in given:
        name, eq, path = g.partition("=")
        if not eq:
            raise LaminaError(f"{g}: expected name=path")
        df = readers.read(engine.spark, *path.split(","))
        own = spec if spec and (spec.name.lower() == name.lower() or len(given) == 1) else None
        engine.register(name, df, spec=own)


def shell(engine: Engine, style: str) -> None:
    """Statements end with a semicolon; .help tells the rest."""
    buffer = ""
    for line in sys.stdin:
        word = line.strip()
        if not buffer and word.startswith("."):
            command, _, rest = word.partition(" ")
            if command in (".quit", ".exit"):
                return
            try:
                print(_dot(engine, command, rest.strip()))
            except LaminaError as e:
                print(f"error: {e}")
            continue
        buffer += line
        if word.endswith(";"):
            text, buffer = buffer, ""
            began = time.monotonic()
            try:
                for df in engine.script(text):
                    print(sinks.format_rows(df, style))
                print(f"{time.monotonic() - began:.3f} s")
            except LaminaError as e:
                print(f"error: {e}")


def _dot(engine: Engine, command: str, rest: str) -> str:
    if command == ".help":
        return ".help .quit .tables .schema TABLE .info .clear"
    if command == ".tables":
        return "\n".join(engine.tables())
    if command == ".schema":
        return engine.ddl(rest) if engine.partition_keys(rest) else sinks.format_rows(engine.describe(rest))
    if command == ".info":
        return json.dumps(engine.stats())
    if command == ".clear":
        return "\033[2J\033[H"
    return f"unknown command {command}; try .help"


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lamina", description=__doc__)
    p.add_argument("--master")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *extra: tuple[str, dict]) -> None:
        c = sub.add_parser(name)
        c.add_argument("-t", "--table", action="append", default=[], metavar="NAME=PATH")
        c.add_argument("--schema")
        for flag, options in extra:
            c.add_argument(flag, **options)

    style = ("--format", {"default": "table", "choices": ["table", "json", "csv", "yaml"]})
    add("query", ("text", {}), style, ("--limit", {"type": int, "default": 1000}), ("--explain", {"action": "store_true"}), ("--timing", {"action": "store_true"}))
    add("read", ("name", {}), style, ("--limit", {"type": int, "default": 100}), ("--skip", {"type": int, "default": 0}))
    add("export", ("text", {}), ("path", {}), ("--format", {"default": "parquet", "choices": [*sinks.EXPORTS, "sql"]}), ("--into", {"default": "exported"}))
    add("import", ("source", {}), ("target", {}), ("--codec", {"default": "zstd"}))
    add("describe", ("name", {}), style)
    add("schema", ("action", {"choices": ["validate", "show"]}), ("file", {}))
    add("info", ("--exact", {"action": "store_true"}), style)
    add("bench", ("text", {}), ("--runs", {"type": int, "default": 5}))
    add("shell", style)
    a = p.parse_args(argv)
    engine = Engine(session(a.master))
    try:
        open_tables(engine, a.table, a.schema)
        if a.command == "query":
            if a.explain:
                print(engine.explain(a.text))
                return 0
            began = time.monotonic()
            print(sinks.format_rows(engine.execute(a.text), a.format, a.limit))
            if a.timing:
                print(f"{time.monotonic() - began:.3f} s", file=sys.stderr)
        elif a.command == "read":
            print(sinks.format_rows(engine.catalog.find(a.name, engine.now)[0].offset(a.skip).limit(a.limit), a.format, a.limit))
        elif a.command == "export":
            df = engine.execute(a.text)
            sinks.to_sql(df, a.path, a.into) if a.format == "sql" else sinks.export(df, a.path, a.format)
        elif a.command == "import":
            df = readers.read(engine.spark, a.source)
            spec = load_schema(engine, a.schema) if a.schema else None
            sinks.write_table(df, spec, a.target, compression=a.codec) if spec else sinks.to_parquet(df, a.target, a.codec)
        elif a.command == "describe":
            print(sinks.format_rows(engine.describe(a.name), a.format))
        elif a.command == "schema":
            spec = load_schema(engine, a.file)
            if spec is None:
                raise LaminaError(f"{a.file} declares no table")
            print(spec.ddl() if a.action == "show" else f"valid: {spec.keyspace}.{spec.name}")
        elif a.command == "info":
            for t in engine.tables():
                print(t)
                print(sinks.format_rows(engine.column_stats(t, a.exact), a.format))
        elif a.command == "bench":
            print(json.dumps(engine.benchmark(a.text, a.runs)))
        else:
            shell(engine, a.format)
    except LaminaError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
