"""DataFrames to files and text."""

from __future__ import annotations

import datetime
import decimal
import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.errors import QueryProblem
from lamina.schema import TableSpec

CODECS = ("none", "snappy", "gzip", "lz4", "zstd")


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, binary ones in base 64: what a line of CSV can hold."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType):
            c = F.to_json(c)
        elif isinstance(f.dataType, T.BinaryType):
            c = F.base64(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def to_csv(df: DataFrame, path: str, header: bool = True, mode: str = "overwrite", **options) -> None:
    flat(df).write.mode(mode).options(header=header, quote='"', escape='"', **options).csv(path)


def to_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def to_json_array(df: DataFrame, path: str, most_rows: int = 100_000) -> None:
    """One file with an array, written by the driver row by row; for small results, up to ``most_rows``."""
    rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("v")).limit(most_rows + 1)
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for k, r in enumerate(rows.toLocalIterator()):
            if k == most_rows:
                raise QueryProblem(f"more than {most_rows} rows: write JSON lines")
            f.write(("," if k else "") + "\n" + r["v"])
        f.write("\n]\n")


def to_parquet(df: DataFrame, path: str, compression: str = "zstd", mode: str = "overwrite", partition_by: list[str] = (), bloom: list[str] = ()) -> None:
    """Parquet; ``bloom`` names columns that get bloom filters for point reads."""
    if compression not in CODECS:
        raise QueryProblem(f"unknown codec {compression}")
    w = df.write.mode(mode).option("compression", compression)
    for c in bloom:
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def to_orc(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).orc(path)


def to_excel(df: DataFrame, path: str, most_rows: int = 1_000_000) -> None:
    """A workbook, through pandas on the driver, up to ``most_rows``; needs an Excel writer for pandas."""
    rows = flat(df).limit(most_rows + 1).toPandas()
    if len(rows) > most_rows:
        raise QueryProblem(f"more than {most_rows} rows: write CSV or Parquet")
    rows.to_excel(path, index=False)


def sql_literal(c: Column, kind: T.DataType) -> Column:
    """A value as it stands in an INSERT statement."""
    quoted = lambda s: F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("''")), F.lit("'"))
    if isinstance(kind, T.StringType | T.DateType | T.TimestampType | T.TimestampNTZType):
        out = quoted(c.cast("string"))
    elif isinstance(kind, T.BinaryType):
        out = F.concat(F.lit("0x"), F.lower(F.hex(c)))
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(c, lambda v: sql_literal(v, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, T.MapType):
        pairs = F.transform(F.map_entries(c), lambda e: F.concat(sql_literal(e["key"], kind.keyType), F.lit(": "), sql_literal(e["value"], kind.valueType)))
        out = F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))
    elif isinstance(kind, T.StructType):
        inner = [sql_literal(c[f.name], f.dataType) for f in kind]
        tuple_ = all(f.name.startswith("_") for f in kind)
        parts = [i if tuple_ else F.concat(F.lit(f"{f.name}: "), i) for f, i in zip(kind, inner, strict=True)]
        out = F.concat(F.lit("(" if tuple_ else "{"), F.concat_ws(", ", *parts), F.lit(")" if tuple_ else "}"))
    else:
        out = c.cast("string")
    return F.coalesce(out, F.lit("NULL"))


def insert_statements(df: DataFrame, table: str) -> DataFrame:
    """(value): an INSERT statement for each row, made on the executors."""
    head = f"INSERT INTO {table} ({', '.join(df.columns)}) VALUES ("
    values = [sql_literal(F.col(f"`{f.name}`"), f.dataType) for f in df.schema]
    return df.select(F.concat(F.lit(head), F.concat_ws(", ", *values), F.lit(");")).alias("value"))


def to_sql(df: DataFrame, path: str, table: str, mode: str = "overwrite") -> None:
    insert_statements(df, table).write.mode(mode).text(path)


def write_table(df: DataFrame, spec: TableSpec, path: str, partitions: int | None = None, compression: str = "zstd", mode: str = "overwrite") -> None:
    """A table laid out by its key: partitions together, rows in clustering order, bloom filters on the partition key."""
    from lamina.operators.partitions import clustered

    to_parquet(clustered(df, spec, partitions), path, compression, mode, bloom=list(spec.partition_key))


EXPORTS = {"csv": to_csv, "json": to_json_lines, "parquet": to_parquet, "orc": to_orc, "excel": to_excel}


def export(df: DataFrame, path: str, format: str, **options) -> None:
    if format not in EXPORTS:
        raise QueryProblem(f"unknown format {format}")
    EXPORTS[format](df, path, **options)


def export_all(df: DataFrame, base: str, formats: list[str]) -> dict[str, str]:
    """Each format in turn to base.format; says ok or what went wrong for each."""
    out = {}
    for f in formats:
        try:
            export(df, f"{base}.{f}", f)
            out[f] = "ok"
        except Exception as e:  # one format's failure leaves the others
            out[f] = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
    return out


# ---------------------------------------------------------------- display


def show_value(v) -> str:
    """NULL, 'text', BLOB(n bytes), [list], {k: v}, (tuple)."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, str):
        return f"'{v}'"
    if isinstance(v, bytes | bytearray):
        return f"BLOB({len(v)} bytes)"
    if isinstance(v, Row):
        return "(" + ", ".join(show_value(x) for x in v) + ")"
    if isinstance(v, list):
        return "[" + ", ".join(show_value(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ", ".join(f"{show_value(k)}: {show_value(x)}" for k, x in v.items()) + "}"
    return str(v)


def table_text(columns: list[str], rows: Iterator[Row], plain: bool = True) -> str:
    cells = [[("" if v is None else v if plain and isinstance(v, str) else show_value(v)) for v in r] for r in rows]
    width = [max([len(c), *(len(r[k]) for r in cells)]) for k, c in enumerate(columns)]
    line = lambda r: " | ".join(x.ljust(w) for x, w in zip(r, width, strict=True)).rstrip()
    return "\n".join([line(columns), "-+-".join("-" * w for w in width), *map(line, cells), f"({len(cells)} rows)"])


def plain(v):
    """A value as JSON and YAML know it."""
    if isinstance(v, Row):
        return {k: plain(x) for k, x in v.asDict().items()}
    if isinstance(v, list):
        return [plain(x) for x in v]
    if isinstance(v, dict):
        return {str(k): plain(x) for k, x in v.items()}
    if isinstance(v, bytes | bytearray):
        return "0x" + bytes(v).hex()
    if isinstance(v, datetime.date | datetime.datetime):
        return v.isoformat()
    return str(v) if isinstance(v, decimal.Decimal) else v


def yaml_text(rows: Iterator[Row]) -> str:
    """Rows as a YAML list; values are JSON, which YAML includes."""
    out = []
    for r in rows:
        for k, (name, v) in enumerate(r.asDict().items()):
            out.append(f"{'- ' if not k else '  '}{name}: {json.dumps(plain(v), ensure_ascii=False)}")
    return "\n".join(out) or "[]"


def format_rows(df: DataFrame, style: str = "table", most: int = 1000) -> str:
    """Up to ``most`` rows as table, json, csv or yaml text."""
    if style == "csv":
        small = flat(df).limit(most).select(F.to_csv(F.struct("*")).alias("v"))
        return "\n".join([",".join(df.columns), *(r["v"] for r in small.toLocalIterator())])
    rows = df.limit(most).toLocalIterator()
    if style == "table":
        return table_text(df.columns, rows)
    if style == "json":
        return json.dumps([plain(r) for r in rows], ensure_ascii=False, indent=1)
    if style == "yaml":
        return yaml_text(rows)
    raise QueryProblem(f"unknown style {style}")
