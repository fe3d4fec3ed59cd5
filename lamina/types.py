"""CQL types and the Spark types that hold them.

Sets, frozen values, counters and the like have no Spark type of their own; ``field`` keeps what they are in the field's
metadata. A set is an array without repeats in ascending order.
"""

from __future__ import annotations

from dataclasses import dataclass, field as _field

from pyspark.sql import types as T

from lamina.errors import SchemaProblem

#: Scalars: name to Spark type. Time is nanoseconds of the day, varint holds up to 38 digits.
SCALARS: dict[str, T.DataType] = {
    "boolean": T.BooleanType(),
    "tinyint": T.ByteType(),
    "smallint": T.ShortType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "counter": T.LongType(),
    "varint": T.DecimalType(38, 0),
    "decimal": T.DecimalType(38, 18),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "text": T.StringType(),
    "varchar": T.StringType(),
    "ascii": T.StringType(),
    "blob": T.BinaryType(),
    "uuid": T.StringType(),
    "timeuuid": T.StringType(),
    "timestamp": T.TimestampType(),
    "date": T.DateType(),
    "time": T.LongType(),
    "duration": T.StructType([T.StructField("months", T.IntegerType()), T.StructField("days", T.IntegerType()), T.StructField("nanos", T.LongType())]),
    "inet": T.StringType(),
    "json": T.StringType(),
}
#: Bytes of a value where they are fixed.
FIXED_SIZES = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "counter": 8, "float": 4, "double": 8, "uuid": 16, "timeuuid": 16, "timestamp": 8, "date": 4, "time": 8}
#: What stands in for a missing value where one is asked for.
DEFAULTS = {"boolean": False, "tinyint": 0, "smallint": 0, "int": 0, "bigint": 0, "counter": 0, "varint": 0, "float": 0.0, "double": 0.0, "text": "", "varchar": "", "ascii": "", "blob": b""}


@dataclass(frozen=True)
class CqlType:
    """name: a scalar, list, set, map, tuple, frozen, vector, udt or custom; args: the types inside; label: of a UDT or custom type."""

    name: str
    args: tuple[CqlType, ...] = ()
    label: str = ""
    size: int = 0

    def __str__(self) -> str:
        if self.name in ("udt", "custom"):
            return self.label
        if self.name == "vector":
            return f"vector<{self.args[0]}, {self.size}>"
        return f"{self.name}<{', '.join(map(str, self.args))}>" if self.args else self.name

    @property
    def bare(self) -> CqlType:
        return self.args[0].bare if self.name == "frozen" else self


def parse_type(text: str, known: set[str] | None = None) -> CqlType:
    """A type from its text, in any case and nesting. ``known`` names the user-defined types; None takes any name for one."""
    parser = _TypeParser(text, known)
    out = parser.type()
    parser.done()
    return out


@dataclass
class _TypeParser:
    text: str
    known: set[str] | None
    at: int = _field(default=0)

    def fail(self, why: str) -> SchemaProblem:
        return SchemaProblem(f"type {self.text!r}: {why}")

    def skip(self) -> str:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1
        return self.text[self.at : self.at + 1]

    def take(self, sign: str) -> None:
        if self.skip() != sign:
            raise self.fail(f"expected {sign!r} at {self.at}")
        self.at += 1

    def done(self) -> None:
        if self.skip():
            raise self.fail(f"unexpected {self.text[self.at :]!r}")

    def word(self) -> str:
        if self.skip() in "\"'" and self.skip():
            quote = self.text[self.at]
            end = self.text.find(quote, self.at + 1)
            if end < 0:
                raise self.fail("an open quote")
            out, self.at = self.text[self.at + 1 : end], end + 1
            return out
        start = self.at
        while self.at < len(self.text) and (self.text[self.at].isalnum() or self.text[self.at] in "_."):
            self.at += 1
        if start == self.at:
            raise self.fail(f"expected a name at {start}")
        return self.text[start : self.at]

    def type(self) -> CqlType:
        quoted = self.skip() == "'"
        name = self.word()
        low = name.lower()
        if quoted:
            return CqlType("custom", label=name)
        if low in ("list", "set", "map", "tuple", "frozen", "vector"):
            self.take("<")
            args = [self.type()]
            size = 0
            while self.skip() == ",":
                self.at += 1
                if low == "vector":
                    digits = self.word()
                    if not digits.isdigit() or not int(digits):
                        raise self.fail("a vector needs a positive dimension")
                    size = int(digits)
                else:
                    args.append(self.type())
            self.take(">")
            want = {"list": 1, "set": 1, "map": 2, "frozen": 1, "vector": 1}.get(low)
            if want and len(args) != want or low == "vector" and not size:
                raise self.fail(f"{low} takes {want} types" + " and a dimension" * (low == "vector"))
            return CqlType(low, tuple(args), size=size)
        if low in SCALARS:
            return CqlType(low)
        if self.known is not None and low not in {k.lower() for k in self.known} and low.rpartition(".")[2] not in {k.lower() for k in self.known}:
            raise self.fail("unknown type")
        return CqlType("udt", label=name)


def spark_type(t: CqlType, udts: dict[str, T.StructType] | None = None) -> T.DataType:
    """The Spark type that holds values of a type."""
    if t.name == "frozen":
        return spark_type(t.args[0], udts)
    if t.name in ("list", "set"):
        return T.ArrayType(spark_type(t.args[0], udts))
    if t.name == "vector":
        return T.ArrayType(spark_type(t.args[0], udts))
    if t.name == "map":
        return T.MapType(spark_type(t.args[0], udts), spark_type(t.args[1], udts))
    if t.name == "tuple":
        return T.StructType([T.StructField(f"_{i}", spark_type(a, udts)) for i, a in enumerate(t.args, 1)])
    if t.name == "udt":
        low = t.label.lower().rpartition(".")[2]
        if low not in (udts or {}):
            raise SchemaProblem(f"unknown type {t.label}")
        return udts[low]
    if t.name == "custom":
        return T.BinaryType()
    return SCALARS[t.name]


def field(name: str, t: CqlType, udts: dict[str, T.StructType] | None = None, nullable: bool = True) -> T.StructField:
    """A column with its type; metadata says what the Spark type alone does not."""
    meta = {"cql": str(t)}
    if t.bare.name == "set":
        meta["set"] = True
    if t.name == "frozen":
        meta["frozen"] = True
    if t.bare.name == "counter":
        meta["counter"] = True
    return T.StructField(name, spark_type(t, udts), nullable, meta)


def from_spark(t: T.DataType) -> CqlType:
    """The nearest type for a Spark type; for tables that come without a schema."""
    if isinstance(t, T.ArrayType):
        return CqlType("list", (from_spark(t.elementType),))
    if isinstance(t, T.MapType):
        return CqlType("map", (from_spark(t.keyType), from_spark(t.valueType)))
    if isinstance(t, T.StructType):
        return CqlType("tuple", tuple(from_spark(f.dataType) for f in t.fields))
    simple = {"boolean": "boolean", "tinyint": "tinyint", "smallint": "smallint", "int": "int", "bigint": "bigint", "float": "float", "double": "double", "string": "text", "binary": "blob", "date": "date", "timestamp": "timestamp", "timestamp_ntz": "timestamp"}
    if isinstance(t, T.DecimalType):
        return CqlType("varint" if t.scale == 0 else "decimal")
    return CqlType(simple.get(t.simpleString(), "text"))


def default_value(t: CqlType):
    """The value that stands in for a missing one; collections are empty, what has no natural zero is None."""
    b = t.bare
    return [] if b.name in ("list", "set") else {} if b.name == "map" else DEFAULTS.get(b.name)


def check_value(t: CqlType, value, udts: dict[str, T.StructType] | None = None, path: str = "value") -> None:
    """Raise unless a Python value fits: one type in a collection, no nulls inside, no repeats in sets or keys."""
    b = t.bare
    if value is None:
        return
    if b.name in ("list", "set", "vector"):
        if any(v is None for v in value):
            raise SchemaProblem(f"{path}: null inside a collection")
        if b.name == "set" and len({repr(v) for v in value}) != len(value):
            raise SchemaProblem(f"{path}: a set repeats a value")
        if b.name == "vector" and len(value) != b.size:
            raise SchemaProblem(f"{path}: {len(value)} values in a vector of {b.size}")
        for i, v in enumerate(value):
            check_value(b.args[0], v, udts, f"{path}[{i}]")
    elif b.name == "map":
        for k, v in value.items():
            if k is None or v is None:
                raise SchemaProblem(f"{path}: null inside a collection")
            check_value(b.args[0], k, udts, f"{path} key")
            check_value(b.args[1], v, udts, f"{path}[{k!r}]")
    elif b.name == "tuple":
        if len(value) != len(b.args):
            raise SchemaProblem(f"{path}: {len(value)} values in a tuple of {len(b.args)}")
        for i, (a, v) in enumerate(zip(b.args, value, strict=True)):
            check_value(a, v, udts, f"{path}.{i}")
    elif b.name in SCALARS:
        kinds = {"boolean": bool, "tinyint": int, "smallint": int, "int": int, "bigint": int, "counter": int, "text": str, "varchar": str, "ascii": str, "float": (int, float), "double": (int, float)}.get(b.name)
        if kinds and (not isinstance(value, kinds) or isinstance(value, bool) and b.name != "boolean"):
            raise SchemaProblem(f"{path}: {value!r} is no {b.name}")
        bits = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64, "counter": 64}.get(b.name)
        if bits and not -(1 << bits - 1) <= value < 1 << bits - 1:
            raise SchemaProblem(f"{path}: {value} does not fit {b.name}")
        if b.name == "ascii" and not value.isascii():
            raise SchemaProblem(f"{path}: not ASCII")
