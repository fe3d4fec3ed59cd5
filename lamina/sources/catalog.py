"""Tables by name: views over DataFrames, and stored tables made of generations."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column as C
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina import types as L
from lamina.errors import QueryProblem
from lamina.operators.compaction import Generation, choose
from lamina.schema import Column, TableSpec, TypeRegistry
from lamina.schema import from_json as spec_from_json

#: Columns that a generation adds to the table's own. __set names the cells a row writes, with an empty name for the row itself;
#: __gen is the generation that a merged row comes from, null for the one it stands in.
META = [T.StructField("__wt", T.LongType()), T.StructField("__expires", T.LongType()), T.StructField("__set", T.ArrayType(T.StringType())), T.StructField("__kind", T.StringType()), T.StructField("__gen", T.LongType())]
#: Before all times.
NEVER = -(1 << 62)


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str) -> list[str]:
    at, fs = _fs(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


@dataclass
class Stored:
    """A declared table: generations of upserts and deletes, merged when read.

    With a path it outlives its session: each generation is a folder gen-N of Parquet, and _manifest/V.json, of which the highest
    V counts, holds the schema and the generations that are live. Numbers of folders are never used again, and folders that are
    no longer live go only after the manifest without them is there.
    """

    spark: SparkSession
    spec: TableSpec
    registry: TypeRegistry
    generations: dict[int, DataFrame] = field(default_factory=dict)
    path: str | None = None
    ranges: bool = False
    compaction: str | None = None

    @property
    def udts(self) -> dict[str, T.StructType]:
        return self.registry.structs(self.spec.keyspace)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in self.spec.struct(self.udts)])

    @property
    def full(self) -> T.StructType:
        """The table's columns, META, and for each clustering column the interval that a range delete covers."""
        kinds = {f.name: f.dataType for f in self.schema}
        interval = lambda k: T.StructType([T.StructField("lo", k), T.StructField("lo_in", T.BooleanType()), T.StructField("hi", k), T.StructField("hi_in", T.BooleanType())])
        bounds = [T.StructField("__range", T.StructType([T.StructField(c, interval(kinds[c])) for c in self.spec.clustering_key]))] if self.spec.clustering_key else []
        return T.StructType([*self.schema, *META, *bounds])

    # ------------------------------------------------------------ on disk

    @classmethod
    def open(cls, spark: SparkSession, path: str, registry: TypeRegistry) -> Stored:
        """The table that lies under a path, with the types it needs."""
        manifests = sorted(n for n in _names(spark, f"{path}/_manifest") if n.endswith(".json"))
        if not manifests:
            raise QueryProblem(f"no stored table under {path}")
        m = json.loads(spark.read.text(f"{path}/_manifest/{manifests[-1]}", wholetext=True).first()[0])
        for name, fields in m["types"]:
            if name not in registry.names(m["schema"]["keyspace"]):
                registry.register(m["schema"]["keyspace"], name, dict(fields))
        out = cls(spark, spec_from_json(json.dumps(m["schema"]), registry.names(m["schema"]["keyspace"])), registry, {}, path, m["ranges"], m.get("compaction"))
        out.generations = {n: out._read(n) for n in m["generations"]}
        return out

    def _read(self, number: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/gen-{number}")

    def _manifest(self) -> None:
        """Write down what is live; a version that another session has just written is not replaced."""
        space = self.spec.keyspace
        order = sorted(self.registry.names(space), key=lambda n: (len(self.registry.dependencies(space, n)), n))
        text = json.dumps({"schema": spec_json(self.spec), "types": [[n, [[f, str(t)] for f, t in self.registry.fields(space, n).items()]] for n in order], "generations": sorted(self.generations), "ranges": self.ranges, "compaction": self.compaction})
        have = [int(n[:-5]) for n in _names(self.spark, f"{self.path}/_manifest") if n.endswith(".json")]
        at, fs = _fs(self.spark, f"{self.path}/_manifest/{max(have, default=0) + 1:010d}.json")
        out = fs.create(at, False)
        out.write(bytearray(text.encode()))
        out.close()

    def _number(self) -> int:
        """The next generation: above all that are or ever were there."""
        there = [int(n[4:]) for n in _names(self.spark, self.path) if n.startswith("gen-") and n[4:].isdigit()] if self.path else []
        return max([*there, *self.generations, getattr(self, "_last", 0)], default=0) + 1

    def _store(self, rows: DataFrame, number: int) -> DataFrame:
        """Rows laid out by key: dealt by partition key, in clustering order, with bloom filters on the key."""
        from lamina.sources.sinks import write_table

        write_table(rows, self.spec, f"{self.path}/gen-{number}", mode="errorifexists")
        return self._read(number)

    def replace_all(self, generations: dict[int, DataFrame]) -> None:
        """Other generations instead; on disk the folders of the old ones go once the new manifest stands."""
        gone = set(self.generations) - set(generations)
        self._last = max([*self.generations, getattr(self, "_last", 0)], default=0)
        self.generations = generations
        if self.path:
            self._manifest()
            for n in gone:
                at, fs = _fs(self.spark, f"{self.path}/gen-{n}")
                fs.delete(at, True)

    def remove(self) -> None:
        """Delete the table's folder."""
        if self.path:
            at, fs = _fs(self.spark, self.path)
            fs.delete(at, True)

    def altered(self, spec: TableSpec, change=None) -> None:
        """Another schema; ``change`` of the rows is written at once, as the files would still be of the old one."""
        self.spec = spec
        if change:
            moved = {n: change(df) for n, df in self.generations.items()}
            if self.path and moved:
                self.generations, gone = moved, dict(self.generations)
                number = self._number()
                rows = self._store(self.versions(), number)
                self.generations = gone
                self.replace_all({number: rows})
                return
            self.generations = moved
        if self.path:
            self._manifest()

    # ------------------------------------------------------------ writes

    def append(self, rows: DataFrame) -> int:
        """A new generation; with a path it is written there and read back."""
        number = self._number()
        have = set(rows.columns)
        rows = rows.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.full])
        self.generations[number] = self._store(rows, number) if self.path else rows
        if self.path:
            self._manifest()
        return number

    def due(self) -> list[int]:
        """The generations that the table's strategy would merge next; the sizes are those of the files."""
        if not self.path or not self.compaction:
            return []
        sized = []
        for n in self.generations:
            at, fs = _fs(self.spark, f"{self.path}/gen-{n}")
            sized.append(Generation(n, fs.getContentSummary(at).getLength()))
        return [g.number for g in choose(sized, self.compaction)]

    # ------------------------------------------------------------ reads

    def versions(self) -> DataFrame:
        full, out = self.full, None
        for number, df in sorted(self.generations.items()):
            have = set(df.columns)
            df = df.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in full])
            df = df.withColumn("__gen", F.coalesce("__gen", F.lit(number).cast("long")))
            out = df if out is None else out.unionByName(df)
        return out if out is not None else self.spark.createDataFrame([], full)

    def _covered(self, ranges: C) -> C:
        """The newest of a partition's range deletes that covers the row."""

        def inside(r: C) -> C:
            tests = []
            for c in self.spec.clustering_key:
                lo, hi = r["range"][c]["lo"], r["range"][c]["hi"]
                tests.append(F.coalesce((F.col(c) > lo) | r["range"][c]["lo_in"] & (F.col(c) == lo), lo.isNull()))
                tests.append(F.coalesce((F.col(c) < hi) | r["range"][c]["hi_in"] & (F.col(c) == hi), hi.isNull()))
            return reduce(lambda a, b: a & b, tests)

        return F.array_max(F.transform(F.filter(ranges, inside), lambda r: r["wt"]))

    def _winners(self, v: DataFrame) -> DataFrame:
        """For each key its cells' newest writes as structs (v, __wt, __expires, __gen), that of the row itself as __row, and what ``_dead`` needs."""
        spec = self.spec
        at = F.struct("__wt", "__gen")
        has = lambda c: (F.col("__kind") == "upsert") & F.array_contains("__set", c)
        stamp = ("__wt", "__expires", "__gen")
        aggs = [F.max(F.when(F.col("__kind") == "delete", F.col("__wt"))).alias("__dead"), F.max_by(F.struct(*stamp), F.when(has(""), at)).alias("__row")]
        for c in spec.regulars:
            if self._counter(c):
                aggs.append(F.sum(F.when(has(c), F.col(c))).alias(f"__v_{c}"))
            else:
                aggs.append(F.max_by(F.struct(F.col(c).alias("v"), *stamp), F.when(has(c), at)).alias(f"__v_{c}"))
        rows = v.filter(F.col("__kind").isin("upsert", "delete")).groupBy(*spec.key).agg(*aggs)
        wiped = v.filter(F.col("__kind").isin("wipe", "range")).groupBy(*spec.partition_key)
        facts = [F.max(F.when(F.col("__kind") == "wipe", F.col("__wt"))).alias("__wiped")]
        if self.ranges:
            facts.append(F.collect_list(F.when(F.col("__kind") == "range", F.struct(F.col("__wt").alias("wt"), F.col("__range").alias("range")))).alias("__ranges"))
        return rows.join(wiped.agg(*facts), list(spec.partition_key), "left")

    def _dead(self) -> C:
        """When a row of ``_winners`` was last deleted. An expression and no column: aliases make Spark's constraints of filters above explode."""
        return F.greatest(*[F.coalesce(x, F.lit(NEVER)) for x in (F.col("__dead"), F.col("__wiped"), *([self._covered(F.col("__ranges"))] if self.ranges else []))])

    def _counter(self, c: str) -> bool:
        return self.spec.column(c).type.bare.name == "counter"

    def _statics(self, v: DataFrame) -> DataFrame:
        """For each partition its static cells' newest writes as structs __s_c, and __wiped."""
        at, part = F.struct("__wt", "__gen"), list(self.spec.partition_key)
        own = v.filter(F.col("__kind").isin("upsert", "static")).groupBy(*part).agg(*[F.max_by(F.struct(F.col(c).alias("v"), "__wt", "__expires", "__gen"), F.when(F.array_contains("__set", c), at)).alias(f"__s_{c}") for c in self.spec.statics])
        wiped = v.filter(F.col("__kind") == "wipe").groupBy(*part).agg(F.max("__wt").alias("__wiped"))
        return own.join(wiped, part, "left")

    @staticmethod
    def _lives(s: str, dead: C, now: int) -> C:
        return (F.col(f"{s}.__wt") > dead) & (F.col(f"{s}.__expires").isNull() | (F.lit(now) <= F.col(f"{s}.__expires")))

    def scan(self, now: int, times: bool = False) -> DataFrame:
        """The rows that are there at a time: for each cell the newest write that no later delete covers and that has not expired.

        One aggregation by key, with partial results before the shuffle, and a join with the deletes of whole partitions and of
        clustering ranges; another where the table has static columns. With ``times`` each regular column c comes with __time_c
        and __expires_c. The range deletes of one partition are held together; compaction drops them after the grace period.
        """
        spec = self.spec
        if not self.generations:
            return self.spark.createDataFrame([], self.schema)
        v = self.versions()
        rows = self._winners(v)
        dead = self._dead()
        lives = lambda s: self._lives(s, dead, now)
        out, cells = {}, [F.struct("__row.__wt", "__row.__expires")]
        for n in spec.regulars:
            if self._counter(n):
                out[n] = F.col(f"__v_{n}")
                cells.append(F.when(F.col(f"__v_{n}").isNotNull() & (dead < 0), F.struct(F.lit(-NEVER).alias("__wt"), F.lit(None).cast("long").alias("__expires"))))
            else:
                out[n] = F.when(lives(f"__v_{n}"), F.col(f"__v_{n}.v"))
                cells.append(F.when(F.col(f"__v_{n}.v").isNotNull(), F.struct(f"__v_{n}.__wt", f"__v_{n}.__expires")))
        # One test over an array: as a tree of AND and OR it would be multiplied out by Spark's optimizer.
        there = F.coalesce(F.exists(F.array(*cells), lambda c: (c["__wt"] > dead) & (c["__expires"].isNull() | (F.lit(now) <= c["__expires"]))), F.lit(False))
        more = [c for n in spec.regulars if times and not self._counter(n) for c in (F.when(lives(f"__v_{n}"), F.col(f"__v_{n}.__wt")).alias(f"__time_{n}"), F.when(lives(f"__v_{n}"), F.col(f"__v_{n}.__expires")).alias(f"__expires_{n}"))]
        rows = rows.filter(there).select(*spec.key, *[e.alias(n) for n, e in out.items()], *more)
        if spec.statics:
            wiped = F.coalesce("__wiped", F.lit(NEVER))
            s = self._statics(v).select(*spec.partition_key, *[F.when(self._lives(f"__s_{c}", wiped, now), F.col(f"__s_{c}.v")).alias(c) for c in spec.statics])
            rows = rows.join(s, list(spec.partition_key), "left")
        # cast puts the declared type and metadata back
        return rows.select(*[F.col(c.name).alias(c.name, metadata=f.metadata) for c, f in zip(spec.columns, self.schema, strict=True)], *([c for c in rows.columns if c.startswith("__")] if times else []))

    # ------------------------------------------------------------ compaction

    def _as_versions(self, df: DataFrame, cells: dict[str, str], dead: C, now: int, kind: str, key: list[str]) -> DataFrame:
        """Structs of winning writes as rows again, a row for each time of writing of a key: those that are alive."""
        stamps = F.array_distinct(F.array_compact(F.array(*[F.when(self._lives(s, dead, now), F.struct(f"{s}.__wt", f"{s}.__expires", f"{s}.__gen")) for s in cells.values()])))
        df = df.withColumn("__at", F.explode(stamps))
        mine = {c: F.coalesce(self._lives(s, dead, now) & F.struct(f"{s}.__wt", f"{s}.__expires", f"{s}.__gen").eqNullSafe(F.col("__at")), F.lit(False)) for c, s in cells.items()}
        values = [F.when(mine[c], F.col(f"{s}.v")).alias(c) for c, s in cells.items() if c]
        marks = F.array_compact(F.array(*[F.when(m, F.lit(c)) for c, m in mine.items()]))
        return df.select(*key, *values, "__at.*", marks.alias("__set"), F.lit(kind).alias("__kind"))

    def compacted(self, now: int, gc_grace_seconds: int = 864_000) -> DataFrame:
        """All generations as one that reads alike from ``now`` on.

        Each cell keeps its newest write only, and that only while it is alive: an expired or deleted one goes together with
        the older ones that it hid. Deletes stay for the grace period, for writes of earlier times that arrive late. Rows keep
        the generation they came from, which decides between equal times. Counters keep their sum.
        """
        spec, v = self.spec, self.versions()
        key, part = list(spec.key), list(spec.partition_key)
        winners = self._winners(v)
        cells = {"": "__row"} | {c: f"__v_{c}" for c in spec.regulars if not self._counter(c)}
        rows = self._as_versions(winners, cells, self._dead(), now, "upsert", key)
        if counters := [c for c in spec.regulars if self._counter(c)]:
            sums = winners.filter(reduce(lambda a, b: a | b, [F.col(f"__v_{c}").isNotNull() for c in counters]))
            rows = rows.unionByName(sums.select(*key, *[F.col(f"__v_{c}").alias(c) for c in counters], F.lit(NEVER + 1).alias("__wt"), F.lit(None).cast("long").alias("__expires"), F.lit(0).cast("long").alias("__gen"), F.array(*[F.lit(c) for c in counters]).alias("__set"), F.lit("upsert").alias("__kind")), allowMissingColumns=True)
        if spec.statics:
            rows = rows.unionByName(self._as_versions(self._statics(v), {c: f"__s_{c}" for c in spec.statics}, F.coalesce("__wiped", F.lit(NEVER)), now, "static", part), allowMissingColumns=True)
        young = v.filter(F.col("__wt") > now - gc_grace_seconds * 1_000_000)
        for kind, by in (("delete", key), ("wipe", part)):
            newest = young.filter(F.col("__kind") == kind).groupBy(*by).agg(F.max("__wt").alias("__wt"), F.max_by("__gen", "__wt").alias("__gen"))
            rows = rows.unionByName(newest.withColumn("__kind", F.lit(kind)), allowMissingColumns=True)
        if self.ranges:
            kept = young.filter(F.col("__kind") == "range").select(*part, "__wt", "__gen", "__kind", "__range")
            rows = rows.unionByName(kept, allowMissingColumns=True)
        return rows

    def compact(self, now: int, gc_grace_seconds: int = 864_000) -> None:
        """All generations into one."""
        if not self.generations:
            return
        number, full = self._number(), self.full
        merged = self.compacted(now, gc_grace_seconds)
        have = set(merged.columns)
        merged = merged.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in full])
        self.replace_all({number: self._store(merged, number) if self.path else merged.cache()})


class Catalog:
    """Keyspaces with their tables, views and types."""

    def __init__(self, spark: SparkSession):
        self.spark, self.registry, self.keyspace = spark, TypeRegistry(), "main"
        self.keyspaces = {"main"}
        self.tables: dict[str, Stored] = {}
        self.views: dict[str, tuple[DataFrame, TableSpec | None]] = {}
        self.indexes: dict[str, tuple[str, str, str]] = {}

    def full(self, name: str) -> str:
        return name.lower() if "." in name else f"{self.keyspace}.{name}".lower()

    def register(self, name: str, df: DataFrame, partition_key: list[str] | None = None, clustering_key: list = (), spec: TableSpec | None = None) -> None:
        """A DataFrame as a table. With a key, what needs one works: limits by partition, token(), clustering order."""
        if spec is None and partition_key:
            order = {k if isinstance(k, str) else k[0]: not isinstance(k, str) and k[1].upper() == "DESC" for k in clustering_key}
            role = lambda c: "partition" if c in partition_key else "clustering" if c in order else "regular"
            columns = tuple(Column(f.name, L.from_spark(f.dataType), role(f.name), order.get(f.name, False)) for f in df.schema)
            full = self.full(name)
            spec = TableSpec(full.partition(".")[0], full.partition(".")[2], columns, tuple(partition_key), tuple(order))
        self.views[self.full(name)] = (df, spec)

    def create(self, spec: TableSpec, path: str | None = None) -> Stored:
        """A new table; a path that already holds one is refused, ``open`` reads it."""
        full = f"{spec.keyspace}.{spec.name}".lower()
        if full in self.tables or full in self.views:
            raise QueryProblem(f"table {full} exists")
        if path and _names(self.spark, path):
            raise QueryProblem(f"{path} is not empty: open the table that lies there")
        out = Stored(self.spark, spec, self.registry, path=path, compaction=spec.options.get("compaction"))
        spec.struct(out.udts)  # unknown types fail here
        if path:
            out._manifest()
        self.tables[full] = out
        return out

    def open(self, path: str) -> Stored:
        """The stored table that lies under a path, by the name it has."""
        out = Stored.open(self.spark, path, self.registry)
        full = f"{out.spec.keyspace}.{out.spec.name}".lower()
        if full in self.tables or full in self.views:
            raise QueryProblem(f"table {full} exists")
        self.keyspaces.add(out.spec.keyspace.lower())
        self.tables[full] = out
        return out

    def stored(self, name: str) -> Stored:
        full = self.full(name)
        if full in self.views:
            raise QueryProblem(f"{name} is a view of data that this engine does not write")
        if full not in self.tables:
            raise QueryProblem(f"unknown table {name}")
        return self.tables[full]

    def find(self, name: str, now: int) -> tuple[DataFrame, TableSpec | None]:
        full = self.full(name)
        if full in self.views:
            return self.views[full]
        if full in self.tables:
            return self.tables[full].scan(now), self.tables[full].spec
        if full.endswith("system.tables") or name.lower() in ("system.tables", "system_schema.tables"):
            rows = [(k.partition(".")[0], k.partition(".")[2]) for k in sorted({*self.tables, *self.views})]
            return self.spark.createDataFrame(rows, "keyspace_name string, table_name string"), None
        raise QueryProblem(f"unknown table {name}")

    def spec(self, name: str) -> TableSpec | None:
        full = self.full(name)
        return self.views[full][1] if full in self.views else self.stored(name).spec

    def drop(self, name: str) -> bool:
        """Forget a table or view; a stored table's files go with it."""
        full = self.full(name)
        stored = self.tables.pop(full, None)
        if stored:
            stored.remove()
        return bool(stored or self.views.pop(full, None))

    def schema_json(self, name: str) -> str:
        s = self.spec(name)
        if s is None:
            raise QueryProblem(f"{name} has no declared key")
        return json.dumps(spec_json(s))


def spec_json(s: TableSpec) -> dict:
    """A table's schema as JSON holds it."""
    return {
        "keyspace": s.keyspace,
        "table": s.name,
        "partition_keys": [{"name": k, "type": str(s.column(k).type), "position": i} for i, k in enumerate(s.partition_key)],
        "clustering_keys": [{"name": k, "type": str(s.column(k).type), "position": i, "order": "DESC" if s.column(k).descending else "ASC"} for i, k in enumerate(s.clustering_key)],
        "columns": [{"name": c.name, "type": str(c.type), "nullable": c.nullable, "is_static": c.role == "static"} for c in s.columns],
    }
