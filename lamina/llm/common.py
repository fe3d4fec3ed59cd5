"""What several operators share: settings, shipping of the package, row digests and polynomial hashes."""

from __future__ import annotations

import gc
import io
import os
import re
import uuid
import zipfile
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd base of the polynomial hashes modulo 2**64, and of a second one that checks the first.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def ship(spark: SparkSession) -> SparkSession:
    """Give executors this package, once per context; a cluster need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_lamina_shipped", False):
        return spark
    import tempfile

    import lamina

    root = os.path.dirname(os.path.abspath(lamina.__file__))
    folder = tempfile.mkdtemp(prefix="lamina-")
    path = os.path.join(folder, "lamina_pkg.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for at, dirs, names in os.walk(root):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(at, n)
                    z.write(full, os.path.join("lamina", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._lamina_shipped = True
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions; the session sets them by the size of the input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a local master, as in tests, gets a folder of its own where none is set."""
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="lamina-checkpoint-")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


#: Shuffle partitions that a task of a table of short rows takes together.
TOGETHER = 16


def cut(df: DataFrame, short: bool = False) -> DataFrame:
    """The same rows with their lineage cut: a table in the shared checkpoint folder, until ``drop``.

    ``short``: rows of a few numbers that come from shuffles of such rows; their partitions are written TOGETHER, not each as a
    task and a file. Hadoop starts processes for each file it makes on a local disk, which for a moment count the JVM's memory twice.

    A checkpoint would keep the plan's estimate of its size; in a loop of joins that is a product of products, whose digits
    double each time until they fill the driver. A table's size is that of its files.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    few = max(2 * spark.sparkContext.defaultParallelism, partitions(spark) // TOGETHER)
    (df.coalesce(few) if short else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lamina_table = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Delete tables that ``cut`` wrote and that nothing reads any more; other frames are left alone."""
    for t in tables:
        path = getattr(t, "_lamina_table", None)
        if path:
            at = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of one's own that no column of ``df`` has."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


#: Ids of 8 bytes that are broadcast at most, some 100 MB as a hashed relation; beyond, ids meet rows by a shuffle.
FEW_IDS = 2_000_000


def having(rows: DataFrame, ids: DataFrame, key: str, most: int = FEW_IDS) -> DataFrame:
    """Rows whose key is among ``ids`` (a kept table of distinct ids, counted first)."""
    few = ids.limit(most + 1).count() <= most
    return rows.join(F.broadcast(ids) if few else ids, key, "left_semi")


def release(spark: SparkSession) -> None:
    """Let the driver drop what finished rounds leave: plans, broadcasts and the executors' shuffle files."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def held_out(doc_id):
    """True for rows that are never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def encode(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    have = _TABLES.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 16)
        inverse = pow(base, -1, 1 << 64)
        with np.errstate(over="ignore"):
            up, down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, x, np.uint64)]), dtype=np.uint64) for x in (np.uint64(base), np.uint64(inverse)))
        have = _TABLES[base] = (up, down)
    return have


def prefix_hashes(codes: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """H with H[j] - H[i] the sum of codes[k] * base**k over i <= k < j, modulo 2**64."""
    up, _ = _tables(base, len(codes) + 1)
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[: len(codes)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """Hashes of the spans, the same wherever they begin."""
    _, down = _tables(base, len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_codes(seed: int = 1) -> np.ndarray:
    """A random 64-bit code for each byte."""
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays as one compressed block; bytes of equal weight stand together, which compresses well."""
    import zstandard

    out = io.BytesIO()
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b""
        head = f"{name}:{a.dtype.str}:{len(a)}\n".encode()
        out.write(head + planes)
    return zstandard.ZstdCompressor(level=1).compress(out.getvalue())


def unpack(block: bytes) -> dict[str, np.ndarray]:
    import zstandard

    data, at, out = zstandard.ZstdDecompressor().decompress(block), 0, {}
    while at < len(data):
        end = data.index(b"\n", at)
        name, kind, n = data[at:end].decode().split(":")
        kind, n, at = np.dtype(kind), int(n), end + 1
        size = n * kind.itemsize
        planes = np.frombuffer(data, np.uint8, size, at).reshape(kind.itemsize, n)
        out[name] = np.ascontiguousarray(planes.T).reshape(-1).view(kind) if n else np.zeros(0, kind)
        at += size
    return out
