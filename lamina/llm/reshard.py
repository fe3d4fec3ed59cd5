"""Resharding by minimum-cost flow (operator 9).

From the bytes that old shards hold and the capacities of new ones, a transport of least cost says how many bytes go from
where to where. Rows move in blocks: documents with equal texts are one unit; units above 1/64 of a shard, of which there can
only be 64 a shard, are planned one by one, all others by hash bucket of their old shard, so what the driver holds is bounded
by the numbers of shards and never by the rows. A group of equal texts stays whole unless it is larger than a shard; then it
is split by doc_id.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Blocks of an old shard: 9/10 of its bytes in COARSE, the rest in FINE ones, which level the shards.
COARSE, FINE = 160, 240
#: A unit is planned alone above 1/ALONE of a shard; a group of equal texts is split only if it
#: is larger than 1/WHOLE of a shard, that is if no shard can hold it. Pieces of a block that are numbered apart.
ALONE, WHOLE, PIECES = 64, 1, 64


def transport(supply: list[int], capacity: list[int], cost: np.ndarray) -> np.ndarray:
    """Flow [old, new] of least total cost that empties all supplies; successive shortest paths with potentials."""
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("the new shards cannot hold all bytes")
    flow, left, room = np.zeros((n, m), dtype=object), list(supply), list(capacity)
    pot_s, pot_t = [0.0] * n, [float(min(cost[i, j] for i in range(n))) if n else 0.0 for j in range(m)]
    while any(left):
        dist_s, dist_t = [0.0 if left[i] else np.inf for i in range(n)], [np.inf] * m
        from_t, from_s = [-1] * m, [-1] * n
        heap = [(0.0, 0, i) for i in range(n) if left[i]]
        done_s, done_t = [False] * n, [False] * m
        while heap:
            d, side, k = heapq.heappop(heap)
            if side == 0:
                if done_s[k]:
                    continue
                done_s[k] = True
                for j in range(m):
                    nd = d + cost[k, j] + pot_s[k] - pot_t[j]
                    if not done_t[j] and nd < dist_t[j] - 1e-12:
                        dist_t[j], from_t[j] = nd, k
                        heapq.heappush(heap, (nd, 1, j))
            else:
                if done_t[k]:
                    continue
                done_t[k] = True
                for i in range(n):
                    if flow[i, k] and not done_s[i]:
                        nd = d - cost[i, k] - pot_s[i] + pot_t[k]
                        if nd < dist_s[i] - 1e-12:
                            dist_s[i], from_s[i] = nd, k
                            heapq.heappush(heap, (nd, 0, i))
        goal = min((j for j in range(m) if room[j] and dist_t[j] < np.inf), key=lambda j: dist_t[j] + pot_t[j])  # true lengths: all starts have potential 0
        top = max(d for d in dist_s + dist_t if d < np.inf)
        for i in range(n):
            pot_s[i] += min(dist_s[i], top)
        for j in range(m):
            pot_t[j] += min(dist_t[j], top)
        path, j = [], goal
        while True:
            i = from_t[j]
            path.append((i, j, 1))
            if from_s[i] < 0:
                break
            j = from_s[i]
            path.append((i, j, -1))
        push = min([left[path[-1][0]], room[goal]] + [flow[i, j] for i, j, s in path if s < 0])
        for i, j, s in path:
            flow[i, j] += s * push
        left[path[-1][0]] -= push
        room[goal] -= push
    return flow


@dataclass
class Block:
    key: tuple
    old: int
    size: int
    rows: int
    new: int = -1
    base: int = 0


def place(blocks: list[Block], capacity: list[int], cost: np.ndarray) -> None:
    """Give each block its new shard: first along the flow, then small blocks level what whole blocks could not."""
    n, m = cost.shape
    supply = [0] * n
    for b in blocks:
        supply[b.old] += b.size
    flow = transport(supply, capacity, cost)
    load = [0] * m
    for b in sorted(blocks, key=lambda b: (-b.size, b.key)):
        row = flow[b.old]
        b.new = max(range(m), key=lambda j: (row[j], capacity[j] - load[j], -j))
        if row[b.new] < b.size:  # no flow holds it whole: where most room is
            b.new = max(range(m), key=lambda j: (min(row[j], b.size) + capacity[j] - load[j], -j))
        row[b.new] -= b.size
        load[b.new] += b.size
    own: list[list[Block]] = [[] for _ in range(m)]
    for b in blocks:
        own[b.new].append(b)
    for x in own:
        x.sort(key=lambda b: b.size)
    over = lambda j: load[j] - capacity[j]
    for _ in range(60 * m):
        order = sorted(range(m), key=over)
        if not any(_ease(own, load, order[-1], b, over(order[-1]) - over(b)) or _ease(own, load, a, order[0], over(a) - over(order[0])) for a, b in zip(reversed(order), order, strict=True) if a != b):
            break


def _ease(own: list[list[Block]], load: list[int], a: int, b: int, gap: int) -> bool:
    """Move a block from a to b, or swap two, so that the gap between them shrinks."""
    if gap < 2 or a == b:
        return False
    sa, sb = np.array([0] + [x.size for x in own[a]]), np.array([0] + [x.size for x in own[b]])
    want = sa[:, None] - gap / 2 if len(sb) > 1 else sa[:, None]
    at = np.clip(np.searchsorted(sb, want.ravel()), 0, len(sb) - 1)
    best = (abs(gap), 0, 0)
    for shift in (0, -1):
        k = np.clip(at + shift, 0, len(sb) - 1)
        rest = np.abs(gap - 2 * (sa - sb[k]))
        i = int(rest.argmin())
        best = min(best, (float(rest[i]), i, int(k[i])))
    if best[0] >= gap:
        return False
    _, i, k = best
    x, y = own[a][i - 1] if i else None, own[b][k - 1] if k else None
    for block, src, dst in ((x, a, b), (y, b, a)):
        if block is not None:
            own[src].remove(block)
            own[dst].append(block)
            block.new = dst
            load[src] -= block.size
            load[dst] += block.size
    own[a].sort(key=lambda v: v.size)
    own[b].sort(key=lambda v: v.size)
    return True


def _parts(text, doc_id, old_shards: int) -> list:
    """What planning needs of a row; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    h = F.xxhash64(text)
    return [doc_id.alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("__size"), F.crc32(text.cast("binary")).cast("long").alias("__crc"), h.alias("__h"), F.pmod(h, F.lit(old_shards)).cast("int").alias("__old"), _bucket(h).alias("__bucket")]


def _slim(docs: DataFrame, old_shards: int) -> DataFrame:
    return docs.select(*_parts(F.col("text"), F.col("doc_id"), old_shards))


def _bucket(h):
    u = F.pmod(F.xxhash64(h), F.lit(1 << 20))
    edge = (1 << 20) * 9 // 10
    return F.when(u < edge, F.floor(u * COARSE / edge)).otherwise(COARSE + F.floor((u - edge) * FINE / ((1 << 20) - edge))).cast("int")


@dataclass
class Plan:
    """alone: (hash, crc, size, piece) to (shard, block, base); buckets: (old shard, bucket) to the same; pieces of split groups."""

    alone: list[tuple]
    buckets: list[tuple]
    pieces: list[tuple]
    old_shards: int
    load: list[int]
    moved_bytes: int


def plan(docs: DataFrame, shards: int = 40, old_shards: int = 32, capacity: list[int] | None = None, cost: np.ndarray | None = None) -> Plan:
    """Plan shards of near equal bytes, or of the given capacities, moving the fewest bytes from the old layout."""
    units = _slim(docs, old_shards).groupBy("__h", "__crc", "__size", "__old", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    total = units.agg(F.sum(F.col("__n") * F.col("__size"))).first()[0] or 0
    capacity = capacity or [total // shards + (1 if j < total % shards else 0) for j in range(shards)]
    if cost is None:
        cost = np.array([[0 if i == j else 1 for j in range(shards)] for i in range(old_shards)])
    limit, whole = max(1, total // (shards * ALONE)), max(1, total // (shards * WHOLE))
    weight = F.col("__n") * F.col("__size")
    big = units.filter(weight > limit).collect()  # at most ALONE * shards: their bytes sum to the total
    split = [r for r in big if r["__n"] > 1 and r["__n"] * r["__size"] > whole]
    pieces = [(r["__h"], r["__crc"], r["__size"], int(min(r["__n"], -(-r["__n"] * r["__size"] // limit)))) for r in split]
    blocks = [Block(("a", r["__h"], r["__crc"], r["__size"], -1), r["__old"], r["__n"] * r["__size"], r["__n"]) for r in big if r not in split] if not split else []
    if split:
        keys = {(r["__h"], r["__crc"], r["__size"]) for r in split}
        blocks = [Block(("a", r["__h"], r["__crc"], r["__size"], -1), r["__old"], r["__n"] * r["__size"], r["__n"]) for r in big if (r["__h"], r["__crc"], r["__size"]) not in keys]
        rows = _with_piece(_slim(docs, old_shards), pieces).filter(F.col("__piece") >= 0)
        for r in rows.groupBy("__h", "__crc", "__size", "__old", "__piece").count().collect():  # WHOLE * shards groups of ALONE * shards pieces in all
            blocks.append(Block(("a", r["__h"], r["__crc"], r["__size"], r["__piece"]), r["__old"], r["count"] * r["__size"], r["count"]))
    rest = units.filter(weight <= limit).groupBy("__old", "__bucket").agg(F.sum(weight).alias("b"), F.sum("__n").alias("n"))
    blocks += [Block(("b", r["__old"], r["__bucket"]), r["__old"], int(r["b"]), int(r["n"])) for r in rest.collect()]  # (COARSE + FINE) * old_shards at most
    if sum(capacity) < total:
        raise ValueError("the new shards cannot hold all bytes")
    place(blocks, capacity, cost)
    filled, load = [0] * shards, [0] * shards
    for b in sorted(blocks, key=lambda b: b.key):
        b.base, filled[b.new], load[b.new] = filled[b.new], filled[b.new] + b.rows, load[b.new] + b.size
    named = [(b.key, (b.new, k, b.base)) for k, b in enumerate(sorted(blocks, key=lambda b: b.key))]
    moved = sum(b.size for b in blocks if b.new != b.old)
    return Plan([k[1:] + v for k, v in named if k[0] == "a"], [k[1:] + v for k, v in named if k[0] == "b"], pieces, old_shards, load, moved)


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))


def _with_piece(slim: DataFrame, pieces: list[tuple]) -> DataFrame:
    if not pieces:
        return slim.withColumn("__piece", F.lit(-1))
    table = _table(slim.sparkSession, pieces, "__h long, __crc long, __size long, __k int")
    piece = F.when(F.col("__k").isNotNull(), F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(0)), F.lit(3)), F.col("__k"))).otherwise(-1)
    return slim.join(table, ["__h", "__crc", "__size"], "left").withColumn("__piece", piece.cast("int")).drop("__k")


def _assign(slim: DataFrame, p: Plan) -> DataFrame:
    spark = slim.sparkSession
    alone = _table(spark, p.alone, "__h long, __crc long, __size long, __piece int, __s int, __id int, __base long")
    buckets = _table(spark, p.buckets, "__old int, __bucket int, __s2 int, __id2 int, __base2 long")
    rows = _with_piece(slim, p.pieces).join(alone, ["__h", "__crc", "__size", "__piece"], "left").join(buckets, ["__old", "__bucket"], "left")
    return rows.withColumns({"shard": F.coalesce("__s", "__s2"), "__block": F.coalesce("__id", "__id2"), "__first": F.coalesce("__base", "__base2")})


def assign(docs: DataFrame, p: Plan) -> DataFrame:
    """A row for each of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard, old_shard, moved.

    Null texts have size 16; rows may repeat and doc_id may be null. Equal texts share a shard unless they fill more than
    one. Slots are gapless from 0 in each shard; they are numbered within blocks, so no task sees a whole shard.
    """
    rows = _assign(_slim(docs, p.old_shards), p).withColumn("__piece", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(PIECES)).cast("int"))
    # Pieces of a block are counted, and each is numbered by itself from where the one before it ends.
    counts = rows.groupBy("__block", "__piece").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__block").orderBy("__piece")) - F.col("__n")
    starts = F.broadcast(counts.select("__block", "__piece", before.alias("__before")))  # PIECES for each block at most, and those are bounded
    rows = rows.join(starts, ["__block", "__piece"])
    rank = F.row_number().over(Window.partitionBy("__block", "__piece").orderBy("doc_id", "__crc", "__size")) + F.col("__before")
    return rows.select(
        "doc_id",
        F.col("__size").alias("size"),
        F.col("__crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("__first") + rank - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("__old").alias("old_shard"),
        (F.col("__old") != F.col("shard")).alias("moved"),
    )


def reshard(docs: DataFrame, p: Plan) -> DataFrame:
    """``docs`` with shard, old_shard and shard_moved; no row is shuffled.

    Columns of these names are replaced, all others stay as they are, whatever their names. Null texts count as empty, rows that
    repeat share a shard, an empty table gives an empty table.
    """
    base = docs.drop("shard", "old_shard", "shard_moved")
    aside = {c: f"__user{k}" for k, c in enumerate(base.columns)}  # no name of a user's column can meet one of the plan's
    text, doc_id = F.col(aside["text"]), F.col(aside["doc_id"])
    given = base.toDF(*aside.values())
    tagged = given.select("*", *_parts(text, doc_id, p.old_shards))
    out = _assign(tagged, p)
    return out.select(*[F.col(v).alias(c) for c, v in aside.items()], "shard", F.col("__old").alias("old_shard"), (F.col("__old") != F.col("shard")).alias("shard_moved"))


def rewrite(resharded: DataFrame, path: str) -> list[int]:
    """Write the shards that receive or lose rows under ``path``/shard=N; the others keep their files. Returns those written.

    New files are staged beside the shards, under a name that readers skip, and swapped in once all are there, so ``resharded``
    may read ``path`` itself. A shard that lost all its rows is gone afterwards.
    """
    spark = resharded.sparkSession
    moved = resharded.filter("shard_moved")
    touched = sorted({r[0] for r in moved.select("shard").union(moved.select("old_shard")).distinct().collect()})  # shards only
    if not touched:
        return touched
    stage = f"{path.rstrip('/')}/_stage-{uuid.uuid4().hex}"
    spread = F.pmod(F.xxhash64("text"), F.lit(8))
    resharded.filter(F.col("shard").isin(touched)).repartition("shard", spread).write.partitionBy("shard").parquet(f"{stage}/new")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at(f"{stage}/old"))
    for k in touched:
        for source, target in ((f"{path}/shard={k}", f"{stage}/old/shard={k}"), (f"{stage}/new/shard={k}", f"{path}/shard={k}")):
            if fs.exists(at(source)) and not fs.rename(at(source), at(target)):
                raise OSError(f"cannot move {source} to {target}; what is replaced is kept in {stage}/old")
    fs.delete(at(stage), True)
    return touched
