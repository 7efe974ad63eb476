"""K-d tree sharding in DataFrame operations alone.

Groups of equal texts are points whose weight is their bytes. The tree splits every node at its weighted median along the
metadata dimension that is widest there, until leaves reach the target bytes. A median is found without sorting: one
aggregate counts weights in equal intervals for all nodes at once, the next looks into the interval that holds the median,
until an interval's weight is within the tolerance. What reaches the driver is at most COUNTED rows each time, or 8 a node.

The tree is a table of cuts, one row a node; points descend it level by level through joins with the cuts of one level.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Intervals of a node at most, and of all nodes together.
BINS, COUNTED = 512, 1 << 19
#: Levels that points descend before they are written.
LEVELS = 4
#: A cut is taken once the interval around it holds at most this share of a shard's bytes.
TOLERANCE = 2e-4
#: Rows of a shard that are numbered in one window.
BLOCK_ROWS = 4000
#: Dimensions are stretched to 2**DIM_BITS steps, then 2**HASH_BITS by the group's hash, so that ties part evenly.
DIM_BITS, HASH_BITS = 30, 30
DIMS = ("d_size", "d_lang", "d_source", "d_doc")


def _text_size(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long")


def points(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each distinct text: its digest, weight in bytes and metadata."""
    have = set(docs.columns)
    meta = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")
    spread = lambda c: F.min(F.shiftrightunsigned(F.xxhash64(c), 34))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("sha"), (_text_size(F.col(text_col)) + 1).alias("size"), meta("lang").alias("lang"), meta("source").alias("source"))
    return rows.groupBy("sha").agg(F.sum("size").alias("weight"), F.min("size").alias("d_size"), spread("lang").alias("d_lang"), spread("source").alias("d_source"), F.coalesce(F.min("id"), F.lit(0)).alias("d_doc"))


def _ranked(rows: DataFrame, bounds: dict[str, tuple[int, int]]) -> DataFrame:
    """Each dimension as a whole number of DIM_BITS + HASH_BITS bits that orders the points with hardly any ties."""
    tie = F.shiftrightunsigned(F.xxhash64("sha"), 64 - HASH_BITS)
    out = []
    for d in DIMS:
        low, high = bounds[d]
        step = F.floor((F.col(d).cast("double") - low) / max(high - low, 1) * float((1 << DIM_BITS) - 1)).cast("long")
        out.append(step * F.lit(1 << HASH_BITS) + tie)
    return rows.select("sha", "weight", F.array(*out).alias("ranks"), F.lit(1).cast("long").alias("node"))


def _local(df: DataFrame, rows: list[dict], columns: str) -> DataFrame:
    """Rows that the driver holds (one a node of the tree at most) as a literal of the plan, to be broadcast."""
    said = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{columns}>>")
    return F.broadcast(df.sparkSession.range(1).select(F.explode(said).alias("x")).select("x.*"))


def _rank(dim: str) -> Column:
    return F.element_at("ranks", F.col(dim) + 1)


def _descended(rows: DataFrame, cuts: dict[int, tuple[int, int]]) -> DataFrame:
    """One level down: points of a node with a cut go to its children, 2k below the cut and 2k + 1 from it on."""
    table = _local(rows, [{"node": k, "dim": d, "cut": c} for k, (d, c) in cuts.items()], "node:bigint,dim:int,cut:bigint")
    child = F.col("node") * 2 + F.when(_rank("dim") < F.col("cut"), 0).otherwise(1)
    return rows.join(table, "node", "left").select("sha", "weight", "ranks", F.when(F.col("cut").isNull(), F.col("node")).otherwise(child).alias("node"))


def _medians(rows: DataFrame, goals: dict[int, float], total: float, tolerance: float) -> dict[int, tuple[int, int]]:
    """For each node of goals, its widest dimension and the cut that leaves the goal's share of its weight below."""
    level = rows.join(_local(rows, [{"node": k} for k in goals], "node:bigint"), "node")
    spans = level.groupBy("node").agg(*[f(F.element_at("ranks", i + 1)).alias(f"{n}_{i}") for i in range(len(DIMS)) for n, f in (("min", F.min), ("max", F.max))], F.sum("weight").alias("w")).collect()
    state = {}
    for r in spans:
        dim = max(range(len(DIMS)), key=lambda i: r[f"max_{i}"] - r[f"min_{i}"])
        state[r["node"]] = [dim, r[f"min_{dim}"], r[f"max_{dim}"] + 1, 0, goals[r["node"]] * r["w"]]
    done: dict[int, tuple[int, int]] = {}
    while open_ := {k: s for k, s in state.items() if k not in done}:
        bins = max(8, min(BINS, COUNTED // len(open_)))
        widths = {k: max(1, math.ceil((high - low) / bins)) for k, (_, low, high, _, _) in open_.items()}
        table = _local(rows, [{"node": k, "dim": d, "low": low, "high": high, "width": widths[k]} for k, (d, low, high, _, _) in open_.items()], "node:bigint,dim:int,low:bigint,high:bigint,width:bigint")
        near = rows.join(table, "node").filter((_rank("dim") >= F.col("low")) & (_rank("dim") < F.col("high")))
        counted: dict[int, dict[int, int]] = {k: {} for k in open_}
        for r in near.groupBy("node", F.expr("(element_at(ranks, dim + 1) - low) div width").alias("bin")).agg(F.sum("weight").alias("w")).collect():
            counted[r["node"]][r["bin"]] = r["w"]
        for k, (dim, low, high, below, goal) in open_.items():
            width = widths[k]
            for b, w in sorted(counted[k].items()):
                if below + w >= goal:
                    break
                below += w
            else:
                done[k] = (dim, high)
                continue
            start = low + b * width
            if width == 1 or w <= tolerance * total:
                # Before or after this interval, whichever is nearer.
                done[k] = (dim, start if goal - below < below + w - goal else start + width)
            else:
                state[k][1:4] = [start, min(start + width, high), below]
    return done


def kd_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", target_bytes: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """One row for each distinct text: sha and shard. With target_bytes, as many shards as the total needs.

    A node with s shards below it gives floor(s/2) of them to its left child and that share of its bytes.
    """
    table = written(points(docs, id_col, text_col), "kd-points")
    ends = table.agg(F.sum("weight").alias("w"), *[f(d).alias(f"{n}_{d}") for d in DIMS for n, f in (("min", F.min), ("max", F.max))]).first()
    total = ends["w"] or 0
    if target_bytes:
        shards = max(1, math.ceil(total / target_bytes))
    # A group heavier than a fair share of what is left has a shard of its own; there are fewer of those than shards.
    alone, left = [], total
    for r in table.orderBy(F.col("weight").desc(), "sha").limit(shards - 1).collect() if shards > 1 else ():
        if r["weight"] * (shards - len(alone)) <= left or len(alone) == shards - 1:
            break
        alone.append(r["sha"])
        left -= r["weight"]
    solo, shards = len(alone), shards - len(alone)
    own = _local(table, [{"sha": sha, "shard": i} for i, sha in enumerate(alone)], "sha:string,shard:int")
    rest = table.join(own, "sha", "left_anti") if alone else table
    rows = _ranked(rest, {d: (ends[f"min_{d}"] or 0, ends[f"max_{d}"] or 0) for d in DIMS})
    below, leaves, depth = {1: shards}, {}, 0
    while below:
        leaves |= {k: n for k, n in below.items() if n == 1}
        wide = {k: n for k, n in below.items() if n > 1}
        if wide:
            found = _medians(rows, {k: (n // 2) / n for k, n in wide.items()}, left / shards, tolerance)
            rows = _descended(rows, {k: found.get(k, (0, 0)) for k in wide})
            depth += 1
            if depth % LEVELS == 0:
                rows = written(rows, "kd-nodes")
        below = {c: m for k, n in wide.items() for c, m in ((2 * k, n // 2), (2 * k + 1, n - n // 2))}
    numbers = _local(rows, [{"node": k, "shard": solo + i} for i, k in enumerate(sorted(leaves, key=lambda k: f"{k:b}"))], "node:bigint,shard:int")
    placed = rows.join(numbers, "node").select("sha", "shard")
    return placed.unionByName(table.join(own, "sha").select("sha", "shard")) if alone else placed


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", target_bytes: int | None = None) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Shards are near equal in bytes (law `bytes`), as near as whole groups of equal texts allow: such a group is never
    parted, so one that is larger than a shard fills one by itself and the rest stay near equal among the others.
    size counts the UTF-8 bytes of a text plus 1; null counts as empty. Slots number the rows of each shard from 0, by
    doc_id within numbered blocks; rows that repeat an id get slots of their own. An empty table gives no rows.
    """
    placed = kd_shards(docs, shards, id_col, text_col, target_bytes)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(text, 256).alias("sha"), (_text_size(F.col(text_col)) + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    table = written(rows.join(placed, "sha").select("doc_id", "size", "text_crc32", "shard"), "kd-rows")
    # Blocks of a shard by the id's hash: counts of blocks are summed before them, rows are numbered within them.
    blocks = max(1, table.count() // BLOCK_ROWS)
    block = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(blocks))
    counts = table.groupBy("shard", block.alias("block")).agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "block", (F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")).alias("before"))
    within = table.withColumn("block", block).withColumn("at", F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32")))
    return within.join(before, ["shard", "block"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("at") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
