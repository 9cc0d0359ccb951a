"""Sharding by Karmarkar-Karp differencing.

Rows of equal text form a group that stays whole.  Every partition of about ``TASK_GROUPS`` groups is differenced on its own: each
group starts as a partial partition with one filled bin, and the two partials of largest spread are combined,
fullest bin with emptiest, until one is left.  Each partition of groups so yields one partial of as many sums as
there are shards; the driver combines those in the same way and receives numbers only, as many as partitions
times shards.

Defined cases: a null text has size 1 and CRC 0 and groups with other nulls and with the empty text; null ids
are rows like others; repeated rows are rows of their own; other columns are ignored; an empty table gives none.
A group of more than a shard's share still stays whole; the other shards then share what is left.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluvia.llm.common import per_task, stored

SHARDS = 8
#: Groups of equal texts that one task differences, about: a group takes it 1.7 KB.
TASK_GROUPS = 50_000
#: Rows of one numbering bucket.
BUCKET_ROWS = 20_000


def differencing(sums: list[list[int]]) -> list[list[int]]:
    """Combine partial partitions, each given by its bins' sums; for each of them its bins' final places."""
    k = len(sums[0]) if sums else 0
    # A heap entry: negative spread, number, its sums in falling order, and for each of those the (partial, bin)s inside, as a tree.
    heap: list = []
    for i, bins in enumerate(sums):
        order = sorted(range(k), key=lambda b: (-bins[b], b))
        heap.append((bins[order[-1]] - bins[order[0]], i, [bins[b] for b in order], [(i, b) for b in order]))
    heapq.heapify(heap)
    new = len(heap)
    while len(heap) > 1:
        _, _, a, in_a = heapq.heappop(heap)
        _, _, b, in_b = heapq.heappop(heap)
        joined = sorted(((a[j] + b[k - 1 - j], j) for j in range(k)), key=lambda x: (-x[0], x[1]))
        trees = [((in_a[j], in_b[k - 1 - j]),) for _, j in joined]
        heapq.heappush(heap, (joined[-1][0] - joined[0][0], new, [s for s, _ in joined], trees))
        new += 1
    places = [[0] * k for _ in sums]
    for place, tree in enumerate(heap[0][3] if heap else []):
        stack = [tree]
        while stack:
            x = stack.pop()
            if len(x) == 1:
                stack.extend(x[0])
            else:
                places[x[0]][x[1]] = place
    return places


def balanced(df: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row of ``doc_id, text``: byte sums per shard near equal, equal texts together."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = df.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.md5(text)).alias("text_key"),
    )
    groups = stored(rows.groupBy("text_key").agg(F.sum("size").alias("bytes")), "text-groups")
    # A task's partials are Python objects, so their number is bounded whatever the partitions' bytes are.
    dealt = groups.repartition(max(1, -(-groups.count() // TASK_GROUPS)), "text_key")

    def local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        keys, sizes = [], []
        for batch in batches:
            keys += batch.column("text_key").to_pylist()
            sizes += batch.column("bytes").to_pylist()
        # Of groups of one size any order is as good; the key makes it the same on a repeat.
        order = sorted(range(len(keys)), key=lambda i: (-sizes[i], keys[i]))
        places = differencing([[sizes[i]] + [0] * (shards - 1) for i in order])
        for at in range(0, len(order), 10_000):
            own = order[at : at + 10_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([keys[i] for i in own], pa.binary()), pa.array([sizes[i] for i in own], pa.int64()), pa.array([part] * len(own), pa.int32()), pa.array([p[0] for p in places[at : at + 10_000]], pa.int32())],
                ["text_key", "bytes", "part", "bin"],
            )

    placed = stored(dealt.mapInArrow(per_task(local), "text_key binary, bytes long, part int, bin int"), "shard-groups")
    # One row a partition and bin: their number is set by the partitioning, not by the groups.
    sums: dict[int, list[int]] = {}
    for part, at, n in placed.groupBy("part", "bin").agg(F.sum("bytes").alias("n")).collect():
        sums.setdefault(part, [0] * shards)[at] = n
    parts = sorted(sums)
    final = differencing([sums[p] for p in parts])
    moved = df.sparkSession.createDataFrame([(p, b, s) for p, places in zip(parts, final, strict=True) for b, s in enumerate(places)], "part int, bin int, shard int")
    shard_of = placed.join(F.broadcast(moved), ["part", "bin"]).select("text_key", "shard")
    return numbered(rows.join(shard_of, "text_key").drop("text_key"))


def numbered(rows: DataFrame) -> DataFrame:
    """Add ``slot``, gapless from 0 in each shard: buckets of rows are numbered apart, behind the counts of the buckets before."""
    held = stored(rows, "shard-rows")
    buckets = max(1, -(-held.count() // BUCKET_ROWS))
    bucketed = held.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(buckets)).cast("int"))
    counts = bucketed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    over = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("before", F.coalesce(F.sum("n").over(over), F.lit(0))).drop("n")
    own = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    return (
        bucketed.withColumn("rank", F.row_number().over(own) - 1)
        .join(starts, ["shard", "bucket"])
        .withColumn("slot", (F.col("before") + F.col("rank")).cast("long"))
        .drop("bucket", "before", "rank")
    )
