"""Aggregation along receiver graphs by pointer doubling.

A node keeps a pointer and what its upstream nodes within 2^k links have sent.  A round sends every node's state
to its pointer's node and doubles the pointers, so a graph of depth d takes about log2 d rounds of one join and one
aggregation, instead of d.  Rounds are tables in the shared folder.

Sums upstream and first hits downstream are worked out inside tasks first, each of which holds stretches of neighbouring ids;
only the nodes that links from other tasks enter (gates) go through rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import PythonException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluvia.functions.session import ship_package
from fluvia.functions.tables import settled

#: Nodes of one task, about, whose links are followed in its memory.
TASK_NODES = 250_000
#: Doublings after which a graph must have a cycle.
MAX_ROUNDS = 48


class CycleError(ValueError):
    """The receiver graph has a cycle."""


def doubled(state: DataFrame, combine: dict[str, Callable[[Column, Column], Column]], gather: dict[str, Callable[[Column], Column]], along: dict[str, Callable[[Column, Column], Column]] | None = None, sent: dict[str, Column] | None = None) -> DataFrame:
    """Run doubling on ``state(cell_id, ptr, ...)``.

    ``gather[c]`` aggregates what arrives at a node in column c (from ``sent[c]`` of the senders, else their c), and
    ``combine[c](own, arrived)`` joins it to the node's own. ``along[c](own, next)`` joins a column over a link and the
    link after it.
    """
    along, sent = along or {}, sent or {}
    state = settled(state)
    for _ in range(MAX_ROUNDS):
        if not state.where("ptr is not null").limit(1).count():
            return state.drop("ptr", *along)
        arrived = state.where("ptr is not null").groupBy("ptr").agg(*[agg(sent.get(c, F.col(c))).alias(f"in_{c}") for c, agg in gather.items()]).withColumnRenamed("ptr", "at")
        merged = state.join(arrived, state["cell_id"] == arrived["at"], "left")
        values = {c: combine[c](F.col(c), F.col(f"in_{c}")).alias(c) for c in gather}
        after = state.select(F.col("cell_id").alias("next_id"), F.col("ptr").alias("next_ptr"), *[F.col(c).alias(f"next_{c}") for c in along])
        jumped = merged.join(after, merged["ptr"] == after["next_id"], "left")
        kept = [c for c in state.columns if c not in ("cell_id", "ptr", *gather, *along)]
        state = settled(jumped.select("cell_id", F.col("next_ptr").alias("ptr"), *kept, *values.values(), *[f(F.col(c), F.col(f"next_{c}")).alias(c) for c, f in along.items()]))
    raise CycleError("the receiver graph has a cycle")


def _links(cells: DataFrame, *bands: str) -> DataFrame:
    """Cells with pointers to receivers that are cells themselves."""
    ids = cells.select(F.col("cell_id").alias("_to"))
    rows = cells.select("cell_id", "receiver", *bands)
    return rows.join(ids, rows["receiver"] == ids["_to"], "left").select("cell_id", F.col("_to").alias("ptr"), *bands)


def _dealt(nodes: DataFrame, count: int) -> DataFrame:
    """Nodes dealt by stretches of ids, the same way for the same ``count``; any ids give parts of like sizes."""
    tasks = -(-count // TASK_NODES) or 1
    return nodes.repartition(tasks, F.floor(F.col("cell_id") / max(1, -(-count // tasks))))


def _inside(ids: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Places of ``to`` in rising ``ids``; -1 where absent."""
    at = np.minimum(np.searchsorted(ids, to), max(len(ids) - 1, 0))
    return np.where(ids[at] == to, at, -1) if len(ids) else np.full(len(to), -1)


def _held(batches: Iterable[pa.RecordBatch]) -> pa.Table | None:
    """A task's rows in order of cell_id."""
    rows = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(rows).combine_chunks().sort_by("cell_id") if rows else None


def _receivers(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, receivers, whether there is one)."""
    to = table.column("receiver").combine_chunks()
    return table.column("cell_id").to_numpy(), to.fill_null(0).to_numpy(zero_copy_only=False), to.is_valid().to_numpy(zero_copy_only=False)


def _ends(at: np.ndarray) -> np.ndarray:
    """Last node of each node's way along ``at``, which -1 ends."""
    end = np.where(at >= 0, at, np.arange(len(at)))
    for _ in range(MAX_ROUNDS):
        further = end[end]
        if (further == end).all():
            return end
        end = further
    raise CycleError("the receiver graph has a cycle")


def _local_sums(at: np.ndarray, values: list[np.ndarray]) -> list[np.ndarray]:
    """Each node's sum over itself and what lies upstream along ``at``."""
    ptr, values = at.copy(), [v.copy() for v in values]
    for _ in range(MAX_ROUNDS):
        on = np.flatnonzero(ptr >= 0)
        if not len(on):
            return values
        for v in values:
            more = np.zeros_like(v)
            np.add.at(more, ptr[on], v[on])
            v += more
        ptr[on] = ptr[ptr[on]]
    raise CycleError("the receiver graph has a cycle")


def _settled_unless_cyclic(df: DataFrame) -> DataFrame:
    """``settled``, with a cycle that a task has met as an error of the driver."""
    try:
        return settled(df)
    except PythonException as failed:
        if "the receiver graph has a cycle" in str(failed):
            raise CycleError("the receiver graph has a cycle") from failed
        raise


def upstream_sum(cells: DataFrame, *bands: str) -> DataFrame:
    """cell_id and for each band the sum over the cell and all cells upstream; nulls count as zero.

    A task sums along the links inside it. What leaves it enters the gates of others; gates form a forest of their own, whose sums
    are what enters, and a second pass adds it.
    """
    ship_package(cells.sparkSession)
    base = settled(cells.select("cell_id", "receiver", *[F.coalesce(F.col(b), F.lit(0)).alias(b) for b in bands]))
    count = base.count()
    kinds = {b: t for b, t in base.dtypes if b in bands}
    wide = {b: "double" if t in ("double", "float") else "bigint" for b, t in kinds.items()}
    sums_schema = ", ".join(["cell_id bigint", *[f"`{b}` {wide[b]}" for b in bands]])
    base = base.select(F.col("cell_id").cast("bigint").alias("cell_id"), F.col("receiver").cast("bigint").alias("receiver"), *[F.col(b).cast(wide[b]).alias(b) for b in bands])
    out_names = ["cell_id", *bands]

    def leaving(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _held(batches)
        if table is None:
            return
        ids, to, some = _receivers(table)
        at = np.where(some, _inside(ids, to), -1)
        sums = _local_sums(at, [table.column(b).to_numpy() for b in bands])
        out = np.flatnonzero(some & (at < 0))
        yield pa.RecordBatch.from_arrays([pa.array(to[out]), *(pa.array(v[out]) for v in sums)], out_names)

    entering = _settled_unless_cyclic(_dealt(base, count).mapInArrow(leaving, sums_schema).groupBy("cell_id").agg(*[F.sum(b).cast(wide[b]).alias(b) for b in bands]))
    if not entering.limit(1).count():
        gates = entering
    else:
        marked = base.select("cell_id", "receiver", F.lit(False).alias("_gate"), *[F.lit(0).cast(wide[b]).alias(b) for b in bands]).unionByName(entering.select("cell_id", F.lit(None).cast("bigint").alias("receiver"), F.lit(True).alias("_gate"), *bands))

        def following(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = _held(batches)
            if table is None:
                return
            gate = table.column("_gate").to_numpy()
            nodes, table = table.filter(pa.array(~gate)), table.filter(pa.array(gate))
            ids, to, some = _receivers(nodes)
            at = np.where(some, _inside(ids, to), -1)
            place = _inside(ids, table.column("cell_id").to_numpy())
            table, place = table.filter(pa.array(place >= 0)), place[place >= 0]
            end = _ends(at)[place]
            yield pa.RecordBatch.from_arrays([table.column("cell_id").combine_chunks(), pa.array(to[end], mask=~some[end]), *(table.column(b).combine_chunks() for b in bands)], ["cell_id", "receiver", *bands])

        ahead = settled(_dealt(marked, count).mapInArrow(following, sums_schema.replace("cell_id bigint", "cell_id bigint, receiver bigint", 1)))
        add = {b: lambda own, more: own + F.coalesce(more, F.lit(0)) for b in bands}
        gates = doubled(_links(ahead, *bands), add, {b: F.sum for b in bands})
    both = base.withColumn("_gate", F.lit(False)).unionByName(gates.select("cell_id", F.lit(None).cast("bigint").alias("receiver"), F.lit(True).alias("_gate"), *[F.col(b).cast(wide[b]).alias(b) for b in bands]))

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _held(batches)
        if table is None:
            return
        gate = table.column("_gate").to_numpy()
        nodes, table = table.filter(pa.array(~gate)), table.filter(pa.array(gate))
        ids, to, some = _receivers(nodes)
        at = np.where(some, _inside(ids, to), -1)
        place = _inside(ids, table.column("cell_id").to_numpy())
        values = []
        for b in bands:
            v = nodes.column(b).to_numpy().copy()
            np.add.at(v, place[place >= 0], table.column(b).to_numpy()[place >= 0])
            values.append(v)
        yield from pa.Table.from_arrays([pa.array(ids), *(pa.array(v) for v in _local_sums(at, values))], names=out_names).to_batches(max_chunksize=100_000)

    return _dealt(both, count).mapInArrow(summed, sums_schema)


def accumulation(cells: DataFrame) -> DataFrame:
    """cell_id, accumulation: cells upstream, the cell itself included."""
    return upstream_sum(cells.withColumn("accumulation", F.lit(1).cast("long")), "accumulation")


def upstream_max(cells: DataFrame, band: str) -> DataFrame:
    """cell_id and the band's largest value over the cell and all cells upstream."""
    return doubled(_links(cells, band), {band: lambda own, more: F.greatest(own, more)}, {band: F.max})


def composite_mean(cells: DataFrame, value: str, weight: float = 1.0) -> DataFrame:
    """cell_id, mean (weighted over present upstream values, null if none), covered: their summed weight."""
    rows = cells.withColumns({"_w": F.when(F.col(value).isNotNull(), F.lit(float(weight))).otherwise(0.0), "_v": F.coalesce(F.col(value) * weight, F.lit(0.0))})
    sums = upstream_sum(rows, "_v", "_w")
    return sums.select("cell_id", F.when(F.col("_w") > 0, F.col("_v") / F.col("_w")).alias("mean"), F.col("_w").alias("covered"))


def longest_paths(cells: DataFrame, z: str = "z", distance: str = "distance") -> DataFrame:
    """cell_id, length_m of the longest upstream path, drop_m from its head (at least 0). Of equal paths the higher head counts."""
    start = _links(cells, z, distance).select(
        "cell_id", "ptr", F.col(z).alias("z"), F.struct(F.lit(0.0).alias("length"), F.col(z).alias("head")).alias("best"), F.when(F.col("ptr").isNotNull(), F.col(distance)).alias("hop")
    )
    out = doubled(
        start,
        {"best": lambda own, more: F.greatest(own, more)},
        {"best": F.max},
        {"hop": lambda own, nxt: own + nxt},
        {"best": F.struct((F.col("best.length") + F.col("hop")).alias("length"), F.col("best.head").alias("head"))},
    )
    return out.select("cell_id", F.col("best.length").alias("length_m"), F.greatest(F.col("best.head") - F.col("z"), F.lit(0.0)).alias("drop_m"))


def levels(cells: DataFrame) -> DataFrame:
    """cell_id, level: links of the longest path from a head."""
    one = cells.withColumns({"_hop": F.lit(1.0), "_z": F.lit(0.0)})
    return longest_paths(one, "_z", "_hop").select("cell_id", F.col("length_m").cast("int").alias("level"))


def resolved(cells: DataFrame, found: Column, *labels: Column) -> DataFrame:
    """cell_id, target and labels of the first cell downstream, the cell itself included, where ``found`` holds; null if none."""
    ship_package(cells.sparkSession)
    names = [f"label{i}" for i in range(len(labels))]
    rows = settled(cells.select(F.col("cell_id").cast("bigint").alias("cell_id"), F.col("receiver").cast("bigint").alias("receiver"), F.coalesce(found, F.lit(False)).alias("_hit"), *[c.alias(n) for n, c in zip(names, labels, strict=True)]))
    kinds = dict(rows.dtypes)
    schema = ", ".join(["cell_id bigint", "ptr bigint", "target bigint", *[f"{n} {kinds[n]}" for n in names]])

    def followed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _held(batches)
        if table is None:
            return
        ids, to, some = _receivers(table)
        hit = table.column("_hit").to_numpy()
        end = _ends(np.where(some & ~hit, _inside(ids, to), -1))
        there = hit[end]
        labels_there = table.select(names).take(pa.array(np.where(there, end, 0), mask=~there)) if names else None
        columns = [pa.array(ids), pa.array(to[end], mask=there | ~some[end]), pa.array(ids[end], mask=~there), *(labels_there.column(n) for n in names)]
        yield from pa.Table.from_arrays(columns, names=["cell_id", "ptr", "target", *names]).to_batches(max_chunksize=100_000)

    whole = _settled_unless_cyclic(_dealt(rows, rows.count()).mapInArrow(followed, schema))
    gate_ids = whole.where("ptr is not null").select(F.col("ptr").alias("_gate")).distinct()
    state = settled(whole.join(gate_ids, whole["cell_id"] == gate_ids["_gate"]).drop("_gate"))
    for _ in range(MAX_ROUNDS):
        if not state.where("ptr is not null").limit(1).count():
            gates = state.select(F.col("cell_id").alias("_gate"), F.col("target").alias("_target"), *[F.col(n).alias(f"_{n}") for n in names])
            joined = whole.join(gates, whole["ptr"] == gates["_gate"], "left")
            return joined.select("cell_id", F.coalesce("target", "_target").alias("target"), *[F.coalesce(n, f"_{n}").alias(n) for n in names])
        after = state.select(F.col("cell_id").alias("next_id"), F.col("ptr").alias("next_ptr"), F.col("target").alias("next_target"), *[F.col(n).alias(f"next_{n}") for n in names])
        joined = state.join(after, state["ptr"] == after["next_id"], "left")
        state = settled(joined.select("cell_id", "next_ptr", F.coalesce("target", "next_target").alias("target"), *[F.coalesce(n, f"next_{n}").alias(n) for n in names]).withColumnRenamed("next_ptr", "ptr"))
    raise CycleError("the receiver graph has a cycle")


def roots(cells: DataFrame) -> DataFrame:
    """cell_id, root: the terminal cell downstream."""
    ids = cells.select(F.col("cell_id").alias("_to"))
    rows = cells.select("cell_id", "receiver").join(ids, F.col("receiver") == F.col("_to"), "left").select("cell_id", F.col("_to").alias("receiver"))
    return resolved(rows, F.col("receiver").isNull()).select("cell_id", F.col("target").alias("root"))


def height_above_drainage(cells: DataFrame, z: str = "z", river: str = "river") -> DataFrame:
    """cell_id, hand, reach: height above the first river cell downstream (at least 0) and that cell; null without one."""
    found = resolved(cells, F.col(river), F.col(z))
    own = cells.select("cell_id", F.col(z).alias("_z"))
    return own.join(found, "cell_id").select("cell_id", F.greatest(F.col("_z") - F.col("label0"), F.lit(0.0)).alias("hand"), F.col("target").alias("reach"))


def stream_links(cells: DataFrame, stream: str = "stream") -> DataFrame:
    """cell_id, link of every stream cell: the head or junction cell where its junction-to-junction run begins."""
    on = cells.where(stream).select("cell_id", "receiver")
    down = on.select(F.col("cell_id").alias("_to"))
    rows = on.join(down, on["receiver"] == down["_to"], "left").select("cell_id", F.col("_to").alias("receiver"))
    indegree = rows.where("receiver is not null").groupBy("receiver").agg(F.count(F.lit(1)).alias("n"), F.max("cell_id").alias("above")).withColumnRenamed("receiver", "at")
    # Upstream inside a run there is one cell, so a run is a forest whose root is its beginning.
    back = rows.join(indegree, rows["cell_id"] == indegree["at"], "left").select("cell_id", F.when(F.col("n") == 1, F.col("above")).alias("receiver"))
    return roots(back).select("cell_id", F.col("root").alias("link"))


def zones(cells: DataFrame, stream: str = "stream") -> DataFrame:
    """cell_id, zone: the link of the first stream cell downstream; null if none."""
    links = stream_links(cells, stream)
    labelled = cells.join(links, "cell_id", "left")
    return resolved(labelled, F.col("link").isNotNull(), F.col("link")).select("cell_id", F.col("label0").alias("zone"))


def reach_paths(cells: DataFrame, active: str = "river") -> DataFrame:
    """reach_id, seq, cell_id: runs from head or junction to the next junction or the end, both included.

    A junction cell ends the reaches that flow into it and begins its own.
    """
    on = cells.where(active).select("cell_id", "receiver")
    links = stream_links(on.withColumn("_on", F.lit(True)), "_on")
    seq = levels_within(on, links)
    member = seq.select("link", "hop", "cell_id")
    down = on.join(links.select(F.col("cell_id").alias("receiver"), F.col("link").alias("next_link")), "receiver")
    last = member.join(down.select("cell_id", "receiver", "next_link"), "cell_id").where("link <> next_link").select("link", (F.col("hop") + 1).alias("hop"), F.col("receiver").alias("cell_id"))
    out = member.unionByName(last)
    many = out.groupBy("link").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("link")
    return out.join(many, "link").select(F.col("link").alias("reach_id"), F.col("hop").cast("int").alias("seq"), "cell_id")


def levels_within(cells: DataFrame, links: DataFrame) -> DataFrame:
    """link, cell_id, hop: links from the beginning of a run."""
    rows = cells.join(links, "cell_id")
    next_link = links.select(F.col("cell_id").alias("_to"), F.col("link").alias("_next"))
    inside = rows.join(next_link, rows["receiver"] == next_link["_to"], "left").select("cell_id", "link", F.when(F.col("_next") == F.col("link"), F.col("receiver")).alias("receiver"))
    return inside.join(levels(inside), "cell_id").select("link", "cell_id", F.col("level").alias("hop"))


def descending_surface(cells: DataFrame, z: str, river: str, drop: float) -> DataFrame:
    """cell_id, surface: river cells lowered until each is at least ``drop`` below its upstream river cells."""
    on = cells.where(river).select("cell_id", "receiver", F.col(z).alias("z"))
    start = _links(on, "z").select("cell_id", "ptr", F.col("z").alias("surface"), F.when(F.col("ptr").isNotNull(), F.lit(float(drop))).alias("hop"))
    return doubled(start, {"surface": lambda own, more: F.least(own, more)}, {"surface": F.min}, {"hop": lambda own, nxt: own + nxt}, {"surface": F.col("surface") - F.col("hop")})


def _clamped(cells: DataFrame, bed: str, floor: str, drop: float) -> DataFrame:
    """cell_id, bed after every link has asked its receiver to lie ``drop`` below, but no lower than the receiver's floor.

    A link maps the bed above to a demand below: x -> max(min(x - shift, high), low). Such maps are closed under
    composition and rise with x, so the least demand may be taken at any point on the way.
    """
    rows = cells.select("cell_id", "receiver", F.col(bed).alias("bed"), F.col(floor).alias("floor"))
    to = rows.select(F.col("cell_id").alias("_to"), F.col("bed").alias("high"), F.col("floor").alias("low"))
    start = rows.join(to, rows["receiver"] == to["_to"], "left").select(
        "cell_id", F.col("_to").alias("ptr"), "bed", F.when(F.col("_to").isNotNull(), F.struct(F.lit(float(drop)).alias("shift"), F.greatest("high", "low").alias("high"), F.least("low", "high").alias("low"))).alias("f")
    )
    put = lambda f, x: F.greatest(F.least(x - f["shift"], f["high"]), f["low"])
    then = lambda f, g: F.when(g.isNotNull(), F.struct((f["shift"] + g["shift"]).alias("shift"), put(g, f["high"]).alias("high"), put(g, f["low"]).alias("low")))
    return doubled(start, {"bed": lambda own, more: F.least(own, more)}, {"bed": F.min}, {"f": then}, {"bed": put(F.col("f"), F.col("bed"))})


def conditioned_depth(cells: DataFrame, z: str = "z", depth: str = "depth", river: str = "river", drop: float = 0.0, cap: float | None = None) -> DataFrame:
    """cell_id, depth: river depths deepened downstream until beds descend by ``drop``, at most to ``cap``."""
    on = cells.where(F.col(river) & (F.col(depth) > 0)).select("cell_id", "receiver", F.col(z).alias("z"), (F.col(z) - F.col(depth)).alias("bed"))
    lowest = F.col("z") - F.lit(float(cap)) if cap is not None else F.lit(float("-inf"))
    beds = _clamped(on.withColumn("floor", lowest), "bed", "floor", drop)
    return on.select("cell_id", "z").join(beds, "cell_id").select("cell_id", (F.col("z") - F.col("bed")).alias("depth"))


def conditioned_surface(cells: DataFrame, z: str, depth: str, river: str, drop: float, max_lowering: float) -> DataFrame:
    """cell_id, surface, lowering: river surfaces lowered where beds would rise downstream, each by at most ``max_lowering``."""
    if max_lowering <= 0:
        raise ValueError("max_lowering must be positive")
    on = cells.where(F.col(river) & (F.col(depth) > 0)).select("cell_id", "receiver", F.col(z).alias("z"), F.col(depth).alias("depth"))
    on = on.withColumns({"bed": F.col("z") - F.col("depth"), "floor": F.col("z") - F.col("depth") - float(max_lowering)})
    beds = _clamped(on, "bed", "floor", drop)
    out = on.select("cell_id", "z", "depth").join(beds, "cell_id")
    return out.select("cell_id", (F.col("bed") + F.col("depth")).alias("surface"), (F.col("z") - F.col("bed") - F.col("depth")).alias("lowering"))


def basins(cells: DataFrame, area: str, low: float, high: float) -> DataFrame:
    """cell_id, outlet: cells under outlets whose area lies in [low, high] and whose receiver's exceeds ``high``."""
    down = cells.select(F.col("cell_id").alias("_to"), F.col(area).alias("_area"))
    marked = cells.join(down, cells["receiver"] == down["_to"], "left").withColumn("_out", F.col(area).between(low, high) & (F.col("_area") > high))
    return resolved(marked, F.col("_out")).where("target is not null").select("cell_id", F.col("target").alias("outlet"))
