"""N-gram Jaccard join by a MinHash LSH forest.

A document is the set of its five-word shingles (lower case, white space as one space; a shorter text is one
shingle).  Equal texts fall into one class, and one of them stands for it.

Each tree of the forest is a prefix trie, kept as what it is in sorted order: the classes in the order of their strings
of MinHash bytes, where a class's longest match in the tree stands next to it.  A class begins at its longest match in
every tree.  While the recall that its matches promise for a pair at the similarity threshold is below the target, its
longer prefixes are shortened by one byte; so a class that few others match stops early, and one amid many near copies
goes down to where the target holds whatever it matches.  Two classes meet in a tree if their common prefix is as long as
the prefix of either.  The tries are sorted over range partitions, so a prefix that a third of the classes share spans
many tasks, and a class is tied to its sorted neighbours only.

Meeting only proposes: what hangs together over it is verified exactly with the shingle sets themselves.  A group of many
classes is parted by set size, since sets that differ in size by more than the threshold cannot be near, and dealt
into blocks by hash; a task compares two blocks as a matrix product and returns one row a class: the documents
linked to it and the least class it hangs together with.  A large group thus takes many tasks of bounded size.

Defined cases: a null text or one without words has no shingles and is linked to nothing, not even to its like;
rows with a null id are returned with a null class and no links; equal rows are copies of each other; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluvia.llm.common import per_batch, per_task, stored
from fluvia.llm.graph import components

WORDS, SIMILARITY = 5, 0.8
TREES, DEPTH, RECALL = 32, 10, 0.999
#: Classes and shingles of one block at most, about.
BLOCK_CLASSES, BLOCK_SHINGLES = 128, 200_000
#: Entries of a sorted trie that are looked through at once.
TRIE_ROWS = 100_000
#: Members of compared groups are sent to all executors up to this number; beyond it both sides are shuffled.
SENT_MEMBERS = 200_000

_RNG = np.random.default_rng(77)
_BYTES = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_FACTORS = _RNG.integers(0, 1 << 31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _RNG.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n + 1:
        size = max(1 << 16, 2 * n)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for k, base in enumerate((_BASE, inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def canonical(text: str | None) -> bytes:
    """Lower-case words with one space between them."""
    return " ".join((text or "").lower().split()).encode("utf-8", "surrogatepass")


def shingles(data: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a canonical text."""
    if not data:
        return np.empty(0, np.uint64)
    b = np.frombuffer(data, np.uint8)
    power, inverse = _power_tables(len(b))
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTES[b] * power[: len(b)], out=total[1:])
    gaps = np.flatnonzero(b == 32)
    begin, end = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(b)]])
    n = max(1, len(begin) - words + 1)
    begin, end = begin[:n], end[-n:]
    h = (total[end] - total[begin]) * inverse[begin]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return np.unique(h)


def signature(own: np.ndarray) -> bytes:
    """One byte of each MinHash, tree by tree."""
    x = (own >> np.uint64(32)).astype(np.uint32)
    least = np.full(TREES * DEPTH, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(least, (x[at : at + 512, None] * _FACTORS + _SHIFTS).min(axis=0), out=least)
    least *= np.uint32(0x85EBCA6B)
    return (least >> np.uint32(24)).astype(np.uint8).tobytes()


def log_miss(similarity: float, depth: int) -> float:
    """Logarithm of the probability that a pair of this similarity has no common prefix of ``depth`` bytes in a tree."""
    same = similarity + (1 - similarity) / 256
    return math.log1p(-(same**depth))


def least_depth(similarity: float = SIMILARITY, recall: float = RECALL) -> int:
    """The longest prefix that reaches the recall at ``similarity`` if all trees go down to it: no class need go deeper into the tries' roots."""
    return max([d for d in range(1, DEPTH + 1) if TREES * log_miss(similarity, d) <= math.log(1 - recall)], default=1)


def class_number(data: bytes) -> int:
    return int.from_bytes(hashlib.md5(data).digest()[:8], "little", signed=True)


def _signatures(batch: pa.RecordBatch) -> pa.RecordBatch:
    out = []
    for text in batch.column("text").to_pylist():
        data = canonical(text)
        own = shingles(data)
        out.append((class_number(data), len(own), signature(own) if len(own) else None))
    number, size, sig = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(number, pa.int64()), pa.array(size, pa.int32()), pa.array(sig, pa.binary())], ["doc_id", "c", "size", "sig"])


def _matrix_links(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (a < b) of sets with Jaccard similarity of at least ``similarity``."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(first) - 1
    # A shingle of one set alone adds to no intersection.
    common = np.bincount(column)[column] > 1
    column, owner = column[common], owner[common]
    both = np.zeros((n, n), np.float32)
    if len(column):
        column = np.cumsum(np.concatenate([[True], column[1:] != column[:-1]])) - 1
        for at in range(0, int(column[-1]) + 1, 8192):
            lo, hi = np.searchsorted(column, [at, at + 8192])
            part = np.zeros((n, min(8192, int(column[-1]) + 1 - at)), np.float32)
            part[owner[lo:hi], column[lo:hi] - at] = 1
            both += part @ part.T
    a, b = np.triu_indices(n, 1)
    inter = both[a, b].astype(np.int64)
    near = inter >= similarity * (size[a] + size[b] - inter) - 1e-9
    return a[near], b[near]


def _few_links(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    found = []
    for b in range(1, len(sets)):
        for a in range(b):
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) >= similarity * max(len(x), len(y)) - 1e-9:
                inter = len(np.intersect1d(x, y, assume_unique=True))
                if inter >= similarity * (len(x) + len(y) - inter) - 1e-9:
                    found.append((a, b))
    return np.array([a for a, _ in found], int), np.array([b for _, b in found], int)


def _verified(similarity: float, words: int):
    """A ``mapInArrow`` function over rows in order of comp, lo, hi: one row for each class of each group."""

    def compare(lo: int, hi: int, group: dict[int, tuple]) -> list[tuple]:
        numbers = sorted(group)
        sets = [group[c][0] for c in numbers]
        a, b = (_few_links if len(sets) <= 6 else _matrix_links)(sets, similarity)
        if lo != hi:
            block = np.array([group[c][2] for c in numbers])
            across = block[a] != block[b]
            a, b = a[across], b[across]
        docs = np.array([group[c][1] for c in numbers], np.int64)
        linked = np.bincount(a, docs[b], len(sets)) + np.bincount(b, docs[a], len(sets))
        classes = np.bincount(a, minlength=len(sets)) + np.bincount(b, minlength=len(sets))
        root = list(range(len(sets)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = find(x), find(y)
            root[max(x, y)] = min(x, y)
        return [(c, int(linked[i]), int(classes[i]), numbers[find(i)]) for i, c in enumerate(numbers) if classes[i]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group, out = None, {}, []

        def rows() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["c", "linked", "classes", "root"])

        for batch in batches:
            for comp, lo, hi, c, docs, block, text in zip(*[batch.column(k).to_pylist() for k in ("comp", "lo", "hi", "c", "docs", "block", "text")], strict=True):
                if (comp, lo, hi) != at:
                    if len(group) > 1:
                        out += compare(at[1], at[2], group)
                    at, group = (comp, lo, hi), {}
                    if len(out) > 5000:
                        yield rows()
                data = canonical(text)
                # Rows that share an id with the class's own row have other texts.
                if c not in group and class_number(data) == c:
                    group[c] = shingles(data, words), docs, block
        if len(group) > 1:
            out += compare(at[1], at[2], group)
        if out:
            yield rows()

    return run


def _common(keys: list[bytes], trees: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each entry with the one before it; 0 for the first and across trees."""
    k = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, DEPTH)
    out = np.zeros(len(k), np.int64)
    out[1:] = np.logical_and.accumulate(k[1:] == k[:-1], axis=1).sum(1) * (trees[1:] == trees[:-1])
    return out


def _sorted_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, bool, bool]]:
    """(rows, whether the first, whether the last run) of a sorted partition; a run begins with the last row of the one before."""
    held: list = []
    first = True
    for batch in batches:
        held += zip(*[column.to_pylist() for column in batch.columns], strict=True)
        if len(held) >= TRIE_ROWS:
            yield held, first, False
            held, first = held[-1:], False
    if held:
        yield held, first, True


def _longest(least: int):
    """A ``mapInArrow`` function over tree, key, c in sorted order: the entries with a match of ``least`` bytes, and its length.

    What stands beyond the partition is not seen, so its ends count as matched in full.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead = 0
        for rows, first, last in _sorted_runs(batches):
            trees, keys, numbers = zip(*rows, strict=True)
            common = _common(list(keys), np.array(trees))
            # Between two runs the last row of the one is the first of the other, and is given out by the other.
            common[0] = DEPTH if first else ahead
            longest = np.maximum(common, np.append(common[1:], DEPTH if last else 0))
            ahead = int(common[-1]) if len(rows) > 1 else int(common[0])
            take = np.flatnonzero(longest[: len(rows) if last else len(rows) - 1] >= least)
            yield pa.RecordBatch.from_arrays(
                [pa.array([trees[i] for i in take], pa.int32()), pa.array([keys[i] for i in take], pa.binary()), pa.array([numbers[i] for i in take], pa.int64()), pa.array(longest[take], pa.int32())],
                ["tree", "key", "c", "longest"],
            )

    return run


def _neighbours(least: int):
    """A ``mapInArrow`` function over tree, key, c, stop in sorted order: u, v of classes that meet, as ties between sorted neighbours.

    An entry's prefix is its longest match, shortened to ``stop``.  All entries below that prefix are tied to the next one.  The
    ends of the partition come out as rows with ``part``; ties across the ends of a run are made on suspicion.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for rows, first, last in _sorted_runs(batches):
            trees, keys, numbers, stops = zip(*rows, strict=True)
            common = _common(list(keys), np.array(trees))
            longest = np.maximum(common, np.append(common[1:], 0))
            depth = np.maximum(np.minimum(longest, np.array(stops)), least)
            tied = np.zeros(len(rows), bool)
            for d in range(least, DEPTH + 1):
                node = np.cumsum(common < d) - 1
                sought = np.bincount(node[depth == d], minlength=node[-1] + 1) > 0
                # What else lies below a node at the end of a run is not seen here.
                sought[[0, -1]] = True
                tied |= (common >= d) & sought[node]
            at = np.flatnonzero(tied)
            yield _ties([numbers[i - 1] for i in at], [numbers[i] for i in at])
            for end, i in [(0, 0)] * first + [(1, len(rows) - 1)] * last:
                yield _ties([numbers[i]], [None], [2 * part + end], [trees[i]], [keys[i]])

    def _ties(u: list, v: list, part: list | None = None, tree: list | None = None, key: list | None = None) -> pa.RecordBatch:
        none = [None] * len(u)
        columns = pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(part or none, pa.int64()), pa.array(tree or none, pa.int32()), pa.array(key or none, pa.binary())
        return pa.RecordBatch.from_arrays(list(columns), ["u", "v", "part", "tree", "key"])

    return run


def met_classes(classes: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """u, v: ties that join all classes (``c, sig``) that meet in the forest."""
    least = least_depth(similarity, recall)
    trees = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.substring("sig", t * DEPTH + 1, DEPTH))
    entries = classes.select("c", F.posexplode(trees).alias("tree", "key")).select("tree", "key", "c")
    tries = entries.repartitionByRange("tree", "key", "c").sortWithinPartitions("tree", "key", "c")
    matched = stored(tries.mapInArrow(per_task(_longest(least)), "tree int, key binary, c long, longest int"), "matches")
    # Each class's stop: the longest at which its prefixes, shortened to it, promise the recall.
    deeper = range(least + 1, DEPTH + 1)
    counts = matched.groupBy("c").agg(*[F.count_if(F.col("longest") >= d).alias(f"n{d}") for d in deeper])
    promise, stop = F.lit(TREES * log_miss(similarity, least)), F.lit(least)
    for d in deeper:
        promise = promise + F.col(f"n{d}") * (log_miss(similarity, d) - log_miss(similarity, d - 1))
        stop = F.when(promise <= math.log(1 - recall), F.lit(d)).otherwise(stop)
    stops = counts.select("c", stop.alias("stop"))
    sought = matched.select("tree", "key", "c").join(stops, "c").select("tree", "key", "c", "stop")
    ties = stored(
        sought.repartitionByRange("tree", "key", "c").sortWithinPartitions("tree", "key", "c").mapInArrow(per_task(_neighbours(least)), "u long, v long, part long, tree int, key binary"), "ties"
    )
    # Two rows a partition.
    ends = sorted((r["part"], r["tree"], bytes(r["key"]), r["u"]) for r in ties.where("part is not null").collect())
    across = [(a[3], b[3]) for a, b in zip(ends, ends[1:], strict=False) if a[0] % 2 == 1 and a[1] == b[1] and a[2][:least] == b[2][:least]]
    inside = ties.where("part is null").select("u", "v")
    return inside.unionByName(classes.sparkSession.createDataFrame(across, "u long, v long")) if across else inside


def jaccard_classes(df: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links of every row of ``doc_id, text``.

    n_links: other documents of Jaccard similarity of at least ``similarity``, copies included.  class_id: the least
    doc_id among the documents that hang together over such links.
    """
    signed, final = _classed(df, similarity, recall)
    return (
        signed.select("doc_id", "size", F.when((F.col("size") > 0) & F.col("doc_id").isNotNull(), F.col("c")).alias("c"))
        .join(final, "c", "left")
        .select("doc_id", F.when(F.col("c").isNotNull(), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    )


_BANDS = 1 << 32


def _blocks_of(band: Column) -> Column:
    """Numbers of all blocks of a band of the group; none for a band without classes."""
    blocks = F.col("blocks")[band]
    return F.when(blocks.isNull(), F.array().cast("array<long>")).otherwise(F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: band * _BANDS + b))


def _classed(df: DataFrame, similarity: float, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """(doc_id, c, size, sig of all rows; c, class_id, keeper, n_links of all classes): ``keeper`` is the class of the text that stands for its group."""
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stored(rows.mapInArrow(per_batch(_signatures), "doc_id long, c long, size int, sig binary"), "signatures")
    classes = stored(
        signed.where("size > 0 and doc_id is not null").groupBy("c").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("docs"), F.max("size").alias("size"), F.first("sig").alias("sig")),
        "classes",
    )
    groups = components(met_classes(classes, similarity, recall)).select(F.col("node").alias("c"), "comp")
    member = stored(groups.join(classes.drop("sig"), "c"), "members")
    # Sets in bands of size that are not next to each other differ by more than the threshold; a small group is one band.
    many = member.groupBy("comp").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"))
    many = many.select("comp", ((F.col("n") > BLOCK_CLASSES) | (F.col("shingles") > BLOCK_SHINGLES)).alias("many"))
    band = F.when(F.col("many"), F.floor(F.log("size") / -math.log(similarity) + 1e-9)).otherwise(0).cast("int")
    banded = stored(member.join(many, "comp").select("comp", "c", "docs", "first_id", "size", band.alias("band")), "banded")
    sizes = banded.groupBy("comp", "band").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES), F.ceil(F.sum("size") / BLOCK_SHINGLES), F.lit(1)).cast("int").alias("blocks"))
    # At most a hundred bands a group.
    sizes = stored(sizes.groupBy("comp").agg(F.map_from_entries(F.collect_list(F.struct("band", "blocks"))).alias("blocks")), "group-sizes")
    own = F.col("band") * _BANDS + F.pmod(F.xxhash64("c"), F.col("blocks")[F.col("band")])
    near = F.flatten(F.transform(F.array(*[F.col("band") + k for k in (-1, 0, 1)]), _blocks_of))
    dealt = stored(banded.join(sizes, "comp").select("comp", "c", "docs", "first_id", own.alias("block"), near.alias("others")), "dealt")
    texts = rows.where("doc_id is not null")
    if dealt.count() <= SENT_MEMBERS:
        found = texts.join(F.broadcast(dealt), texts["doc_id"] == dealt["first_id"])
    else:
        found = texts.join(dealt.hint("shuffle_hash"), texts["doc_id"] == dealt["first_id"])
    keyed = found.select("comp", "c", "docs", "block", "text", F.explode("others").alias("other")).select(
        "comp", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "c", "docs", "block", "text"
    )
    checked = stored(
        keyed.repartition("comp", "lo", "hi").sortWithinPartitions("comp", "lo", "hi").mapInArrow(per_task(_verified(similarity, WORDS)), "c long, linked long, classes long, root long"),
        "links",
    )
    links = checked.groupBy("c").agg(F.sum("linked").alias("linked"))
    joined = components(checked.where("c <> root").select(F.col("c").alias("u"), F.col("root").alias("v")))
    info = classes.select("c", "first_id", "docs").join(links, "c", "left").join(joined.withColumnRenamed("node", "c"), "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    info = stored(info, "class-info")
    names = stored(info.groupBy("comp").agg(F.min(F.struct("first_id", "c")).alias("of")), "class-names")
    of = [F.col("of.first_id").alias("class_id"), F.col("of.c").alias("keeper")]
    final = stored(info.join(names, "comp").select("c", *of, (F.coalesce("linked", F.lit(0)) + F.col("docs") - 1).alias("n_links")), "classes-out")
    return signed, final


def keep_one(df: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of ``df`` for each group of linked texts, that of least id; a null id is linked only to null ids of the same text.

    Rows are told apart by id where it stands on one row, and by id and text where it stands on more.
    """
    signed, final = _classed(df, similarity)
    named = signed.where("doc_id is not null").select("doc_id", F.when(F.col("size") > 0, F.col("c")).alias("c")).join(final, "c", "left")
    other = F.coalesce((F.col("doc_id") != F.col("class_id")) | (F.col("c") != F.col("keeper")), F.lit(False))
    touched = stored(named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(other).alias("gone")).where("gone or n > 1"), "touched")
    ids = touched.select("doc_id")
    if ids.count() <= 4 * SENT_MEMBERS:
        ids = F.broadcast(ids)
    # Whole rows travel as one column, so no name of theirs can clash with one used here.
    packed = df.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    left = packed.join(ids, "doc_id", "left_anti").select(*packed.columns)
    if touched.where("n > 1").limit(1).count():
        rows = _numbered(packed.join(touched.where("n > 1").select("doc_id"), "doc_id", "left_semi").select(*packed.columns))
        rows = rows.join(final.select("c", "class_id", "keeper"), "c", "left")
        once = rows.where((F.col("doc_id") == F.col("class_id")) & (F.col("c") == F.col("keeper"))).dropDuplicates(["doc_id", "c"])
        left = left.unionByName(rows.where("keeper is null").unionByName(once).select(*packed.columns))
    nameless = signed.where("doc_id is null and size > 0").groupBy("c").count().where("count > 1")
    if nameless.limit(1).count():
        rows = _numbered(left.where("doc_id is null"))
        once = rows.where("c is not null").dropDuplicates(["c"]).unionByName(rows.where("c is null"))
        left = left.where("doc_id is not null").unionByName(once.select(*packed.columns))
    return left.select("row.*")


def _numbered(df: DataFrame) -> DataFrame:
    """``df`` with the class number of each text as ``c``; null for a text without words."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data = [canonical(t) for t in batch.column("text").to_pylist()]
        return batch.append_column("c", pa.array([class_number(d) if d else None for d in data], pa.int64()))

    return df.mapInArrow(per_batch(run), T.StructType([*df.schema, T.StructField("c", T.LongType())]))
