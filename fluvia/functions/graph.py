"""Connected components by contraction; every round is a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvia.functions.tables import discard, settled


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """node, comp (the component's least node) for all ends of ``u, v`` edges.

    A round names each node by its least neighbour's least neighbour, itself among them, and goes on with the edges between
    different names, so a dense group shrinks to one node within few rounds and its edges are not looked at again.
    A component's least node keeps its own name in every round.
    """
    left = settled(_distinct(edges), "edges")
    names: list[DataFrame] = []
    for _ in range(max_rounds):
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = settled(both.groupBy("u").agg(F.least("u", F.min("v")).alias("near")).withColumnRenamed("u", "node"), "near")
        further = near.select(F.col("node").alias("to"), F.col("near").alias("comp"))
        names.append(settled(near.join(further, near["near"] == further["to"]).select("node", "comp"), "names"))
        of_u, of_v = (names[-1].select(F.col("node").alias(f"_{end}"), F.col("comp").alias(f"_name_{end}")) for end in "uv")
        named = left.join(of_u, left["u"] == of_u["_u"]).join(of_v, left["v"] == of_v["_v"]).select(F.col("_name_u").alias("u"), F.col("_name_v").alias("v"))
        new = settled(_distinct(named), "edges")
        discard(near, left)
        left = new
        if not left.limit(1).count():
            out = names[0]
            for later in names[1:]:
                later = later.select(F.col("node").alias("_node"), F.col("comp").alias("_comp"))
                out = out.join(later, out["comp"] == later["_node"], "left").select("node", F.coalesce("_comp", "comp").alias("comp"))
            out = settled(out, "components")
            discard(left, *names)
            return out
    raise RuntimeError("components did not settle")


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
