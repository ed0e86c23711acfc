"""Connected components of a link table, distributed: alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links (a[i], b[i]) and each one's smallest connected node, by hooking and pointer jumping."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        pu, pv = parent[u], parent[v]
        differ = pu != pv
        if not differ.any():
            return nodes, nodes[parent]
        np.minimum.at(parent, np.maximum(pu, pv)[differ], np.minimum(pu, pv)[differ])
        while (parent != (up := parent[parent])).any():
            parent = up


def _local(batches):
    """Replace each batch of links by stars around the smallest node: never more links than came in."""
    for x in batches:
        if len(x):
            nodes, root = roots(x["u"].to_numpy(), x["v"].to_numpy())
            keep = nodes != root
            yield pd.DataFrame({"u": nodes[keep], "v": root[keep]})


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links`` (u long, v long), any direction, repeats allowed -> one row (u, root) for each node that is not
    the smallest of its component. Every round is written to the shared folder; nothing is collected but two
    numbers a round. Hot nodes only meet in aggregations with map-side combining and in splittable joins.
    """
    e = links.where("u <> v").select("u", "v").mapInPandas(_local, "u long, v long").distinct()
    e = materialise(e, "cc-links")
    seen = None
    for _ in range(max_rounds):
        both = e.union(e.select("v", "u"))
        # written, so that both sides of the join are dealt by Spark and a hot node's partition can be split
        least = materialise(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")), "cc-least")
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, "cc-large")
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).union(least.select("u", "m")).distinct()
        e = materialise(small, "cc-small")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select("u", F.col("v").alias("root"))
