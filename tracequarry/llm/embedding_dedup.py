"""Embedding near-deduplication: random-hyperplane sign hashing, exact cosines, components.

Equal vectors are first merged into one class. Every class gets a bucket in each of
several hash tables; only buckets of two and more classes go on, in cells of a bounded
number of rows, so that a crowded bucket is spread over many tasks. A cell compares its
rows by one matrix product and returns, for each class, the number of vectors that it
links to and one link of a spanning forest: what is returned grows with the rows, not
with the pairs. A pair that meets in several tables counts in the first of them only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize
from .text import group_starts, whole_groups

CELL_ROWS = 2048
SMALL_GROUP = 16


def hash_plan(rows: int, cosine: float, miss: float = 5e-4) -> tuple[int, int]:
    """(bits, tables): buckets get finer as rows grow; tables keep the chance to miss a pair at ``cosine`` below ``miss``."""
    bits = min(24, max(12, math.ceil(math.log2(max(rows, 2))) - 3))
    same = (1.0 - math.acos(min(1.0, cosine)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1.0 - same)))


def hyperplanes(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, bits * tables))


def unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def codes(x: np.ndarray, planes: np.ndarray, bits: int) -> np.ndarray:
    """One integer per row and table."""
    signs = (x @ planes > 0).reshape(len(x), -1, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def linked_pairs(x: np.ndarray, group: np.ndarray, block: np.ndarray, cross: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i < j) of linked rows of a group; in a cross cell only rows of different blocks are compared. ``group`` is sorted."""
    left, right = [], []
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    small = np.repeat(sizes <= SMALL_GROUP, sizes)
    for step in range(1, min(SMALL_GROUP, len(group))):
        i = np.flatnonzero((group[step:] == group[:-step]) & small[:-step])
        if not len(i):
            break
        left.append(i)
        right.append(i + step)
    for start, size in zip(starts[sizes > SMALL_GROUP], sizes[sizes > SMALL_GROUP]):
        part = x[start : start + size]
        i, j = np.nonzero(np.triu(part @ part.T >= cosine - 1e-9, 1))
        left.append(i + start)
        right.append(j + start)
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    i, j = np.concatenate(left), np.concatenate(right)
    keep = np.empty(len(i), bool)
    for at in range(0, len(i), 1 << 16):
        a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        keep[at : at + (1 << 16)] = (np.einsum("ij,ij->i", x[a], x[b]) >= cosine) & (~cross[a] | (block[a] != block[b]))
    return i[keep], j[keep]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` rows the smallest row that the links (i, j) reach."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        root = root[root]
        open_ = root[i] != root[j]
        if not open_.any():
            break
    while (root[root] != root).any():
        root = root[root]
    return root


def embedding_near_duplicates(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.93, miss: float = 5e-4, seed: int = 11
) -> DataFrame:
    """One row per input row: ``key``, ``n_links``, ``component_id``, ``kept``.

    Vectors link when their labels are equal and their cosine is at least ``cosine``.
    Null labels, null, empty or zero vectors and those with null or non-finite
    components link with nothing; neither do vectors of different lengths, nor rows
    without a key, which have a null component and are kept. Rows that repeat another
    are vectors of their own. An empty table gives no rows. No link at or above the
    threshold is returned wrongly; one is missed with a chance of at most ``miss``.
    """
    ids = rows.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    kind = rows.schema[key].dataType.simpleString()
    finite = F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    sound = F.coalesce(finite & F.exists("v", lambda c: c != 0), F.lit(False))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & sound
    classes = ids.where(usable).groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("mult"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()))
    bits, tables = hash_plan(classes.count(), cosine, miss)

    def bucket(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lengths = batch["v"].map(len).to_numpy()
            for dim in np.unique(lengths):
                part = batch[lengths == dim]
                code = codes(unit(np.stack(part["v"].to_numpy())), hyperplanes(int(dim), bits, tables, seed), bits)
                out = part[["cid", "label"]].loc[part.index.repeat(tables)]
                yield out.assign(dim=int(dim), tab=np.tile(np.arange(tables), len(part)), code=code.ravel())

    label_kind = rows.schema[label].dataType.simpleString()
    at = ["label", "dim", "tab", "code"]
    hashed = materialize(classes.select("cid", "label", "v").mapInPandas(bucket, f"cid bigint, label {label_kind}, dim int, tab int, code bigint"))
    shared = hashed.groupBy(*at).agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / CELL_ROWS * 2).cast("int")  # a cross cell holds two blocks
    blocks = F.when(F.col("n") <= CELL_ROWS, 1).otherwise(blocks)
    members = hashed.join(shared, at).withColumn("block", F.pmod(F.xxhash64("cid"), blocks).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    members = members.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    cell = [*at, "lo", "hi"]
    cells = members.select("cid", "block", *cell).join(classes.select("cid", "v", "mult"), "cid")
    cells = cells.repartition(*cell).sortWithinPartitions(*cell)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in whole_groups(batches, cell):
            yield solve(part, group_starts(part, cell))

    def solve(batch: pd.DataFrame, new: np.ndarray) -> pd.DataFrame:
        out = []
        dims = batch["dim"].to_numpy()
        for dim in np.unique(dims):
            mine = dims == dim
            part, group = batch[mine], np.cumsum(new)[mine]
            x = unit(np.stack(part["v"].to_numpy()))
            cross = part["lo"].to_numpy() != part["hi"].to_numpy()
            i, j = linked_pairs(x, group, part["block"].to_numpy(), cross, cosine)
            if not len(i):
                continue
            used, where = np.unique(np.r_[i, j], return_inverse=True)
            code = codes(x[used], hyperplanes(int(dim), bits, tables, seed), bits)
            a, b = where[: len(i)], where[len(i) :]
            table = part["tab"].to_numpy()[i]
            first = np.concatenate([(code[a[k : k + 65536]] == code[b[k : k + 65536]]).argmax(axis=1) for k in range(0, len(a), 65536)]) == table
            a, b = a[first], b[first]
            mult, cid = part["mult"].to_numpy()[used], part["cid"].to_numpy()[used]
            links = np.bincount(a, mult[b], len(used)) + np.bincount(b, mult[a], len(used))
            root = forest(len(used), a, b)
            some = links > 0
            out.append(pd.DataFrame({"cid": cid[some], "root": cid[root[some]], "links": links[some].astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"cid": [], "root": [], "links": []}).astype("int64")

    found = materialize(cells.mapInPandas(compare, "cid bigint, root bigint, links bigint"))
    component = connected_components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    named = classes.select("cid", "label", "v", "rep", "mult").join(component.withColumnRenamed("node", "cid"), "cid", "left")
    named = named.withColumn("component", F.coalesce("component", "cid"))
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(smallest, "component").join(links, "cid", "left")
    named = named.select("label", "v", "component_id", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
    done = ids.where(usable).join(named, ["label", "v"]).select("id", "n_links", "component_id")
    alone = ids.where(~usable).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return done.union(alone).select(
        F.col("id").cast(kind).alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    )
