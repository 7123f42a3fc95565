"""MinHash near-deduplication with an LSH forest.

Documents with equal shingle sets are merged into one class first, so that copies cost
nothing. Each class gets a MinHash signature, and one path, a fixed order of signature
values, in each of several trees; classes whose paths begin alike share a region.

* In a small region all classes meet. In a crowded one, sorted by path, each takes its
  neighbours, which share the longest prefixes, as candidates.
* Then whatever isn't in the same component as most of its region is compared with all
  of the region, in cells of bounded size, so that a region is finished exactly. That
  costs little where a crowd is a group of copies, as its neighbours have joined nearly
  all of it before.
* Where it would cost much, a crowd of classes that are hardly alike, the classes go on
  to a forest with longer prefixes and as many more trees as keep the chance to miss a
  link the same. The last forest is finished whatever it costs.

So no pair is left out for the size of a group: a link is missed only if no tree has its
two ends in one region. Candidates whose signatures agree too little are left out; the
others are confirmed on the full sets, best candidates first, then those that would
still join two components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, connected_components, materialize, release, small_side
from .text import chunks, group_starts, whole_groups, words_of

SIGNATURE = 64
#: Values that a region shares, in one forest after the other.
DEPTHS = (4, 8, 12)
#: The chance that no tree of a forest has two classes at the threshold in one region.
MISS = 2.5e-4
#: Values by which a crowded region is sorted.
PATH = 16
#: In a region of up to so many classes all meet at once.
LEAF = 16
NEIGHBOURS = 2
#: Comparisons that finish a region, above which its classes go on to longer prefixes.
MOST_COMPARISONS = 2**28
#: Classes of either side in a cell, about.
CELL_ROWS = 2048
#: Signature values, of 64, that must agree: 4.2 standard deviations below what 0.8 gives on average.
LEAST_AGREEMENT = 38
#: So many of a set's smallest shingles are its sketch; estimates from cut sketches may be off by ``SLACK``, 4.2 standard deviations.
SKETCH = 512
SLACK = 0.075
BROADCAST_ROWS = 500_000

_odd = np.random.default_rng(61).integers(1, 2**63, size=SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_add = np.random.default_rng(62).integers(0, 2**63, size=SIGNATURE, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], width: int = 2) -> list[np.ndarray]:
    """Sorted 64-bit hashes of the distinct shingles of each text: of ``width`` words, or of the whole sequence if it is shorter."""
    lists = [words_of((t or "").translate(ASCII_LOWER)) for t in texts]
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    flat = np.array([w for x in lists for w in x], dtype=object)
    if not len(flat):
        return [np.empty(0, np.uint64) for _ in texts]
    code, unique = pd.factorize(flat)
    word = np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in unique), np.uint64, len(unique))[code]
    joined = np.full(max(0, len(word) - width + 1), np.uint64(width))
    for k in range(width):
        joined = mixed(joined * np.uint64(0x9E3779B97F4A7C15) + word[k : k + len(joined)])
    out, start = [], 0
    for n in sizes:
        if n >= width:
            out.append(np.unique(joined[start : start + n - width + 1]))
        elif n:
            few = np.array([n], dtype=np.uint64)
            for k in range(n):
                few = mixed(few * np.uint64(0x9E3779B97F4A7C15) + word[start + k])
            out.append(few)
        else:
            out.append(np.empty(0, np.uint64))
        start += n
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``SIGNATURE`` 32-bit minima for each set; zeros for an empty one."""
    out = np.zeros((len(sets), SIGNATURE), np.uint32)
    full = [k for k, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[k] for k in full])
        starts = np.cumsum([0, *[len(sets[k]) for k in full[:-1]]])
        for h in range(SIGNATURE):
            out[full, h] = np.minimum.reduceat(((flat * _odd[h] + _add[h]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def values_of(sig: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sig), ">u2").reshape(len(sig), SIGNATURE)


def trees_for(percent: int, depth: int) -> int:
    """How many trees of ``depth`` keep the chance to miss a link at the threshold at ``MISS``."""
    return math.ceil(math.log(MISS) / math.log(1 - min(0.999, percent / 100) ** depth))


def tree_order(depth: int, tree: int) -> np.ndarray:
    """Which signature values are a tree's path, in order."""
    return np.random.default_rng([63, depth, tree]).permutation(SIGNATURE)[:PATH]


def _sign(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo, hi in chunks(batch["text"]):
                sets = shingle_sets(batch["text"].iloc[lo:hi].tolist(), width)
                sig = (signatures(sets) * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(">u2")
                yield pd.DataFrame(
                    {
                        "id": batch["id"].iloc[lo:hi].to_numpy(),
                        "n": [len(s) for s in sets],
                        "same": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                        "sig": [row.tobytes() for row in sig],
                    }
                )

    return run


def _sets(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo, hi in chunks(batch["text"]):
                part = batch.iloc[lo:hi]
                sets = shingle_sets(part["text"].tolist(), width)
                right = np.array([xxhash.xxh3_128_digest(s.tobytes()) == same for s, same in zip(sets, part["same"])], bool)
                yield pd.DataFrame({"cid": part["cid"].to_numpy()[right], "shingles": [s.view(np.int64) for s, ok in zip(sets, right) if ok]})

    return run


def regions_of(values: np.ndarray, depth: int, trees: int) -> np.ndarray:
    """(row, tree) of hashes of each path's first ``depth`` values."""
    order = np.stack([tree_order(depth, t)[:depth] for t in range(trees)])
    values = values.astype(np.uint64)
    region = np.zeros((len(values), trees), np.uint64)
    for k in range(depth):
        region = mixed(region * np.uint64(0x9E3779B97F4A7C15) + values[:, order[:, k]] + np.uint64(1))
    return region.view(np.int64)


def _regions(depth: int, trees: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"cid": batch["cid"].to_numpy(), "regions": list(regions_of(values_of(batch["sig"].tolist()), depth, trees))})

    return run


def _paths(depth: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                values = values_of(batch["sig"].tolist())
                path = [values[k, tree_order(depth, t)].tobytes() for k, t in enumerate(batch["tree"])]
                yield batch.assign(path=path)[["tree", "region", "path", "cid", "n", "sig"]]

    return run


def _candidates(rows: pd.DataFrame, i: np.ndarray, j: np.ndarray, percent: int) -> pd.DataFrame:
    """Of the pairs of rows (i, j) those whose sizes allow a link and whose signatures agree well enough."""
    n, cid = rows["n"].to_numpy(), rows["cid"].to_numpy()
    possible = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
    i, j = i[possible], j[possible]
    values = values_of(rows["sig"].tolist()) if len(i) else None
    agree = np.concatenate([(values[i[k : k + 65536]] == values[j[k : k + 65536]]).sum(axis=1) for k in range(0, len(i), 65536)] or [np.empty(0, np.int64)])
    good = agree >= LEAST_AGREEMENT - (80 - percent) * SIGNATURE // 100
    a, b = cid[i[good]], cid[j[good]]
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "agree": agree[good].astype(np.int32)})


def _neighbours(percent: int):
    """Pairs of rows at most ``NEIGHBOURS`` apart that share a region, for batches in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for batch in batches:
            if not len(batch):
                continue
            rows = batch if last is None else pd.concat([last, batch], ignore_index=True)
            old, last = len(rows) - len(batch), rows.iloc[-NEIGHBOURS:]
            tree, region, cid = rows["tree"].to_numpy(), rows["region"].to_numpy(), rows["cid"].to_numpy()
            for step in range(1, NEIGHBOURS + 1):
                j = np.arange(max(step, old), len(rows))
                i = j - step
                near = (tree[i] == tree[j]) & (region[i] == region[j]) & (cid[i] != cid[j])
                yield _candidates(rows, i[near], j[near], percent)

    return run


def _meet(percent: int):
    """All pairs of classes of a small region, for batches sorted by region."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_groups(batches, ["tree", "region"]):
            group = np.cumsum(group_starts(rows, ["tree", "region"]))
            for step in range(1, LEAF):
                i = np.flatnonzero(group[step:] == group[:-step])
                if not len(i):
                    break
                yield _candidates(rows, i, i + step, percent)

    return run


CELL = ["tree", "region", "ask", "at"]


def _finish(percent: int, depth: int, trees: int):
    """For each cell's asking classes and each component that they aren't in, their best link to it among the cell's other classes.

    Links are those of the sketches: sets of up to ``SKETCH`` shingles are whole in them;
    of larger ones all pairs are returned that may be links. A pair that shares several
    regions counts in the first tree only.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_groups(batches, CELL, 1):
            starts = np.flatnonzero(group_starts(rows, CELL))
            for lo, hi in zip(starts, [*starts[1:], len(rows)]):
                yield from _cell(rows.iloc[lo:hi], percent, depth, trees)

    return run


def _cell(cell: pd.DataFrame, percent: int, depth: int, trees: int) -> Iterator[pd.DataFrame]:
    asks, outside, of, cid, n = (cell[c].to_numpy() for c in ("asks", "outside", "of", "cid", "n"))
    asking, asked = np.flatnonzero(asks), np.flatnonzero(~asks)
    if not len(asking) or not len(asked):
        return
    values = values_of(cell["sig"].tolist())
    regions = regions_of(values, depth, trees)
    sketch = [np.unique(np.frombuffer(x, ">u4").astype(np.uint32)) for x in cell["sketch"]]
    known, code = np.unique(np.concatenate([sketch[k] for k in asked]), return_inverse=True)
    begins = np.cumsum([0, *[len(sketch[k]) for k in asked[:-1]]])
    tree, their, out = int(cell["tree"].iloc[0]), values[asked], []
    for q in asking:
        agree = (their == values[q]).sum(axis=1)
        maybe = (agree >= LEAST_AGREEMENT - (80 - percent) * SIGNATURE // 100) & (of[asked] != of[q]) & (~outside[asked] | (cid[q] < cid[asked]))
        maybe &= 100 * np.minimum(n[asked], n[q]) >= percent * np.maximum(n[asked], n[q])
        at = np.flatnonzero(maybe)
        at = at[(regions[asked[at]] == regions[q]).argmax(axis=1) == tree]
        if not len(at):
            continue
        mark = np.zeros(len(known), bool)
        place = np.searchsorted(known, sketch[q]).clip(max=len(known) - 1)
        mark[place[known[place] == sketch[q]]] = True
        common = np.add.reduceat(mark[code], begins)[at]
        whole = (n[q] <= SKETCH) & (n[asked[at]] <= SKETCH)
        similar = common / (n[q] + n[asked[at]] - common)
        for k in np.flatnonzero(~whole):
            similar[k] = likeness(sketch[q], sketch[asked[at[k]]])
        good = np.where(whole, 100 * common >= percent * (n[q] + n[asked[at]] - common), similar >= percent / 100 - SLACK)
        # of whole sets one link to a component will do
        best: dict[int, int] = {}
        for k in np.flatnonzero(good):
            if not whole[k]:
                out.append((cid[q], cid[asked[at[k]]], int(agree[at[k]])))
            elif of[asked[at[k]]] not in best or similar[k] > similar[best[of[asked[at[k]]]]]:
                best[of[asked[at[k]]]] = k
        out += [(cid[q], cid[asked[at[k]]], int(agree[at[k]])) for k in best.values()]
    if out:
        left, right, agree = (np.array(x) for x in zip(*out))
        yield pd.DataFrame({"a": np.minimum(left, right), "b": np.maximum(left, right), "agree": agree.astype(np.int32)})


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity as two sketches estimate it: by all values up to the end of the shorter one."""
    end = min(x[-1], y[-1])
    x, y = x[: np.searchsorted(x, end, "right")], y[: np.searchsorted(y, end, "right")]
    common = len(np.intersect1d(x, y))
    return common / (len(x) + len(y) - common)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 2, percent: int = 80) -> DataFrame:
    """One row per input row: ``key``, ``n_shingles``, ``component_id``, ``kept``.

    Words are runs of anything but ASCII white space after A-Z are lower-cased; texts
    link if their sets of ``width``-word shingles have a Jaccard similarity of at least
    ``percent`` / 100. Null texts and those without words link with nothing. Rows
    without a key don't link either; they have a null component and are kept. Rows that
    repeat a key are one document. Whole texts are read, however long; of equal
    candidates the order of keys doesn't matter, as all of them are confirmed that would
    join two components. An empty table gives no rows; other columns aren't looked at,
    whatever their names. All links used are confirmed on the full sets.
    """
    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    rows = materialize(source.mapInPandas(_sign(width), f"id {kind}, n bigint, same binary, sig binary"))
    usable = F.col("id").isNotNull() & (F.col("n") > 0)
    classes = rows.where(usable).groupBy("n", "same").agg(F.min("id").alias("rep"), F.first("sig").alias("sig"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()))

    state = _State(source, classes, width, percent)
    part = classes.select("cid", "n", "sig")
    for k, depth in enumerate(DEPTHS):
        rest = _forest(state, part, depth, last=k + 1 == len(DEPTHS))
        if rest is None:
            break
        part = materialize(part.join(rest, "cid", "left_semi"))

    named = classes.select("n", "same", "rep", "cid").join(state.component.withColumnRenamed("node", "cid"), "cid", "left")
    named = named.withColumn("component", F.coalesce("component", "cid"))
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(smallest, "component").select("n", "same", "component_id")
    done = rows.where(usable).join(named, ["n", "same"]).select("id", "n", "component_id")
    alone = rows.where(~usable).select("id", "n", F.col("id").alias("component_id"))
    return done.union(alone).select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    )


def keep_representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that no near copy with a smaller key stands for, with its columns. Rows without a key stay."""
    gone = near_duplicates(docs, key, text, width, percent).where("not kept").select(F.col(key).alias("__gone")).distinct()
    gone = small_side(materialize(gone), BROADCAST_ROWS)
    return docs.join(gone, F.col(key) == F.col("__gone"), "left_anti")


class _State:
    """Components so far, and the full sets of the classes that have been asked for."""

    def __init__(self, source: DataFrame, classes: DataFrame, width: int, percent: int):
        self.source, self.classes, self.width, self.percent = source, classes, width, percent
        spark = source.sparkSession
        self.component = spark.createDataFrame([], "node bigint, component bigint")
        self.sets = spark.createDataFrame([], "cid bigint, shingles array<bigint>")

    def join(self, scored: DataFrame) -> None:
        """Confirm ``scored`` pairs (``a``, ``b``, ``agree``): first each class's best one, then what would still join two components."""
        ends = scored.select("a", "b", "agree", F.explode(F.array("a", "b")).alias("x"))
        wanted = self.apart(scored.select("a", "b")).select(F.explode(F.array("a", "b")).alias("cid")).distinct()
        self.know(wanted)
        best = ends.groupBy("x").agg(F.max_by(F.struct("a", "b"), F.struct("agree", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
        best = materialize(best)
        self.confirm(best)
        self.confirm(scored.select("a", "b").join(best, ["a", "b"], "left_anti"))
        release(best)

    def know(self, wanted: DataFrame) -> None:
        """Read the ``wanted`` classes' sets from the texts that stand for them."""
        wanted = wanted.join(self.sets.select("cid"), "cid", "left_anti")
        wanted = materialize(self.classes.join(wanted, "cid", "left_semi").select("cid", F.col("rep").alias("id"), "same"))
        if wanted.isEmpty():
            release(wanted)
            return
        found = self.source.join(small_side(wanted, BROADCAST_ROWS), "id").select("cid", "same", "text").mapInPandas(_sets(self.width), "cid bigint, shingles array<bigint>")
        self.sets = self.sets.union(materialize(found.groupBy("cid").agg(F.first("shingles").alias("shingles"))))
        release(wanted)

    def apart(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose ends are not yet in one component."""
        of = lambda x: self.component.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}"))
        known = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
        return known.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")

    def confirm(self, pairs: DataFrame) -> None:
        both = self.apart(pairs).join(self.sets.select(F.col("cid").alias("a"), F.col("shingles").alias("sa")), "a")
        both = both.join(self.sets.select(F.col("cid").alias("b"), F.col("shingles").alias("sb")), "b")
        common = F.size(F.array_intersect("sa", "sb"))
        both = both.select("a", "b", common.alias("i"), (F.size("sa") + F.size("sb")).alias("s"))
        links = materialize(both.where(f"100 * i >= {self.percent} * (s - i)").select("a", "b"))
        if not links.isEmpty():
            tree = self.component.select(F.col("node").alias("a"), F.col("component").alias("b"))
            before, self.component = self.component, connected_components(tree.union(links))
            release(before)
        release(links)


def _forest(state: _State, classes: DataFrame, depth: int, last: bool) -> DataFrame | None:
    """Join what one forest finds among ``classes`` (``cid``, ``n``, ``sig``); returns the classes (``cid``) of the regions it leaves to the next, or None."""
    percent, trees = state.percent, trees_for(state.percent, depth)
    pair = "a bigint, b bigint, agree int"
    deal = classes.select("cid", "sig").mapInPandas(_regions(depth, trees), "cid bigint, regions array<bigint>").select("cid", F.posexplode("regions").alias("tree", "region"))
    crowds = materialize(deal.groupBy("tree", "region").agg(F.count("*").alias("crowd")).where("crowd > 1"))
    members = materialize(deal.join(crowds, ["tree", "region"]).join(classes, "cid"))

    by_region = members.where(F.col("crowd") <= LEAF).select("tree", "region", "cid", "n", "sig").repartition("tree", "region").sortWithinPartitions("tree", "region")
    found = by_region.mapInPandas(_meet(percent), pair)
    large = members.where(F.col("crowd") > LEAF).select("tree", "region", "cid", "n", "sig")
    crowded = not large.isEmpty()
    if crowded:
        large = materialize(large.mapInPandas(_paths(depth), "tree int, region bigint, path binary, cid bigint, n bigint, sig binary"))
        order = ["tree", "region", "path", "cid"]
        found = found.union(large.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_neighbours(percent), pair))
    found = materialize(found.distinct())
    state.join(found)
    release(found)
    rest = None
    if crowded:
        placed = large.drop("path").join(state.component.withColumnRenamed("node", "cid"), "cid", "left").withColumn("of", F.coalesce("component", "cid")).drop("component")
        parts = placed.groupBy("tree", "region", "of").agg(F.count("*").alias("k"))
        regions = parts.groupBy("tree", "region").agg(F.max_by("of", F.struct("k", "of")).alias("main"), F.sum("k").alias("total"), F.max("k").alias("most"))
        regions = materialize(regions.withColumn("outside", F.col("total") - F.col("most")).where("outside > 0"))
        if not last:
            huge = regions.where(F.col("outside") * F.col("total") > MOST_COMPARISONS)
            rest = None if huge.isEmpty() else materialize(placed.join(huge.select("tree", "region"), ["tree", "region"], "left_semi").select("cid").distinct())
            regions = regions.where(F.col("outside") * F.col("total") <= MOST_COMPARISONS)
        cells = materialize(placed.join(regions, ["tree", "region"]).withColumn("beside", F.col("of") != F.col("main")).drop("most", "main"))
        state.know(cells.select("cid").distinct())
        sketch = state.sets.select("cid", F.unhex(F.array_join(F.transform(F.slice("shingles", 1, SKETCH), lambda x: F.lpad(F.hex(F.shiftrightunsigned(x, 32)), 8, "0")), "")).alias("sketch"))
        cells = cells.join(sketch, "cid").withColumns({"asked": F.ceil(F.col("outside") / CELL_ROWS).cast("int"), "ats": F.ceil(F.col("total") / CELL_ROWS).cast("int")})
        one = lambda count, seed: F.pmod(F.xxhash64("cid", F.lit(seed)), F.col(count)).cast("int")
        others = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
        columns = [*CELL, "asks", F.col("beside").alias("outside"), "cid", "of", "n", "sig", "sketch"]
        asking = cells.where("beside").withColumn("ask", one("asked", 1)).withColumn("at", others("ats")).withColumn("asks", F.lit(True)).select(*columns)
        asked = cells.withColumn("at", one("ats", 2)).withColumn("ask", others("asked")).withColumn("asks", F.lit(False)).select(*columns)
        cells = asking.union(asked).repartition(*CELL).sortWithinPartitions(*CELL)
        more = materialize(cells.mapInPandas(_finish(percent, depth, trees), pair).distinct())
        state.join(more)
        release(more)
        release(large)
    release(members)
    release(crowds)
    return rest
