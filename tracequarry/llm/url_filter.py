"""URL filter: rules by host and path, and gradient-boosted trees for the urls that no rule fits.

Features, the rules' lookup and the trees' sums are SQL expressions. The trees are
fitted on all labelled urls: features are cut into bins, and each level of a tree is
chosen from one grouped sum by node, feature and bin, whose rows don't grow with the
table. They are written as nested CASE expressions, so that scoring is one projection
over the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialize, release, small_side

#: (verdict, host and its subdomains, start of the path)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: A table of so many suffixes is broadcast; a longer one is joined as it comes.
BROADCAST_SUFFIXES = 65_536
ROUNDS, LEVELS, BINS, STEP = 12, 3, 32, 0.3
#: Residuals are summed up as whole millionths, so that no sum depends on the order of rows.
UNIT = 1_000_000
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digits", "entropy", "parameters", "hyphens", "secure", "suffix_rate", "suffix_weight")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    return F.when(at > 0, F.substring(F.coalesce(url, F.lit("")), at + 3, F.length(F.coalesce(url, F.lit(""))))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(the longest rule that fits, as host and path; its verdict): null if none fits. Of equally long ones the last."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, domain, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(start)
        name = F.when(fits, F.lit(f"{domain}{start}")).otherwise(name)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def suffix_of(host: Column) -> Column:
    """The last two labels of the host."""
    return F.substring_index(host, ".", -2)


def entropy(text: Column) -> Column:
    """Bits per character, over the distinct characters."""
    n = F.greatest(F.length(text), F.lit(1))
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    each = F.transform(F.array_distinct(F.split(text, "")), lambda c: F.when(c == "", 0.0).otherwise(-share(c) * F.log2(share(c))))
    return F.aggregate(each, F.lit(0.0), lambda a, b: a + b)


def features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Lexical features; those of the suffix come from ``suffix_statistics``."""
    whole = F.coalesce(url, F.lit(""))
    size = F.length(whole)
    count = lambda what: F.regexp_count(whole, F.lit(what))
    return {
        "length": size.cast("double"),
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "depth": F.regexp_count(path, F.lit("/+[^/]")).cast("double"),
        "labels": F.size(F.split(host, r"\.")).cast("double"),
        "digits": count("[0-9]") / F.greatest(size, F.lit(1)),
        "entropy": entropy(whole),
        "parameters": count(r"[?&][^?&#=]+=").cast("double"),
        "hyphens": F.regexp_count(host, F.lit("-")).cast("double"),
        "secure": F.lower(whole).startswith("https").cast("double"),
    }


def suffix_statistics(labelled: DataFrame) -> DataFrame:
    """(``suffix``, ``suffix_rate``, ``suffix_weight``) of every suffix: share of blocked urls, smoothed, and log count."""
    total = labelled.agg((F.sum(F.col("y") * F.col("weight")) / F.sum("weight")).alias("mean"))
    counts = labelled.groupBy("suffix").agg(F.sum("weight").alias("n"), F.sum(F.col("y") * F.col("weight")).alias("blocked"))
    return counts.crossJoin(F.broadcast(total)).select(
        "suffix", ((F.col("blocked") + F.lit(10.0) * F.col("mean")) / (F.col("n") + F.lit(10.0))).alias("suffix_rate"), F.log1p("n").alias("suffix_weight")
    )


def cut_points(labelled: DataFrame) -> list[list[float]]:
    """For each of ``FEATURES`` the rising values, at most ``BINS`` - 1, that part the weight of ``labelled`` evenly.

    Values are counted with ten binary digits, rounded up.
    """
    step = lambda x: F.pow(F.lit(2.0), F.floor(F.log2(x)) - 9)
    near = lambda x: F.when(x > 0, F.ceil(x / step(x)) * step(x)).otherwise(F.lit(0.0))
    values = F.array(*[F.struct(F.lit(k).alias("feature"), near(F.col(c)).alias("value")) for k, c in enumerate(FEATURES)])
    counts = labelled.select("weight", F.explode(values).alias("v")).groupBy("v.feature", "v.value").agg(F.sum("weight").alias("n"))
    own = Window.partitionBy("feature")
    below = F.sum("n").over(own.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.select("feature", "value", F.floor(below * BINS / F.sum("n").over(own)).alias("part"))
    cuts: list[list[float]] = [[] for _ in FEATURES]
    for r in ranked.where((F.col("part") > 0) & (F.col("part") < BINS)).groupBy("feature", "part").agg(F.min("value").alias("value")).collect():
        cuts[r["feature"]].append(r["value"])
    return [sorted(c) for c in cuts]


def bin_of(value: Column, cuts: list[float]) -> Column:
    """How many of the rising ``cuts`` are below ``value``."""

    def walk(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value <= F.lit(cuts[middle]), walk(low, middle)).otherwise(walk(middle + 1, high))

    return walk(0, len(cuts))


def tree_case(splits: dict[int, tuple[int, int]], goes_left: Callable[[int, int], Column], leaf: Callable[[int], Column], node: int = 1) -> Column:
    """``leaf`` of the node that a row falls to. The children of node n are 2n and 2n + 1; a split is a feature and the last bin on the left."""
    if node not in splits:
        return leaf(node)
    return F.when(goes_left(*splits[node]), tree_case(splits, goes_left, leaf, 2 * node)).otherwise(tree_case(splits, goes_left, leaf, 2 * node + 1))


def best_split(bins: dict[tuple[int, int], tuple[int, int]]) -> tuple[int, int, tuple[int, int], tuple[int, int]] | None:
    """From (weight, sum) by (feature, bin), of one node: the split that lowers the squared error most, as feature, last bin on the left, and (weight, sum) of either side."""
    found, least = None, 1e-9
    for feature in range(len(FEATURES)):
        own = sorted((b, w, s) for (f, b), (w, s) in bins.items() if f == feature)
        weight, total = sum(w for _, w, _ in own), sum(s for _, _, s in own)
        w_left = s_left = 0
        for b, w, s in own[:-1]:
            w_left, s_left = w_left + w, s_left + s
            w_right, s_right = weight - w_left, total - s_left
            gain = ((s_left / UNIT) ** 2 / w_left + (s_right / UNIT) ** 2 / w_right - (total / UNIT) ** 2 / weight) / weight
            if gain > least:
                found, least = (feature, b, (w_left, s_left), (w_right, s_right)), gain
    return found


def grow(binned: DataFrame, residual: Column) -> tuple[dict[int, tuple[int, int]], dict[int, float]]:
    """A tree of ``LEVELS`` levels for ``residual``: its splits, and the mean residual of each node that was split off."""
    bin_below = lambda f, k: F.col(f"b{f}") <= k
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("f"), F.col(f"b{k}").alias("b")) for k in range(len(FEATURES))]))
    splits, values, ended = {}, {1: 0.0}, [1]
    for _ in range(LEVELS):
        rows = binned.select(tree_case(splits, bin_below, F.lit).alias("node"), "weight", (F.round(residual * UNIT).cast("bigint") * F.col("weight")).alias("s"), cells.alias("c"))
        sums = rows.where(F.col("node").isin(ended)).groupBy("node", "c.f", "c.b").agg(F.sum("weight").alias("w"), F.sum("s").alias("s"))
        nodes: dict[int, dict] = {}
        for r in sums.collect():  # at most 2 ** (LEVELS - 1) * len(FEATURES) * BINS rows
            nodes.setdefault(r["node"], {})[r["f"], r["b"]] = (r["w"], r["s"])
        ended = []
        for node in sorted(nodes):
            if node == 1:
                own = [x for (f, _), x in nodes[1].items() if f == 0]
                values[1] = sum(s for _, s in own) / UNIT / sum(w for w, _ in own)
            found = best_split(nodes[node])
            if found:
                splits[node] = found[:2]
                for child, (w, s) in zip((2 * node, 2 * node + 1), found[2:]):
                    values[child] = s / UNIT / w
                    ended.append(child)
        if not ended:
            break
    return splits, values


def fit(labelled: DataFrame) -> Column:
    """The trees for ``labelled`` (``FEATURES``, ``y`` and ``weight``), as a sum to be compared with 0; a constant if one class is missing.

    Gradient boosting with the logistic loss: the first tree is fitted to the labels, 1 and -1, each other one to the loss's residuals.
    """
    classes = [r["y"] for r in labelled.groupBy("y").agg(F.count("*")).collect()]
    if len(classes) < 2:
        return F.lit(1.0 if classes and classes[0] == 1.0 else -1.0)
    cuts = cut_points(labelled)
    bins = [bin_of(F.col(c), cuts[k]).cast("int").alias(f"b{k}") for k, c in enumerate(FEATURES)]
    binned = materialize(labelled.select((F.col("y") * 2 - 1).alias("sign"), F.col("weight").cast("bigint").alias("weight"), *bins))
    sign, so_far, total = F.col("sign"), F.lit(0.0), F.lit(0.0)
    for k in range(ROUNDS):
        splits, values = grow(binned, 4 * sign / (1 + F.exp(2 * sign * so_far)) if k else sign)
        if not splits:
            break
        leaf = lambda node: F.lit((STEP if k else 1.0) * values[node])  # noqa: B023, E731
        so_far = so_far + tree_case(splits, lambda f, b: F.col(f"b{f}") <= b, leaf)
        total = total + tree_case(splits, lambda f, b: F.col(FEATURES[f]) <= F.lit(cuts[f][b]), leaf)
    release(binned)
    return total


def judge_urls(pages: DataFrame, key: str = "page_id", url: str = "url", rules=RULES, labelled: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """One row per page: ``key``, ``host``, ``path``, ``rule``, ``verdict``, ``score``.

    The longest rule that fits decides. Without one the trees do: ``block`` if
    ``score`` is above 0. They learn from ``labelled`` (``url``, ``y``: 1 to block),
    by default from the urls that the rules judge, from all distinct ones, each with its
    number of rows as weight; the trees from about ``most`` of them where that is given.
    With labels of one class only, all is judged like it; without any, allowed. Null
    urls have empty parts; urls of any length are read whole. Repeated rows give repeated
    results, an empty table none; other columns aren't looked at, whatever their names.
    """
    address = F.col("__url")
    rows = pages.select(F.col(key).alias("__key"), F.col(url).alias("__url"))
    rows = rows.withColumns({"host": host_of(address), "path": path_of(address)})
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "ruled": verdict, "suffix": suffix_of(F.col("host"))})
    if labelled is None:
        known = rows.where("ruled is not null").withColumn("y", (F.col("ruled") == "block").cast("double"))
    else:
        known = labelled.select(F.col("url").alias("__url"), F.col("y").cast("double").alias("y")).where("__url is not null and y is not null")
        known = known.withColumns({"host": host_of(address), "path": path_of(address)}).withColumn("suffix", suffix_of(F.col("host")))
    known = materialize(known.groupBy("__url", "host", "path", "suffix", "y").agg(F.count("*").cast("double").alias("weight")))
    suffixes = materialize(suffix_statistics(known))
    mean = known.agg(F.sum(F.col("y") * F.col("weight")) / F.sum("weight")).first()[0]
    defaults = {"suffix_rate": float(mean if mean is not None else 0.0), "suffix_weight": 0.0}
    small = small_side(suffixes, BROADCAST_SUFFIXES)
    with_suffix = lambda df: df.join(small, "suffix", "left").fillna(defaults)
    learnt = known
    if most is not None:
        chance = F.pmod(F.xxhash64("__url", F.lit("sample")), F.lit(1_000_000)) / 1_000_000
        learnt = known.where(chance < min(1.0, most / max(1, known.count())))
    learnt = with_suffix(learnt.withColumns(features(address, F.col("host"), F.col("path"))))
    learnt = materialize(learnt.select("y", "weight", *FEATURES))
    total = fit(learnt)
    release(learnt)
    scored = with_suffix(rows.withColumns(features(address, F.col("host"), F.col("path")))).withColumn("score", total)
    return scored.select(
        F.col("__key").alias(key), "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score",
    )

