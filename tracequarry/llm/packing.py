"""Packing token sequences by minimum bin slack.

A document's tokens are cut into pieces of the full capacity and one remainder. How
many pieces there are of each length is a table of at most ``capacity`` rows, and that
is all that the packing needs: windows are filled one pattern at a time, and a pattern
is repeated as often as its lengths allow. A window starts with the longest remaining
length; a bitset subset-sum over the other lengths and their counts finds the sums that
fit beside it, and the best one is traced back to counts. The plan has a few rows for
each length; every piece finds its place in it by its length and its rank among pieces
of that length. The rank is its number within the task that cut it, written beside it,
plus what earlier tasks have of that length: it doesn't depend on how the written table
is read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

CAPACITY = 1024

_encoders: dict[str, Callable[[str], np.ndarray]] = {}


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes with: printable ones as themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Text to the ids that ``tokenizers`` gives without special tokens added; special tokens written in a text have their own ids.

    The file's vocabulary is run by tiktoken, which gives the same ids several times as
    fast; by ``tokenizers`` itself if the file isn't of that kind or tiktoken is missing.
    """
    if path not in _encoders:
        _encoders[path] = _fast(path) or _plain(path)
    return _encoders[path]


def _fast(path: str) -> Callable[[str], np.ndarray] | None:
    try:
        import tiktoken
        from public_tokenizers import PATTERN
    except ImportError:
        return None
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    pre = spec.get("pre_tokenizer") or {}
    if spec["model"].get("type", "BPE") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
        return None
    added = spec.get("added_tokens", [])
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added):
        return None
    alphabet = byte_alphabet()
    special = {t["content"]: t["id"] for t in added}
    ranks = {bytes(alphabet[c] for c in token): k for token, k in spec["model"]["vocab"].items() if token not in special}
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: own.encode_to_numpy(text, allowed_special="all")


def _plain(path: str) -> Callable[[str], np.ndarray]:
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    return lambda text: np.array(own.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def fill(counts: dict[int, int], target: int) -> tuple[int, dict[int, int]]:
    """The multiset of lengths, at most ``counts`` of each, with the largest sum up to ``target``; of equal ones that of the longest lengths."""
    reach, steps, mask = 1, [], (1 << (target + 1)) - 1
    for length in sorted((k for k in counts if k <= target), reverse=True):
        steps.append((length, reach))
        left, take = min(counts[length], target // length), 1
        while left > 0:
            take = min(take, left)
            reach |= (reach << (length * take)) & mask
            left -= take
            take *= 2
        if reach >> target & 1:
            break
    return reach, _trace(steps, reach.bit_length() - 1)


def _trace(steps: list[tuple[int, int]], total: int) -> dict[int, int]:
    chosen = {}
    for length, before in reversed(steps):
        n = 0
        while not before >> (total - n * length) & 1:
            n += 1
        if n:
            chosen[length] = n
            total -= n * length
    return chosen


def _fill_power(counts: dict[int, int], seed: int, capacity: int) -> dict[int, int]:
    """What goes beside ``seed``: to the capacity, else to a power of two, which needs no padding, else as near to the capacity as can be."""
    reach, best = fill(counts, capacity - seed)
    if reach >> (capacity - seed) & 1:
        return best
    power = 1 << (capacity.bit_length() - 1)
    while power >= seed:
        if power <= capacity and reach >> (power - seed) & 1:
            return fill(counts, power - seed)[1]
        power >>= 1
    return best


def bin_patterns(counts: dict[int, int], capacity: int = CAPACITY) -> Iterator[tuple[dict[int, int], int]]:
    """Patterns (length: count) and how often each is used; together they use up ``counts``."""
    left = {k: n for k, n in counts.items() if n > 0}
    while left:
        seed = max(left)
        others = {k: n - (k == seed) for k, n in left.items() if n > (k == seed)}
        pattern = _fill_power(others, seed, capacity)
        pattern[seed] = pattern.get(seed, 0) + 1
        times = min(left[k] // n for k, n in pattern.items())
        yield pattern, times
        for k, n in pattern.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]


def plan_rows(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, from rank, to rank, per sequence, first sequence, offset) for each length of each pattern."""
    rows, used, sequence = [], dict.fromkeys(counts, 0), 0
    for pattern, times in bin_patterns(counts, capacity):
        offset = 0
        for length in sorted(pattern, reverse=True):
            n = pattern[length]
            rows.append((length, used[length], used[length] + n * times, n, sequence, offset))
            used[length] += n * times
            offset += n * length
        sequence += times
    return rows


def padded(used: int, capacity: int = CAPACITY) -> int:
    """What a sequence of ``used`` tokens is padded to."""
    return used if used & (used - 1) == 0 else capacity


def pieces(docs: DataFrame, key: str, text: str, tokenizer: str, separator: int, capacity: int, with_ids: bool) -> DataFrame:
    """(``id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``part``, ``nth``[, ``ids``]) of every piece.

    ``part`` is the task that cut it, ``nth`` how many pieces of its length that task cut before it.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer)
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            out = []
            for k, t in enumerate(batch["text"]):
                ids = np.append(encode(t) if isinstance(t, str) and t else np.empty(0, "<u4"), separator).astype("<u4")
                raw = memoryview(ids.tobytes())
                for start in range(0, len(ids), capacity):
                    piece = raw[4 * start : 4 * (start + capacity)]
                    length = len(piece) // 4
                    out.append((k, start, length, zlib.crc32(piece), len(ids), part, seen[length], *([ids[start : start + capacity].astype(np.int32)] if with_ids else [])))
                    seen[length] += 1
            names = ["k", "start", "length", "ids_crc32", "doc_tokens", "part", "nth", *["ids"] * with_ids]
            frame = pd.DataFrame(out, columns=names)
            frame.insert(0, "id", batch["id"].to_numpy(object)[frame["k"].to_numpy(np.int64)])
            yield frame.drop(columns="k")

    schema = f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, part int, nth bigint" + ", ids array<int>" * with_ids
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInPandas(run, schema)


def pack(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", separator: int = 0, capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """One row per piece: ``key``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``, and ``ids`` if asked for.

    Each document is its ids and then ``separator``; null and empty texts are the
    separator alone; very long ones are cut into as many pieces as they need. Every id
    lies in one piece, and pieces lie in their sequence without gaps from offset 0.
    Which of equally long pieces goes where follows from the order in which they are
    read. Repeated rows and null keys are packed once each; an empty table gives no
    rows; other columns aren't looked at.
    """
    rows = materialize(pieces(docs, key, text, tokenizer, separator, capacity, with_ids))
    counts = materialize(rows.groupBy("length", "part").agg(F.count("*").alias("n")))
    histogram: dict[int, int] = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan: dict[int, list[tuple]] = {}
    for length, lo, _, each, first, place in plan_rows(histogram, capacity):
        plan.setdefault(length, []).append((lo, each, first, place))
    tables = {length: np.array(own, np.int64).T for length, own in plan.items()}  # by rising lo
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = rows.join(base, ["length", "part"]).withColumn("rank", F.col("nth") + F.col("base")).drop("part", "nth", "base")

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for own in np.unique(length):
                at = np.flatnonzero(length == own)
                lo, each, first, place = tables[int(own)]
                k = np.searchsorted(lo, rank[at], "right") - 1
                sequence[at] = first[k] + (rank[at] - lo[k]) // each[k]
                offset[at] = place[k] + (rank[at] - lo[k]) % each[k] * own
            yield batch.assign(sequence_id=sequence, offset=offset)[names]

    kinds = dict(ranked.dtypes) | {"sequence_id": "bigint", "offset": "bigint"}
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
    out = ranked.withColumn("id", F.array_compact(F.array("id")))  # pandas turns whole numbers among nulls into doubles
    schema = ", ".join(f"{c} {'array<' + kinds[c] + '>' if c == 'id' else kinds[c]}" for c in names)
    return out.mapInPandas(placed, schema).withColumn("id", F.get("id", F.lit(0))).withColumnRenamed("id", key)
