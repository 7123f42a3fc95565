"""Language-model scoring by context-tree weighting over bytes.

Each byte is eight binary decisions. A decision has a node in every context of up to
``DEPTH`` bytes before it; a node's counts give a Krichevsky-Trofimov estimate, and the
tree mixes the estimates of all depths by how well each explains the training texts.
The estimate of a node depends on its counts alone, so the tree is built from counts of
byte sequences, in any order: sequences that share their last two context bytes are one
subtree, and what lies above is at most 256 x 256 nodes.

Nothing of corpus size is broadcast, unless its rows have been counted to be few. Texts are dealt into blocks of a bounded number
of bytes; each block sends its distinct words and byte sequences once, sorted and packed,
dealt into ``BUCKETS``. A bucket is counted and valued over all blocks, each block's rows
come back with their values, and the block is scored with them as its texts stream by.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, materialize
from .text import chunks, words_of

DEPTH = 6
BLOCK_BYTES = 64_000_000
#: Up to so many distinct byte sequences, 1.6 MB, are sent to all tasks at once; beyond that blocks ask for theirs, as for words.
BROADCAST_GRAMS = 100_000
#: Words have the first ``BUCKETS`` buckets, by their keys, byte sequences as many after them, by their last two context bytes.
BUCKETS = 512
#: Byte sequences that are made into nodes at once, at least.
RUN = 50_000
END = "\nend"  # no word holds white space
END_BYTE = b"\xff"  # in no UTF-8 text


def word_keys(words) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in words), np.uint64, len(words))


def lowered(texts) -> list[str]:
    return [t.translate(ASCII_LOWER) if isinstance(t, str) else "" for t in texts]


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, index of the key, keys) of all tokens: words, then one end for each text."""
    lists = [[*words_of(t), END] for t in texts]
    index, unique = pd.factorize(np.array([w for x in lists for w in x], dtype=object))
    return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), index, word_keys(unique)


def gram_runs(texts: list[str], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, starts, documents) of at most 256 texts: distinct keys in order, where each one's run begins, and the text of each occurrence.

    A key is a byte of a text, or the end byte, with the ``depth`` bytes before it; zeros
    before the start. At depth 6 a key and its text's number fill 64 bits, so that one
    sort puts them in order.
    """
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(bytes(depth) + r + END_BYTE for r in raw), np.uint8)
    sizes = np.array([len(r) + 1 for r in raw], np.int64)
    key = np.zeros(len(data) - depth, np.uint64)
    for k in range(depth + 1):
        key = (key << np.uint64(8)) | data[k : len(data) - depth + k]
    at = np.arange(sizes.sum()) + np.repeat(np.arange(len(raw)) * depth, sizes)
    both = (key[at] << np.uint64(8)) | np.repeat(np.arange(len(raw), dtype=np.uint64), sizes)
    both.sort()
    key = both >> np.uint64(8)
    starts = run_starts(key)
    return key[starts], starts, (both & np.uint64(255)).astype(np.int64)


def run_starts(ordered: np.ndarray) -> np.ndarray:
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return np.flatnonzero(new)


def gram_chunks(texts: pd.Series) -> Iterator[tuple[int, int]]:
    """``chunks`` of at most 256 texts."""
    for lo, hi in chunks(texts):
        for k in range(lo, hi, 256):
            yield k, min(hi, k + 256)


def packed(values: np.ndarray, rising: bool = False) -> bytes:
    """64-bit values, or the steps between them, by place of the byte and deflated."""
    values = np.diff(values, prepend=np.uint64(0)) if rising else values
    return zlib.compress(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(data: bytes, rising: bool = False) -> np.ndarray:
    values = np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(values, dtype=np.uint64) if rising else values


def summed(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    keys, n = np.concatenate([k for k, _ in found]), np.concatenate([n for _, n in found])
    order = np.argsort(keys)
    keys = keys[order]
    starts = run_starts(keys)
    return keys[starts], np.add.reduceat(n[order], starts) if len(starts) else n


class Tally:
    """Sums of counts by key; what is held grows with the distinct keys."""

    def __init__(self):
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        self.rows, self.least = 0, 2_000_000

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.found.append((keys, n))
        self.rows += len(keys)
        if self.rows > self.least:
            self.found = [self.total()]
            self.rows = len(self.found[0][0])
            self.least = max(2_000_000, 2 * self.rows)

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        return summed(self.found) if self.found else (np.empty(0, np.uint64), np.empty(0, np.int64))


def bucket_of(keys: np.ndarray, grams: bool) -> np.ndarray:
    if grams:
        keys = (keys >> np.uint64(8) & np.uint64(65535)) * np.uint64(0x9E3779B97F4A7C15)
    return (keys >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64) + BUCKETS * grams


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x > 0, by Stirling's series after a shift to 8 and above."""
    x = np.asarray(x, np.float64)
    shift = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        shift = shift - np.where(low, np.log(np.where(low, x, 1.0)), 0.0)
        x = np.where(low, x + 1, x)
    y = 1 / (x * x)
    series = (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y * (1 / 1680 - y / 1188)))) / x
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + series + shift


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - math.log(math.pi)


def mixture(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ln of the weighted probability, share of the node's own estimate) for ln probabilities of the node and of all below it."""
    both = np.logaddexp(own, below) - math.log(2)
    return both, np.exp(own - math.log(2) - both)


class Subtree:
    """The nodes of depths 2 to ``depth`` for byte sequences ``key`` with counts ``n``; sequences that share two context bytes must be together."""

    def __init__(self, key: np.ndarray, n: np.ndarray, depth: int = DEPTH):
        self.depth = depth
        step = np.arange(8)
        byte = (key & 255)[:, None]
        self.bit = ((byte >> (7 - step)) & 1).astype(np.int8)
        self.place = (1 << step) | (byte >> (8 - step))
        self.context = key >> 8
        weight = np.repeat(n.astype(np.float64), 8)
        node = ((self.context[:, None] << 8) | self.place).ravel()
        ones = self.bit.ravel() == 1
        names, where = np.unique(node, return_inverse=True)
        a = np.bincount(where, weight * ~ones, len(names))
        b = np.bincount(where, weight * ones, len(names))
        self.levels = []
        log_p = log_kt(a, b)
        self.levels.append((where, a, b, np.ones(len(a))))
        for level in range(depth - 1, 1, -1):
            mask = (1 << (8 * level)) - 1
            above, up = np.unique((((names >> 8) & mask) << 8) | (names & 255), return_inverse=True)
            a, b = np.bincount(up, a, len(above)), np.bincount(up, b, len(above))
            log_p, share = mixture(log_kt(a, b), np.bincount(up, log_p, len(above)))
            where, names = up[where], above
            self.levels.append((where, a, b, share))
        self.top = pd.DataFrame({"context": (names >> 8) & 255, "place": names & 255, "a": a, "b": b, "log_p": log_p})

    def below(self) -> np.ndarray:
        """(sequence, bit) probability of each bit as the nodes from depth 2 on mix it."""
        p = None
        for where, a, b, share in self.levels:
            one = ((b + 0.5) / (a + b + 1.0))[where]
            own = np.where(self.bit.ravel() == 1, one, 1 - one)
            p = own if p is None else share[where] * own + (1 - share[where]) * p
        return p.reshape(self.bit.shape)

    def log_p(self, upper: Upper) -> np.ndarray:
        """ln of the probability of each sequence's last byte."""
        p = self.below()
        last = self.context & 255
        for where, share, one in ((last[:, None] * 256 + self.place, upper.share_1, upper.one_1), (self.place, upper.share_0, upper.one_0)):
            own = np.where(self.bit == 1, one[where], 1 - one[where])
            p = share[where] * own + (1 - share[where]) * p
        return np.log(p).sum(axis=1)


class Upper:
    """The nodes of depths 1 (256 contexts of 256 places) and 0, from sums over the subtrees' topmost nodes."""

    def __init__(self, top: pd.DataFrame):
        at = top["context"].to_numpy(np.int64) * 256 + top["place"].to_numpy(np.int64)
        a, b, below = (np.bincount(at, top[c].to_numpy(np.float64), 65536) for c in ("a", "b", "log_p"))
        log_p, self.share_1 = mixture(log_kt(a, b), below)
        self.one_1 = (b + 0.5) / (a + b + 1.0)
        a, b, below = (x.reshape(256, 256).sum(axis=0) for x in (a, b, log_p))
        _, self.share_0 = mixture(log_kt(a, b), below)
        self.one_0 = (b + 0.5) / (a + b + 1.0)


def subtrees(key: np.ndarray, n: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, Subtree]]:
    """(where in ``key``, their nodes) of runs of byte sequences that never part what shares two context bytes."""
    g = key >> np.uint64(8) & np.uint64(65535)
    order = np.argsort(g, kind="stable")
    starts, lo = run_starts(g[order]), 0
    for hi in [*starts[1:], len(key)]:
        if hi - lo >= RUN or hi == len(key):
            at = order[lo:hi]
            yield at, Subtree(key[at].astype(np.int64), n[at], depth)
            lo = hi


def whole_buckets(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, list[tuple[int, bytes]], np.ndarray, np.ndarray]]:
    """(bucket, [(block, its packed keys)], distinct keys, counts), for batches sorted by bucket."""
    bucket, asked, tally = None, [], Tally()
    for batch in batches:
        for own, block, keys, n in zip(batch["bucket"], batch["block"], batch["keys"], batch["n"]):
            if own != bucket:
                if asked:
                    yield bucket, asked, *tally.total()
                bucket, asked, tally = own, [], Tally()
            asked.append((block, keys))
            tally.add(unpacked(keys, rising=True), unpacked(n).astype(np.int64))
    if asked:
        yield bucket, asked, *tally.total()


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 10, depth: int = DEPTH) -> DataFrame:
    """One row per document: ``key``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``, ``bits_per_byte``.

    The model learns from all texts whose crc32(``key`` as text) isn't divisible by
    ``folds``; the others are held out. A null key counts as an empty text and is held
    out. Null texts are empty: one end token and one end byte. ``score`` is the log10
    probability of the lower-cased text's bytes and the end; ``base_score`` that of a
    smoothed unigram model over the words and the end. Without training texts both fall
    back to their priors. Repeated rows count each; an empty table gives no rows.
    """
    if not 2 <= depth <= 6:
        raise ValueError("depth must be from 2 to 6")
    kind = docs.schema[key].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    rows = docs.select(
        F.col(key).alias("id"), F.col(text).alias("text"),
        (F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds == 0).alias("held_out"),
        F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(blocks)).cast("int").alias("block"),
    )

    def sent(block: int, tallies: tuple[Tally, Tally]) -> Iterator[pd.DataFrame]:
        for grams, tally in enumerate(tallies):
            keys, n = tally.total()
            buckets = bucket_of(keys, bool(grams))
            order = np.argsort(buckets, kind="stable")
            keys, n, buckets = keys[order], n[order], buckets[order]
            starts = run_starts(buckets)
            out = [(np.int32(block), np.int32(buckets[lo]), packed(keys[lo:hi], rising=True), packed(n[lo:hi])) for lo, hi in zip(starts, [*starts[1:], len(keys)])]
            yield pd.DataFrame(out, columns=["block", "bucket", "keys", "n"])

    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, tallies = None, (Tally(), Tally())
        for batch in batches:
            for block, own in batch.groupby("block"):
                if block != at:
                    if at is not None:
                        yield from sent(at, tallies)
                    at, tallies = block, (Tally(), Tally())
                for lo, hi in gram_chunks(own["text"]):
                    part = own.iloc[lo:hi]
                    texts, train = lowered(part["text"]), ~part["held_out"].to_numpy(bool)
                    doc, index, keys = tokens(texts)
                    order = np.argsort(keys)
                    tallies[0].add(keys[order], np.bincount(index, train[doc], len(keys)).astype(np.int64)[order])
                    keys, starts, doc = gram_runs(texts, depth)
                    tallies[1].add(keys, np.add.reduceat(train[doc].astype(np.int64), starts))
        if at is not None:
            yield from sent(at, tallies)

    dealt = rows.repartition(blocks, "block").sortWithinPartitions("block")
    seen = materialize(dealt.mapInPandas(collect, "block int, bucket int, keys binary, n binary"))
    by_bucket = seen.repartition("bucket").sortWithinPartitions("bucket")

    def tops(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The subtrees' topmost nodes; besides, as context -1, tokens and words learnt, as -2 distinct byte sequences."""
        for bucket, _, keys, n in whole_buckets(batches):
            if bucket < BUCKETS:
                yield pd.DataFrame({"context": [-1], "place": [0], "a": [float(n.sum())], "b": [float((n > 0).sum())], "log_p": [0.0]})
            else:
                yield pd.DataFrame({"context": [-2], "place": [0], "a": [float(len(keys))], "b": [0.0], "log_p": [0.0]})
                for _, tree in subtrees(keys, n, depth):
                    yield tree.top.groupby(["context", "place"], as_index=False).sum()

    top = by_bucket.mapInPandas(tops, "context bigint, place bigint, a double, b double, log_p double")
    top = top.groupBy("context", "place").agg(*[F.sum(c).alias(c) for c in ("a", "b", "log_p")]).toPandas()  # at most 256 x 255 rows and two
    known, distinct = top[top["context"] == -1], top[top["context"] == -2]
    train_tokens, vocabulary = int(known["a"].sum()), int(known["b"].sum())
    upper = Upper(top[top["context"] >= 0])
    floor = math.log10(train_tokens + 0.1 * (vocabulary + 1))

    def valued(bucket: int, keys: np.ndarray, n: np.ndarray) -> np.ndarray:
        if bucket < BUCKETS:
            return n.astype(np.float64)
        value = np.empty(len(keys))
        for at, tree in subtrees(keys, n, depth):
            value[at] = tree.log_p(upper)
        return value

    few = None
    if distinct["a"].sum() <= BROADCAST_GRAMS:

        def table(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for bucket, _, keys, n in whole_buckets(batches):
                yield pd.DataFrame({"key": keys.astype(np.int64), "value": valued(bucket, keys, n)})

        found = by_bucket.where(F.col("bucket") >= BUCKETS).mapInPandas(table, "key bigint, value double").toPandas().sort_values("key")
        few = docs.sparkSession.sparkContext.broadcast((found["key"].to_numpy().astype(np.uint64), found["value"].to_numpy()))
        by_bucket = by_bucket.where(F.col("bucket") < BUCKETS)

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for bucket, asked, keys, n in whole_buckets(batches):
            value = valued(bucket, keys, n)
            for block, own in asked:
                found = value[np.searchsorted(keys, unpacked(own, rising=True))]
                yield pd.DataFrame({"block": [np.int32(block)], "bucket": [np.int32(bucket)], "keys": [own], "value": [found.tobytes()]})

    # each block's answers, then its texts; keys in an array, empty for null, as pandas turns whole numbers among nulls into doubles
    answers = by_bucket.mapInPandas(answer, "block int, bucket int, keys binary, value binary")
    both = answers.unionByName(rows.withColumns({"bucket": F.lit(2 * BUCKETS), "id": F.array_compact(F.array("id"))}), allowMissingColumns=True)
    both = both.repartition(blocks, "block").sortWithinPartitions("block", "bucket")

    def looked_up(found: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([unpacked(k, rising=True) for k, _ in found] or [np.empty(0, np.uint64)])
        value = np.concatenate([np.frombuffer(v) for _, v in found] or [np.empty(0)])
        order = np.argsort(keys)
        return keys[order], value[order]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, look = None, ([], []), None
        for batch in batches:
            for block, own in batch.groupby("block"):
                if block != at:
                    at, held, look = block, ([], []), None
                told = own[own["bucket"] < 2 * BUCKETS]
                for bucket, keys, value in zip(told["bucket"], told["keys"], told["value"]):
                    held[bucket >= BUCKETS].append((keys, value))
                own = own[own["bucket"] == 2 * BUCKETS]
                if len(own) and look is None:
                    look = [looked_up(x) for x in held]
                    held = ([], [])
                    if few is not None:
                        look[1] = few.value
                for lo, hi in gram_chunks(own["text"]):
                    part = own.iloc[lo:hi]
                    texts = lowered(part["text"])
                    doc, index, keys = tokens(texts)
                    c = look[0][1][np.searchsorted(look[0][0], keys)][index]
                    keys, starts, place = gram_runs(texts, depth)
                    value = look[1][1][np.searchsorted(look[1][0], keys)]
                    nats = np.bincount(place, np.repeat(value, np.diff(starts, append=len(place))), len(part))
                    yield pd.DataFrame(
                        {
                            "id": part["id"].to_numpy(),
                            "held_out": part["held_out"].to_numpy(),
                            "n_tokens": np.bincount(doc, minlength=len(part)),
                            "n_known": np.bincount(doc, c > 0, len(part)).astype(np.int64),
                            "train_tokens": train_tokens,
                            "base_score": np.bincount(doc, np.log10(c + 0.1) - floor, len(part)),
                            "score": nats / math.log(10),
                            "bits_per_byte": -nats / math.log(2) / np.bincount(place, minlength=len(part)),
                        }
                    )

    schema = f"id array<{kind}>, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double"
    return both.mapInPandas(score, schema).withColumn("id", F.get("id", F.lit(0))).withColumnRenamed("id", key)
