"""Helpers of the operators that read texts in Python."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd

words_of = re.compile(r"[^\x20\x09-\x0D]+").findall


def chunks(texts: pd.Series, chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of rows with about ``chars`` characters, one row at least: what a step holds in memory is bounded by that and the longest text."""
    start = held = 0
    for k, t in enumerate(texts):
        n = len(t) if isinstance(t, str) else 0
        if held and held + n > chars:
            yield start, k
            start, held = k, 0
        held += n + 100
    if start < len(texts):
        yield start, len(texts)


def group_starts(frame: pd.DataFrame, by: list[str]) -> np.ndarray:
    """Where a row's ``by`` differ from those of the row before."""
    new = np.zeros(len(frame), bool)
    new[:1] = True
    for c in by:
        values = frame[c].to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return new


def whole_groups(batches: Iterator[pd.DataFrame], by: list[str], rows: int = 50_000) -> Iterator[pd.DataFrame]:
    """Frames of at least ``rows`` rows (but for the last), for batches sorted by ``by``, that never part the rows of a group."""
    held: list[pd.DataFrame] = []
    n = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        n += len(batch)
        if n >= rows:
            frame = pd.concat(held, ignore_index=True) if len(held) > 1 else batch
            last = int(np.flatnonzero(group_starts(frame, by))[-1])
            if last:
                yield frame.iloc[:last]
            held = [frame.iloc[last:].reset_index(drop=True)]
            n = len(held[0])
    if held:
        yield pd.concat(held, ignore_index=True)
