"""Row-by-row recursions that SQL windows cannot express, run through Arrow batches.

Rows are hash-partitioned by key, sorted, and streamed: a batch at a time is in
memory and only the current key's state is kept, so the length of a series does
not matter for memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

State = Any
Fold = Callable[[State, pd.DataFrame], tuple[State, pd.DataFrame | None]]


def _runs(batch: pd.DataFrame, keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Consecutive rows of equal key."""
    changed = np.zeros(len(batch), dtype=bool)
    changed[0] = True
    for key in keys:
        column, before = batch[key], batch[key].shift()
        changed |= (column.ne(before) & ~(column.isna() & before.isna())).to_numpy()
    starts = np.flatnonzero(changed)
    for start, end in zip(starts, [*starts[1:], len(batch)]):
        first = batch.iloc[start]
        yield tuple(None if pd.isna(first[k]) else first[k] for k in keys), batch.iloc[start:end]


def folded(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    fold: Fold,
    schema: str,
    begin: Callable[[pd.Series], State] = lambda first_row: None,
    finish: Callable[[tuple, State], dict] | None = None,
) -> DataFrame:
    """Run ``fold(state, rows) -> (state, output rows)`` over each key in order.

    A key's rows may come in several pieces; ``begin`` makes the state its first
    piece starts with.  With ``finish`` the output is instead one row per key,
    made from the key and its final state.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            if batch.empty:
                continue
            outputs = []
            for key, rows in _runs(batch, keys):
                if key != current:
                    if finish is not None and current is not None:
                        outputs.append(pd.DataFrame([finish(current, state)]))
                    current, state = key, begin(rows.iloc[0])
                state, output = fold(state, rows)
                if finish is None:
                    outputs.append(output)
            if outputs:
                yield pd.concat(outputs, ignore_index=True)
        if finish is not None and current is not None:
            yield pd.DataFrame([finish(current, state)])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
