"""Folds over ordered rows of a key, with a bounded carry in place of an array of the key's rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def ordered_fold(rows: DataFrame, keys: list[str], order: list[str], start: Callable, step: Callable, out: str) -> DataFrame:
    """rows with one more column, what step gives for each row: step(state, row's order and other values) returns (state, value).

    Rows of a key come to one task in the order of `order`, sorted by Spark with spilling, and pass in batches; the task holds a batch and the state of one
    key, which starts as start(key values). out: name and type of the column. Rows equal in `order` come in any order.
    """
    name, n_keys = out.split()[0], len(keys)
    columns = list(rows.columns)
    rest = [c for c in columns if c not in keys]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for batch in batches:
            got = []
            for values in zip(*[batch[c].tolist() for c in (*keys, *rest)], strict=True):
                key = tuple(None if x != x else x for x in values[:n_keys])
                if state is None or key != now:
                    now, state = key, start(*key)
                state, value = step(state, *values[n_keys:])
                got.append(value)
            yield batch.assign(**{name: pd.Series(got, index=batch.index, dtype=object)})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, f"{kinds}, {out}")
