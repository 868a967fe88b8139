"""Folds over rows in order, one group after the other, with state that is carried and output that is streamed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], schema: str, fold: Callable[[], Callable[[dict[str, list]], dict[str, list]]]) -> DataFrame:
    """``fold()`` makes a group's function; it gets the group's rows in order, in one piece or several, as lists by column, and returns lists by column of ``schema``.

    A group goes to one task, sorted there outside of memory; of its rows only
    a batch is held, and of its past only what the function keeps.  Null keys
    are a group.  A batch gives one frame, however many groups it has, so small
    groups cost little more than their rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, step = None, None
        for batch in batches:
            if not len(batch):
                continue
            # groups are runs of equal keys
            starts = (batch[keys].ne(batch[keys].shift()) & ~(batch[keys].isna() & batch[keys].shift().isna())).any(axis=1).to_numpy().nonzero()[0].tolist()
            starts = [0, *(i for i in starts if i)]
            columns = {c: batch[c].tolist() for c in batch}
            out: dict[str, list] = {}
            for a, b in zip(starts, [*starts[1:], len(batch)]):
                here = tuple(None if pd.isna(columns[k][a]) else columns[k][a] for k in keys)
                if step is None or here != known:
                    known, step = here, fold()
                for name, values in step({c: v[a:b] for c, v in columns.items()}).items():
                    out.setdefault(name, []).extend(values)
            yield pd.DataFrame(out)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
