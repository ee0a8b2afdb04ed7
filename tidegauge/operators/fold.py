"""Order-dependent state machines over keyed rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], Any], step: Callable[[Any, Any], Iterable[tuple]], schema: str, finish: Callable[[Any], Iterable[tuple]] | None = None) -> DataFrame:
    """Runs ``step(state, row)`` over each key's rows in order and returns the tuples it yields;
    ``finish(state)`` yields what is left after a key's last row.

    Rows are shuffled by key and sorted, then streamed: a key's state and one Arrow batch are in
    memory, not the key's rows. A key is one sequence, so it stays in one task; keys run in parallel."""
    names = [c.split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = state = None
        for batch in batches:
            out: list[tuple] = []
            for row in batch.itertuples(index=False):
                k = tuple(getattr(row, c) for c in keys)
                if k != key:
                    if key is not None and finish:
                        out.extend(finish(state))
                    key, state = k, start()
                out.extend(step(state, row))
            yield pd.DataFrame(out, columns=names)
        if key is not None and finish:
            yield pd.DataFrame(list(finish(state)), columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
