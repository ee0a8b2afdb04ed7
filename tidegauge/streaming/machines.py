"""State machines over streams: the same start and step functions as ``operators.fold`` takes."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState


def stream_fold(stream: DataFrame, keys: list[str], order: list[str], start: Callable[[], Any], step: Callable[[Any, Any], Iterable[tuple]], schema: str) -> DataFrame:
    """Runs ``step(state, row)`` over each key's rows as they arrive and returns the tuples it yields.

    A key's state goes from one micro-batch to the next in the query's state store, so it survives lost
    executors and restarts. Rows are in order within a micro-batch; a row that comes in a later batch than
    one it belongs before is taken when it comes. State is small and stays as long as its key may come again."""
    names = [c.split()[0] for c in schema.split(",")]

    def run(_: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = pickle.loads(held.get[0]) if held.exists else start()
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        out = [found for row in rows.itertuples(index=False) for found in step(state, row)]
        held.update((pickle.dumps(state),))
        yield pd.DataFrame(out, columns=names)

    return stream.groupBy(*keys).applyInPandasWithState(run, schema, "state binary", "append", "NoTimeout")
