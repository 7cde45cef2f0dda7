"""Ordered folds over the rows of a key.

A fold walks the rows of each key in order with a whole-number state that never grows. Rows are
range-partitioned by (key, order), so a key with very many rows spans several partitions. Such a key
is folded exactly in parallel: each of its parts is first reduced to a table "state on entry -> state
on exit" over all states it can be entered with, the tables are chained in order, and every part is
then replayed from its own entry state. Keys inside one partition need the replay only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from stockloom.schemas import extended
from stockloom.session import checkpointed


@dataclass(frozen=True)
class Step:
    """One step on a single state and the same step on an array of states."""

    one: Callable[[int, int], int]
    many: Callable[[np.ndarray, int], np.ndarray]


ORDER_STEP = Step(
    one=lambda state, qty: state - qty if 0 < qty <= state else state,
    many=lambda states, qty: np.where((states >= qty) & (qty > 0), states - qty, states),
)


def _cut(states, basis):
    new = np.rint(states * (10000 - basis) / 10000.0).astype(np.int64)
    return np.where((basis > 0) & (basis < 10000) & (new > 0), new, states)


PRICE_STEP = Step(one=lambda state, basis: int(_cut(np.int64(state), basis)), many=_cut)


def _entry_tables(step: Step):
    """Per part of a spanning key: exit states for the entry states 0..start."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_key, table = None, None

        def closed():
            key, part = open_key
            distinct, place = table
            return pd.DataFrame({"_key": [key], "_part": [part], "_exits": [distinct[place].tolist()]})

        for pdf in batches:
            for key, part, start, value in zip(pdf["_key"], pdf["_part"], pdf["_start"], pdf["_value"]):
                if (key, part) != open_key:
                    if open_key is not None:
                        yield closed()
                    states = np.arange(int(start) + 1, dtype=np.int64)
                    open_key, table = (key, part), (states, states.copy())
                # Only the distinct states are advanced; entry states that met stay together.
                distinct, where = np.unique(step.many(table[0], int(value)), return_inverse=True)
                table = (distinct, where[table[1]])
        if open_key is not None:
            yield closed()

    return run


def _chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entry state of every part of a key, parts in order."""
    current, state = None, 0
    for pdf in batches:
        rows = []
        for key, part, start, exits in zip(pdf["_key"], pdf["_part"], pdf["_start"], pdf["_exits"]):
            if key != current:
                current, state = key, int(start)
            rows.append((key, part, state))
            state = int(exits[state])
        yield pd.DataFrame(rows, columns=["_key", "_part", "_entry"])


def _replay(step: Step):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, 0
        for pdf in batches:
            before, after = [], []
            for key, start, value in zip(pdf["_key"], pdf["_entry"], pdf["_value"]):
                if key != current:
                    current, state = key, int(start)
                before.append(state)
                state = step.one(state, int(value))
                after.append(state)
            yield pdf.assign(state_before=before, state_after=after)

    return run


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], start: str, value: str, step: Step) -> DataFrame:
    """The rows with `state_before` and `state_after`.

    `start` holds the first state of the key on every row and `value` the operand; both are whole numbers.
    """
    rows = df.select(
        *df.columns,
        F.concat_ws("\u0001", *keys).alias("_key"),
        F.col(start).cast("long").alias("_start"),
        F.col(value).cast("long").alias("_value"),
    )
    sort = ["_key", *order]
    ranged = rows.repartitionByRange(*sort).withColumn("_part", F.spark_partition_id())
    fixed = checkpointed(ranged.sortWithinPartitions(*sort))
    spans = (
        fixed.groupBy("_key")
        .agg(F.min("_part").alias("a"), F.max("_part").alias("b"), F.first("_start").alias("_start"))
        .filter("a < b")
        .select("_key", "_start")
    )
    # At most one key crosses each partition boundary, so the spanning keys are fewer than the partitions.
    parts = (
        fixed.drop("_start")
        .join(F.broadcast(spans), "_key")
        .select("_key", "_part", "_start", "_value", *order)
        .sortWithinPartitions(*sort)
        .mapInPandas(_entry_tables(step), "_key string, _part int, _exits array<long>")
    )
    entries = (
        parts.join(F.broadcast(spans), "_key")
        .repartition("_key")
        .sortWithinPartitions("_key", "_part")
        .mapInPandas(_chain, "_key string, _part int, _entry long")
    )
    ready = fixed.join(F.broadcast(entries), ["_key", "_part"], "left").withColumn("_entry", F.coalesce("_entry", "_start"))
    columns = ["_key", "_entry", "_value", *df.columns]
    schema = extended(ready.select(*columns).schema, state_before="long", state_after="long")
    out = ready.select(*columns, "_part").sortWithinPartitions(*sort).select(*columns)
    return out.mapInPandas(_replay(step), schema).drop("_key", "_entry", "_value")
