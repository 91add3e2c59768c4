"""User functions: rules written in Python, run on Arrow batches instead of single rows.

Everything the library needs itself is a native expression; these wrappers are for callers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.place import place


def column_udf(fn: Callable[..., pd.Series], returns: str):
    """A typed function of columns, called once per batch."""
    return F.pandas_udf(fn, returns)


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Row-for-row function of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield fn(batch)

    return df.mapInArrow(run, schema)


def flat_map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Table function: each batch yields any number of batches, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from fn(batch)

    return df.mapInArrow(run, schema)


def reduce_by_key(
    df: DataFrame,
    keys: list[str],
    merge: Callable[[pd.DataFrame], dict],
    schema: str,
    max_keys: int = 100_000,
    fan_in: int = 64,
) -> DataFrame:
    """Associative merge written in Python.

    ``merge`` turns the rows of one key into one row of the same columns. It runs as a tree: over
    the batches of each input partition (keeping one row per key), over those partial rows in
    ``fan_in`` salted groups per key, and over the rows of the groups. A hot key is therefore
    never in one task before it is down to ``fan_in`` rows. Partial rows are handed on whenever
    more than ``max_keys`` keys are held, so memory is bounded.
    """

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        out = [
            {**dict(zip(keys, key)), **merge(group)}
            for key, group in rows.groupby(keys, sort=False, dropna=False)
        ]
        return pd.DataFrame(out, columns=rows.columns)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, dict] = {}
        for batch in batches:
            if batch.empty:
                continue
            fresh = merged(batch)
            for row in fresh.to_dict("records"):  # one per key of this batch; other held keys are not touched
                key = tuple(None if pd.isna(row[k]) else row[k] for k in keys)
                if key in held:
                    pair = pd.DataFrame([held[key], row], columns=fresh.columns)
                    row = {**{k: row[k] for k in keys}, **merge(pair)}
                held[key] = row
            if len(held) > max_keys:
                yield pd.DataFrame(list(held.values()), columns=fresh.columns)
                held = {}
        if held:
            rows = list(held.values())
            yield pd.DataFrame(rows, columns=list(rows[0]))

    partials = df.mapInPandas(partial, schema)
    salted = partials.withColumn("_salt", F.spark_partition_id() % fan_in)

    def merged_group(rows: pd.DataFrame) -> pd.DataFrame:
        return merged(rows.drop(columns="_salt"))

    groups = salted.groupBy(*keys, "_salt").applyInPandas(merged_group, schema)
    return groups.groupBy(*keys).applyInPandas(merged, schema)


def reduce_segments(
    df: DataFrame,
    keys: list[str],
    merge: Callable[[dict[str, np.ndarray], np.ndarray], dict[str, np.ndarray]],
    schema: str,
    held_rows: int = 1 << 20,
    fan_in: int = 64,
) -> DataFrame:
    """Associative and commutative merge of whole batches: one call for many keys.

    ``merge(values, starts)`` gets the columns without the keys, rows of a key next to each other, and the first row
    of each key (as ``np.add.reduceat`` takes them), and returns one value per key and column. A state of any kind fits
    in a binary column. It runs over the batches of each input partition, then over sorted partial rows in ``fan_in``
    salted parts per key, then over the rows of the parts. Memory is bounded by ``held_rows`` and a batch. Null keys
    are a key; ``df`` has the columns of ``schema``; an empty table gives an empty result.
    """

    def reduced(table: pa.Table) -> pa.Table:
        change = np.zeros(table.num_rows, bool)
        change[0] = True
        for k in keys:
            codes = table.column(k).combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
            change[1:] |= codes[1:] != codes[:-1]
        starts = np.flatnonzero(change)
        values = {c: table.column(c).to_numpy() for c in table.column_names if c not in keys}
        merged, firsts = merge(values, starts), table.select(keys).take(pa.array(starts))
        columns = [firsts.column(f.name) if f.name in keys else pa.array(merged[f.name], f.type) for f in table.schema]
        return pa.Table.from_arrays(columns, schema=table.schema)

    def by_key(table: pa.Table) -> pa.Table:
        return reduced(table.take(pc.sort_indices(table, [(k, "ascending") for k in keys])))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = pa.Table.from_batches([batch])
            held = by_key(fresh if held is None else pa.concat_tables([held, fresh]))
            if held.num_rows > held_rows:
                yield from held.to_batches()
                held = None
        if held is not None:
            yield from held.to_batches()

    def of_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the key at the end of a batch may go on in the next one
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = pa.Table.from_batches([batch])
            done = reduced(fresh if last is None else pa.concat_tables([last, fresh]))
            yield from done.slice(0, done.num_rows - 1).to_batches()
            last = done.slice(done.num_rows - 1)
        if last is not None:
            yield from last.to_batches()

    partials = df.mapInArrow(partial, schema).withColumn("_salt", F.spark_partition_id() % fan_in)
    parts = partials.repartition(*keys, "_salt").drop("_salt").sortWithinPartitions(*keys).mapInArrow(of_sorted, schema)
    return parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(of_sorted, schema)


def partition_by(df: DataFrame, parts: int, rule: Column, splits: int = 1) -> DataFrame:
    """Custom ``row -> partition`` rule, given as an expression; rows land exactly there
    (with ``splits``, in that partition's own run of tasks)."""
    return place(df.withColumn("pid", rule.cast("int")), parts, splits=splits)


def map_partitions_indexed(
    placed: DataFrame,
    fn: Callable[[int, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str,
) -> DataFrame:
    """Generator over a placed partition together with its ordinal.

    ``fn`` is called once per task and ``pid``, with an iterator over all batches of that ``pid`` in the task, so
    it can fold, count or write a header. The ordinal is read from the ``pid`` column (rows are sorted
    by it within the task), so it survives retries and any later change of the physical layout. Batches stream
    through; no partition is held whole.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
        for batch in batches:
            pids = batch.column("pid").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(pids[1:] != pids[:-1]) + 1).tolist(), len(pids)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    yield int(pids[a]), batch.slice(a, b - a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pid, pieces in groupby(runs(batches), key=lambda x: x[0]):
            yield from fn(pid, (piece for _, piece in pieces))

    return placed.sortWithinPartitions("pid").mapInArrow(run, schema)
