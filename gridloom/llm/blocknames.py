"""Exact duplicates by deterministic block naming.

Texts are normalised, cut into blocks of a fixed number of bytes, and the blocks are sorted; equal
blocks get equal integer names. Adjacent names of a text are then paired and the pairs named the same
way, until one name is left. Two texts of equally many blocks have the same last name exactly when
they are equal: names stand for contents, never for hashes, so nothing can collide.

Naming is a range partition on (SHA-256 of the content, row, position); contents themselves are compared, and
two contents with one SHA-256 would stop the job rather than be taken for equal. A block that a third of all rows share is cut
over many tasks, and the ranks of the tasks are joined by the first and last content of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import materialize

#: Bytes of a block. Most texts are one or two blocks, so few need more than a round or two of pairing.
BLOCK_BYTES = 4096


def squeeze_spaces(text: Column) -> Column:
    """Null as empty, every run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def _local_ranks(key: str, order: str, carry: list[str]):
    """Number the distinct keys of a sorted partition from 0; the first and last key stay as edges.

    Rows come sorted by ``order``; keys are compared themselves, and two keys with one order value are an error.
    """

    def out(batch: pa.RecordBatch, ranks: np.ndarray, pid: int, head, tail) -> pa.RecordBatch:
        n = batch.num_rows
        columns = [batch.column(c) for c in carry]
        columns += [pa.array(np.full(n, pid, np.int32)), pa.array(ranks.astype(np.int64))]
        columns += [pa.array([head] + [None] * (n - 1), pa.binary()), pa.array([None] * (n - 1) + [tail], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, [*carry, "pid", "rank", "head", "tail"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        held, last, place, rank = None, None, None, -1
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            keys = batch.column(key)
            first = keys[0].as_py()
            change = np.empty(n, bool)
            change[0] = last is None or first != last
            change[1:] = pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            places = batch.column(order)
            moved = pc.not_equal(places.slice(1), places.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            if (change[1:] != moved).any() or (place == places[0].as_py()) == bool(change[0]):
                raise ValueError("two different blocks have one SHA-256")
            place = places[n - 1].as_py()
            ranks = rank + np.cumsum(change)
            if held is not None:
                yield out(*held, None)
            held = (batch, ranks, pid, first if last is None else None)
            last, rank = keys[n - 1].as_py(), int(ranks[-1])
        if held is not None:
            yield out(*held, last)

    return kernel


def dense_names(df: DataFrame, key: str, order: str, ties: list[str], label: str) -> DataFrame:
    """Every column but the binary ``key`` and ``order``, plus ``name``: equal keys get equal integers, others differ.

    ``order`` is the short value to sort by (the key itself, or its SHA-256): the bounds of the range partition
    are sampled on the driver, so the sort column must not be a whole block.

    ``ties`` make rows distinct so that one frequent key can be cut. The result is a written table:
    names follow the partition bounds and must not be computed twice.
    """
    carry = [c for c in df.columns if c not in (key, order)]
    fields = ", ".join(f"`{c}` {t}" for c, t in df.select(*carry).dtypes)
    schema = f"{fields}, pid int, rank bigint, head binary, tail binary"
    ranged = df.repartitionByRange(order, *ties).sortWithinPartitions(order, *ties)
    local = materialize(ranged.mapInArrow(_local_ranks(key, order, carry), schema), label)
    # One row per task from here on: its first key, its last key and how many keys it has.
    edges = local.groupBy("pid").agg(
        F.max("head").alias("head"), F.max("tail").alias("tail"), (F.max("rank") + 1).alias("keys")
    )
    order = Window.orderBy("pid")
    shared = F.coalesce((F.col("head") == F.lag("tail").over(order)).cast("long"), F.lit(0))
    edges = edges.withColumn("shared", shared)
    base = F.sum(F.col("keys") - F.col("shared")).over(order) - F.col("keys")
    offsets = edges.select("pid", base.alias("base"))
    named = local.join(F.broadcast(offsets), "pid")  # as many rows as the exchange has partitions
    return named.select(*carry, (F.col("base") + F.col("rank")).alias("name"))


def block_identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``uid, <id_col>, sha, blocks, name``; rows are equal texts exactly when
    ``blocks`` and ``name`` agree.

    Null text counts as empty. Rows with a null or repeated id stay rows of their own (``uid``). Other
    columns are ignored, whatever their names. An empty table gives an empty result.
    """
    flat = docs.select(
        F.monotonically_increasing_id().alias("uid"),
        F.col(id_col).alias("id"),
        squeeze_spaces(F.col(text_col)).alias("text"),
    )
    raw = F.col("text").cast("binary")
    count = F.greatest(F.ceil(F.length(raw) / F.lit(BLOCK_BYTES)), F.lit(1)).cast("long")
    cut = F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda i: F.struct(i.alias("pos"), _block(raw, i).alias("block")))
    blocks = flat.select(
        "uid", "id", F.sha2(raw, 256).alias("sha"), count.alias("blocks"), F.explode(cut).alias("b")
    ).select(
        "uid",
        "b.pos",
        "id",
        F.when(F.col("b.pos") == 0, F.col("sha")).alias("sha"),
        "blocks",
        F.col("b.block").alias("block"),
        F.unhex(F.sha2("b.block", 256)).alias("order"),
    )
    first = dense_names(blocks, "block", "order", ["uid", "pos"], "blocks")
    whole = first.where("blocks = 1").select("uid", "id", "sha", "blocks", "name")
    longer = first.where("blocks > 1")
    most = longer.agg(F.max("blocks")).first()[0] or 1  # one number
    level = longer.select("uid", "pos", "name", F.col("blocks").alias("left"))
    done = []
    while most > 1:
        even = F.max(F.when(F.col("pos") % 2 == 0, F.col("name")))
        odd = F.max(F.when(F.col("pos") % 2 == 1, F.col("name")))
        pairs = level.groupBy("uid", F.floor(F.col("pos") / 2).alias("pos"), F.ceil(F.col("left") / 2).alias("left"))
        pairs = pairs.agg(F.concat(_word(even), _word(F.coalesce(odd, F.lit(-1)))).alias("pair"))
        level = dense_names(pairs.withColumn("order", F.col("pair")), "pair", "order", ["uid", "pos"], "pairs")
        done.append(level.where("left = 1").select("uid", "name"))
        level = level.where("left > 1")
        most = (most + 1) // 2
    for ready in done:
        facts = longer.where("pos = 0").select("uid", "id", "sha", "blocks")
        whole = whole.unionByName(facts.join(ready, "uid"))
    return whole.withColumnRenamed("id", id_col)


def _block(raw: Column, i: Column) -> Column:
    start = (i * BLOCK_BYTES + 1).cast("int")
    return F.substring(raw, start, F.lit(BLOCK_BYTES))


def _word(name: Column) -> Column:
    return F.unhex(F.lpad(F.hex(name.cast("long")), 16, "0"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``<id_col>, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the smallest id stays; a null id comes after all others, and of rows with
    the same id one stays. ``keep_id`` is the id of the row that stays.
    """
    rows = materialize(block_identities(docs, id_col, text_col), "identities")
    first = F.min(F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("id"), F.col("uid").alias("uid")))
    groups = rows.groupBy("blocks", "name").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size"))
    # Written first: the adaptive plan cuts a large group only where the join reads two plain exchanges.
    groups = materialize(groups.where("group_size > 1"), "groups")
    joined = rows.join(groups, ["blocks", "name"], "left")
    copied = F.col("group_size").isNotNull()
    return joined.select(
        id_col,
        F.when(copied, F.col("first.id")).otherwise(F.col(id_col)).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (~copied | (F.col("first.uid") == F.col("uid"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Needs distinct non-null ids."""
    kept = exact_duplicates(docs, id_col, text_col).where("kept").select(F.col(id_col).alias("__kept"))
    return docs.join(kept, docs[id_col] == kept["__kept"], "left_semi")
