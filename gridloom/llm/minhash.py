"""Near duplicates by one-permutation MinHash, banded buckets and star-shaped candidate edges.

One hash of each shingle gives its bin and its value; a bin keeps its least value. An empty bin takes the value of the
bin that comes first in a random order of its own among those that have one (optimal densification), so the chance
that two sets agree in a bin is their similarity, however few shingles they have. Neighbouring bins are joined to bands, and
documents with an equal band meet in a bucket.

In a bucket only pairs with one leader are candidates, so a bucket costs as many pairs as it has documents. The links that
hold on the full sets give components. The first leader is the smallest id, which the buckets of a group share. Buckets that
still hold several components get a second leader each, drawn by a hash, so that many documents of a large group lead.
What is then left in mixed buckets is compared across components, where parity bits show that the sets may be similar
enough, so no pair of a bucket that could join two components is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.arrowtext import mix64
from gridloom.llm.components import components
from gridloom.llm.jaccard import MIX, PARITY_BITS, parity_words, row_filter, shingle_sets, word_groups
from gridloom.session import materialize


@dataclass(frozen=True)
class MinHashSettings:
    """With 32 bands of 5 bins a pair of similarity 0.8 misses all buckets with probability 0.672^32, or 3 in a million."""

    words: int = 5  # words of a shingle
    percent: int = 80  # linked when 100 * intersection >= percent * union
    bands: int = 32
    rows: int = 5  # bins of a band
    seed: int = 5


# --- signatures ------------------------------------------------------------------------------------------


def probe_ranks(bins: int, seed: int) -> np.ndarray:
    """For each bin a random order of all bins: the rank at which it turns to each of them when it is empty."""
    random = np.random.default_rng(seed)
    return np.argsort(random.random((bins, bins)), axis=1).astype(np.int32)


def signature(tokens: np.ndarray, bins: int, ranks: np.ndarray) -> np.ndarray:
    """The least value of each bin, densified; ``tokens`` are distinct and at least one."""
    mixed = np.sort(mix64(tokens + np.uint64(0x5851F42D4C957F2D)))
    at = ((mixed >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)  # grows with the value: a bin's first is its least
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    filled = at[first].astype(np.int64)
    out = np.zeros(bins, np.uint64)
    out[filled] = mixed[first]
    if len(filled) < bins:
        empty = np.setdiff1d(np.arange(bins), filled, assume_unique=True)
        out[empty] = out[filled[np.argmin(ranks[np.ix_(empty, filled)], axis=1)]]
    return out


def band_keys(values: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each band; keys of different bands differ by their salt."""
    keys = mix64(np.arange(bands, dtype=np.uint64) + np.uint64(1))
    for column in values.reshape(bands, -1).T:
        keys = mix64(keys * MIX + column)
    return keys


def _signer(s: MinHashSettings):
    """Per row the set size, the digest of the set and its band keys."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = s.bands * s.rows
        ranks = probe_ranks(bins, s.seed)
        for batch in batches:
            for i, j, hashes, bounds in word_groups(batch.column(1)):
                sizes, digests, keys = [], [], []
                for tokens, _ in shingle_sets(hashes, bounds, s.words):
                    sizes.append(len(tokens))
                    some = len(tokens) > 0
                    digests.append(hashlib.sha256(tokens.tobytes()).digest() if some else None)
                    keys.append(band_keys(signature(tokens, bins, ranks), s.bands).view(np.int64) if some else None)
                columns = [batch.column(0).slice(i, j - i), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary())]
                columns.append(pa.array(keys, pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "digest", "keys"])

    return kernel


# --- verification ----------------------------------------------------------------------------------------


def _setter(sent, s: MinHashSettings):
    """``id, tokens, parity`` of the rows that may be wanted (second column: their slot in the filter)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(sent.value[batch.column(1).to_numpy()]))
            for i, j, hashes, bounds in word_groups(batch.column(2)):
                sets = [tokens for tokens, _ in shingle_sets(hashes, bounds, s.words)]
                columns = [batch.column(0).slice(i, j - i), pa.array([x.tobytes() for x in sets], pa.binary())]
                columns.append(pa.array([parity_words(x) for x in sets], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, ["id", "tokens", "parity"])

    return kernel


def _confirm(percent: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k, (left, right) in enumerate(zip(batch.column(2), batch.column(3))):
                a, b = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
                both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
                keep[k] = 100 * both >= percent * (len(a) + len(b) - both)
            ids = [batch.column(c).filter(pa.array(keep)) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays(ids, ["x", "y"])

    return kernel


class _Stars:
    """Candidate edges of buckets ``key, id, n`` and their verification on the sets ``id, tokens, parity``."""

    def __init__(self, buckets: DataFrame, sets: DataFrame, percent: int):
        self.sets, self.percent = sets, percent
        self.rows = buckets.withColumn("c", F.col("id"))  # every document is a component of its own
        self.links: DataFrame | None = None

    def _fits(self, nx: Column, ny: Column) -> Column:
        """Whether sets of these sizes can be similar enough."""
        return F.least(nx, ny) * 100 >= F.greatest(nx, ny) * self.percent

    def _near(self, x: str, y: str) -> Column:
        """Whether the parity bits allow it: two sets differ in as many tokens as bits at least."""
        bits = [F.bit_count(F.col(f"{x}.parity")[k].bitwiseXOR(F.col(f"{y}.parity")[k])) for k in range(PARITY_BITS // 64)]
        both = F.col(f"{x}.n") + F.col(f"{y}.n")
        shared = F.call_function("div", self.percent * both + 99 + self.percent, F.lit(100 + self.percent))
        return sum(bits[1:], bits[0]) <= both - 2 * shared

    def _verify(self, pairs: DataFrame) -> None:
        """Add the pairs ``x, y`` whose full sets are similar to the links."""
        # Written first: the adaptive plan cuts a leader of many pairs only where a join reads plain exchanges.
        pairs = materialize(pairs.select("x", "y").distinct(), "candidates")
        for side, name in (("x", "left"), ("y", "right")):
            pairs = pairs.join(self.sets.select(F.col("id").alias(side), F.col("tokens").alias(name)), side)
        found = pairs.select("x", "y", "left", "right").mapInArrow(_confirm(self.percent), "x bigint, y bigint")
        found = materialize(found, "links")
        self.links = found if self.links is None else self.links.unionByName(found)

    def _mixed(self, leader: Column) -> None:
        """Give the rows their present components, leave buckets of one component out and choose a leader for the others."""
        if self.links is not None:
            groups = materialize(components(self.links, "x", "y"), "groups")
            rows = self.rows.drop("c", "leader").join(groups, F.col("id") == F.col("node"), "left")
            self.rows = rows.select(*(x for x in rows.columns if x not in ("node", "component")), F.coalesce("component", "id").alias("c"))
        by_key = self.rows.groupBy("key").agg(F.min("c").alias("a"), F.max("c").alias("b"), F.min(leader).alias("leader"))
        by_key = materialize(by_key.where("a <> b").select("key", "leader"), "leaders")
        self.rows = materialize(self.rows.join(by_key, "key"), "mixed")

    def run(self) -> DataFrame:
        """All links ``x, y`` that are needed for the components."""
        self._mixed(F.struct("id", "n", "c"))
        self._verify(self._led())
        # Few rows are left that have not met their likes; they carry their parity bits from here on.
        self._mixed(F.struct("id", "n", "c"))
        self.rows = materialize(self.rows.drop("leader").join(self.sets.select("id", "parity"), "id"), "bits")
        self._verify(self._salted())
        self._mixed(F.struct("id"))
        x, y = self.rows.alias("x"), self.rows.alias("y")
        open_pair = (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.c") != F.col("y.c"))
        pairs = x.join(y, open_pair & self._fits(F.col("x.n"), F.col("y.n")) & self._near("x", "y"))
        self._verify(pairs.select(F.col("x.id").alias("x"), F.col("y.id").alias("y")))
        return self.links

    def _led(self) -> DataFrame:
        apart = self.rows.where((F.col("c") != F.col("leader.c")) & self._fits(F.col("n"), F.col("leader.n")))
        return apart.select(F.col("leader.id").alias("x"), F.col("id").alias("y"))

    def _salted(self) -> DataFrame:
        drawn = F.struct(F.xxhash64("key", "id").alias("draw"), "id", "n", "c", "parity")
        leaders = materialize(self.rows.groupBy("key").agg(F.min(drawn).alias("l")), "leaders").select("key", "l.*").alias("l")
        rows = self.rows.alias("r").join(leaders, F.col("r.key") == F.col("l.key"))
        rows = rows.where((F.col("r.c") != F.col("l.c")) & self._fits(F.col("r.n"), F.col("l.n")) & self._near("r", "l"))
        return rows.select(F.least("l.id", "r.id").alias("x"), F.greatest("l.id", "r.id").alias("y"))


# --- the operator ----------------------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, s: MinHashSettings = MinHashSettings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``<id_col>, n_shingles, component_id`` (the smallest id reachable by links) and ``kept``
    (whether the id is that smallest one).

    Null text, or text without words, has an empty set and no links; so has a row with a null id, whose component is null
    and which is kept. Equal ids are one document. Documents of one set are one point of the graph: any number of copies
    costs one signature. Only the two named columns are read. An empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id bigint, n bigint, digest binary, keys array<bigint>"
    profile = materialize(docs.mapInArrow(_signer(s), schema), "profile")
    same = profile.where("digest is not null and id is not null").groupBy("digest")
    same = materialize(same.agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys")), "sets")
    buckets = materialize(same.select(F.explode("keys").alias("key"), F.col("rep").alias("id"), "n"), "buckets")
    shared = buckets.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("key")
    buckets = materialize(buckets.join(materialize(shared, "shared"), "key"), "buckets")
    sent = docs.sparkSession.sparkContext.broadcast(row_filter(buckets.select("id")))
    slots = docs.where("id is not null").select("id", F.pmod(F.xxhash64("id"), F.lit(len(sent.value))).cast("int").alias("slot"), "text")
    sets = slots.mapInArrow(_setter(sent, s), "id bigint, tokens binary, parity array<bigint>")
    # Rows of an id outside the buckets come through the filter by chance and match no pair.
    sets = materialize(sets.where(F.length("tokens") > 0).distinct(), "tokens")
    sent.unpersist()
    groups = components(_Stars(buckets, sets, s.percent).run(), "x", "y")
    named = same.join(groups, same["rep"] == groups["node"], "left")
    named = materialize(named.select("digest", F.coalesce("component", "rep").alias("component")), "named")
    out = profile.select("id", "n", "digest").join(named, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def keep_one_of_each(docs: DataFrame, s: MinHashSettings = MinHashSettings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component; rows with a null id stay."""
    gone = near_duplicates(docs, s, id_col, text_col).where("not kept").select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone["__gone"], "left_anti")
