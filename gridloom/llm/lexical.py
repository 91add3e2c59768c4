"""Ranked lexical search with per-term geometric blocks.

Every document becomes a vector of impacts, one for each query term it holds; its score for an item is the sum of the
item's weights times its impacts. Documents are placed by their vectors (by their terms that are rarest among the items),
so those of a task resemble each other, and are taken a chunk at a time. In a chunk the posting list of a term is cut
into blocks by geometry: its documents go to the nearest of the pivot documents that hold the term. A block keeps the
coordinatewise maximum of its documents' vectors. Weighted for an item, that summary is an upper bound of the scores in
the block, and the block is skipped only where the bound is below the tenth best score known; all other blocks are
scored in full. Lists of an item whose highest impacts together stay below that score hold no document of their own to
find and are left to the others. Scores are whole numbers below 2^53, so sums in doubles are exact.

The first known scores come from a sample of the vectors; they only save work, since they are scores of documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.arrowtext import row_groups, text_bytes
from gridloom.llm.jaccard import FOLD_CASE
from gridloom.llm.subword import span_hashes
from gridloom.session import materialize

#: Characters of a term: everything but the ASCII signs, spaces and controls.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM_BYTES = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
TEXT_BYTES = 1 << 18


@dataclass(frozen=True)
class SearchSettings:
    top: int = 10
    pairs_per_pass: int = 1 << 14  # pairs of an item and a term that one pass over the documents serves
    chunk_entries: int = 1 << 22  # documents times terms of a chunk
    chunk_rows: int = 2048
    pivots: int = 128  # of a chunk
    sample_rows: int = 20_000  # about so many vectors give the first known scores


@dataclass(frozen=True)
class Queries:
    """Items of one pass: ``ids``, and for each the numbers of its terms. Terms are numbered from the rarest among the items;
    ``hashes`` are those of the terms, ascending, and ``numbers`` the numbers in that order."""

    ids: list
    terms: list[np.ndarray]
    hashes: np.ndarray
    numbers: np.ndarray


# --- terms -----------------------------------------------------------------------------------------------


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the terms of all rows, in order, and each row's bounds among them."""
    inside = TERM_BYTES[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    first[cuts], last[cuts - 1] = inside[cuts], inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return span_hashes(FOLD_CASE[data], starts, ends), np.searchsorted(starts, offsets)


def whole_term_parts(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in parts of about TEXT_BYTES that end between terms."""
    at = 0
    while at < len(data):
        end = min(at + TEXT_BYTES, len(data))
        while end < len(data):  # to the end of a term that the cut would go through
            gap = np.flatnonzero(~TERM_BYTES[data[end : end + TEXT_BYTES]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(end + TEXT_BYTES, len(data))
        yield data[at:end]
        at = end


def _vectoriser(box):
    """Per row its number of terms, and of the wanted terms it holds the numbers and counts."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, numbers = box.value
        size = len(wanted)

        def find(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Numbers of the wanted terms among ``hashes``, and their places."""
            at = np.minimum(np.searchsorted(wanted, hashes), size - 1)
            hit = wanted[at] == hashes
            return numbers[at[hit]], np.flatnonzero(hit)

        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for i, j in row_groups(offsets, TEXT_BYTES):
                body, bounds = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                if j - i == 1 and len(body) > TEXT_BYTES:
                    sizes, tally = np.zeros(1, np.int64), np.zeros(size, np.int64)
                    for part in whole_term_parts(body):
                        hashes, _ = term_hashes(part, np.array([0, len(part)]))
                        sizes += len(hashes)
                        tally += np.bincount(find(hashes)[0], minlength=size)
                    found, counts = np.flatnonzero(tally), tally[tally > 0]
                else:
                    hashes, at = term_hashes(body, bounds)
                    sizes = np.diff(at)
                    term, place = find(hashes)
                    row = np.searchsorted(at, place, side="right") - 1
                    found, counts = np.unique(row * size + term, return_counts=True)
                ends = np.searchsorted(found, np.arange(j - i + 1) * size).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (found % size, counts)]
                columns = [batch.column(0).slice(i, j - i), pa.array(sizes, pa.int64()), *lists]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "terms", "counts"])

    return kernel


# --- chunks ----------------------------------------------------------------------------------------------


class Best:
    """The ``top`` best documents of each item so far: higher scores first, of equal ones the smaller id."""

    def __init__(self, floors: np.ndarray, top: int):
        self.floors, self.top = floors.astype(float), top
        self.scores = [np.zeros(0)] * len(floors)
        self.docs = [np.zeros(0, np.int64)] * len(floors)

    def add(self, item: int, scores: np.ndarray, docs: np.ndarray) -> None:
        good = scores >= self.floors[item]
        if not good.any():
            return
        scores = np.concatenate([self.scores[item], scores[good]])
        docs = np.concatenate([self.docs[item], docs[good]])
        order = np.lexsort((docs, -scores))[: self.top]
        self.scores[item], self.docs[item] = scores[order], docs[order]
        if len(order) == self.top:
            self.floors[item] = max(self.floors[item], scores[order[-1]])


class Chunk:
    """Impacts ``[term, document]`` of some documents, and the blocks of their posting lists."""

    def __init__(self, impacts: np.ndarray, docs: np.ndarray, weights: np.ndarray, pivots: int):
        self.impacts, self.docs, self.weights = impacts, docs, weights
        step = max(1, len(docs) // pivots)
        self.pivots = np.arange(0, len(docs), step)
        heights = (impacts * weights[:, None]).astype(np.float32)
        self.nearness = heights.T @ heights[:, self.pivots]  # [document, pivot]

    def scores(self, terms: np.ndarray, places: np.ndarray) -> np.ndarray:
        return self.weights[terms] @ self.impacts[np.ix_(terms, places)].astype(float)

    def blocks(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """The documents of a term's posting list, block by block, and where the blocks begin."""
        listed = np.flatnonzero(self.impacts[term])
        own = np.flatnonzero(self.impacts[term, self.pivots])
        if len(own) < 2:
            return listed, np.zeros(1, np.int64)
        nearest = np.argmax(self.nearness[np.ix_(listed, own)], axis=1)
        order = np.argsort(nearest, kind="stable")
        nearest = nearest[order]
        return listed[order], np.flatnonzero(np.append(True, nearest[1:] != nearest[:-1]))

    def summary(self, terms: np.ndarray, listed: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Coordinatewise maxima ``[term, block]`` of the blocks."""
        return np.maximum.reduceat(self.impacts[np.ix_(terms, listed)], starts, axis=1)

    def search(self, terms: list[np.ndarray], best: Best) -> None:
        heights = self.impacts.max(axis=1) * self.weights
        needed: dict[int, list[int]] = {}
        for item, own in enumerate(terms):
            tops = heights[own]
            order = np.argsort(tops)
            low = np.cumsum(tops[order]) < best.floors[item]
            for t in own[order[~low]].tolist():
                if heights[t] > 0:
                    needed.setdefault(t, []).append(item)
        seen = np.zeros((len(terms), len(self.docs)), bool)
        for t in sorted(needed, key=lambda t: -heights[t]):
            listed, starts = self.blocks(t)
            columns = np.unique(np.concatenate([terms[item] for item in needed[t]]))
            summary = self.summary(columns, listed, starts).astype(float)
            sizes = np.diff(np.append(starts, len(listed)))
            for item in needed[t]:
                own = terms[item]
                bounds = self.weights[own] @ summary[np.searchsorted(columns, own)]
                alive = bounds >= best.floors[item]
                if not alive.any():
                    continue
                places = listed[np.repeat(alive, sizes)]
                places = places[~seen[item, places]]
                if len(places):
                    seen[item, places] = True
                    best.add(item, self.scores(own, places), self.docs[places])

    def search_all(self, terms: list[np.ndarray], best: Best) -> None:
        every = np.arange(len(self.docs))
        for item, own in enumerate(terms):
            best.add(item, self.scores(own, every), self.docs)


def _searcher(box, s: SearchSettings, exhaustive: bool):
    """The best documents of each item among the rows of a task: ``item`` (its number), ``doc_id, score``."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weights, floors = box.value
        best = Best(floors, s.top)
        limit = max(1, min(s.chunk_rows, s.chunk_entries // max(1, len(weights))))
        for batch in batches:
            for i in range(0, batch.num_rows, limit):
                part = batch.slice(i, limit)
                ids, m = part.column(0).to_numpy(), part.column(1).to_numpy()
                found, counts = part.column(2), part.column(3).flatten().to_numpy().astype(np.int64)
                row = np.repeat(np.arange(part.num_rows), found.value_lengths().to_numpy())
                impacts = np.zeros((len(weights), part.num_rows), np.int32)  # below 10^6
                impacts[found.flatten().to_numpy(), row] = (1_000_000_000 * counts) // (1000 * counts + 8 * m[row])
                chunk = Chunk(impacts, ids, weights, s.pivots)
                (chunk.search_all if exhaustive else chunk.search)(terms, best)
        sizes = [len(x) for x in best.scores]
        if sum(sizes):
            items = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            columns = [pa.array(items), pa.array(np.concatenate(best.docs)), pa.array(np.concatenate(best.scores).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])

    return kernel


# --- passes ----------------------------------------------------------------------------------------------


def _passes(queries: DataFrame, id_col: str, text_col: str, s: SearchSettings) -> Iterator[Queries]:
    """The items in parts of about ``pairs_per_pass`` pairs of an item and a term."""
    pairs = queries.select(F.col(id_col).alias("item"), F.explode(F.regexp_extract_all(lower_ascii(F.col(text_col)), F.lit(TERM), F.lit(0))).alias("term"))
    pairs = pairs.groupBy("item", "term").agg(F.lit(1).alias("one"))
    pairs = materialize(pairs.select("item", "term"), "pairs")
    parts = -(-pairs.count() // s.pairs_per_pass)
    for k in range(parts):
        rows = pairs.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == k).orderBy("item", "term").toArrow()
        if not rows.num_rows:
            continue
        names, ids = rows.column("term").to_pylist(), rows.column("item").to_pylist()
        data, offsets = text_bytes(pa.array(names, pa.string()))
        hashes, _ = term_hashes(data, offsets)
        wanted, which, uses = np.unique(hashes, return_inverse=True, return_counts=True)
        numbers = np.argsort(np.argsort(uses, kind="stable"), kind="stable")
        own = numbers[which]
        cuts = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
        yield Queries([ids[a] for a in cuts[:-1]], [np.sort(own[a:b]) for a, b in zip(cuts, cuts[1:])], wanted, numbers)


def weight(n: int, df: int) -> int:
    """Weight of a term that ``df`` of ``n`` documents hold."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _search_pass(docs: DataFrame, q: Queries, s: SearchSettings) -> DataFrame:
    """``item_id, doc_id, score`` of the candidates of each task for the items of one pass."""
    spark = docs.sparkSession
    box = spark.sparkContext.broadcast((q.hashes, q.numbers))
    vectors = docs.mapInArrow(_vectoriser(box), "id bigint, n bigint, terms array<int>, counts array<int>")
    vectors = materialize(vectors, "vectors")
    box.unpersist()
    whole = vectors.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    held = vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect()  # a row a term
    weights = np.zeros(len(q.hashes))
    for r in held:
        weights[r["t"]] = weight(whole["docs"], r["df"])
    length = F.lit(10) + F.call_function("div", 90 * F.col("n") * F.lit(whole["docs"]), F.lit(max(1, whole["terms"])))
    rows = vectors.where("id is not null and size(terms) > 0").select("id", length.alias("m"), "terms", "counts")
    out = "item int, doc_id bigint, score bigint"

    floors = np.ones(len(q.ids))  # a score is above 0
    every = max(1, whole["docs"] // s.sample_rows)
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0)
    box = spark.sparkContext.broadcast((q.terms, weights, floors))
    known = _ranked(sample.mapInArrow(_searcher(box, s, True), out), "item", s.top).where(F.col("rank") == s.top)
    for r in known.select("item", "score").collect():  # a row an item
        floors[r["item"]] = r["score"]
    box.unpersist()

    # A row's terms are in order, the rarest first.
    keys = [F.get("terms", k) for k in range(3)]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    near = rows.repartitionByRange(tasks, *keys, F.xxhash64("id")).sortWithinPartitions(*keys)
    box = spark.sparkContext.broadcast((q.terms, weights, floors))
    found = materialize(near.mapInArrow(_searcher(box, s, False), out), "found")
    box.unpersist()
    names = spark.createDataFrame(list(enumerate(q.ids)), f"item int, item_id {_kind(q.ids)}")
    return found.join(F.broadcast(names), "item").select("item_id", "doc_id", "score")


def _kind(ids: list) -> str:
    return "string" if any(isinstance(x, str) for x in ids) else "bigint"


def _ranked(rows: DataFrame, item_col: str, top: int) -> DataFrame:
    best = Window.partitionBy(item_col).orderBy(F.desc("score"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def search(
    docs: DataFrame, queries: DataFrame, s: SearchSettings = SearchSettings(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id"
) -> DataFrame:
    """The ``top`` best documents of each item: ``item_id, rank, doc_id, score``.

    Statistics are those of all rows of ``docs``; a null text has no terms. A row with a null id counts in them but can't be named,
    so it is not ranked. Rows with repeated ids are ranked each by itself. Rows of ``queries`` with equal ids are one item with the
    terms of all; an item without a term, or whose terms no document holds, has no rows. Empty tables give an empty result.
    Terms are told apart by 64-bit hashes. Each pass over ``docs`` serves ``pairs_per_pass`` pairs of an item and a term.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = None
    for q in _passes(queries, item_col, text_col, s):
        part = _search_pass(slim, q, s)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = slim.where(F.lit(False)).select(F.lit(0).cast("long").alias("item_id"), F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    return _ranked(found, "item_id", s.top).select("item_id", "rank", "doc_id", "score")
