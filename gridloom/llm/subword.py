"""Quality classifier: supervised subword embeddings.

A text is a bag of hashed features: its words, its pairs of neighbouring words (a word that repeats the one
before is a feature of its own) and its byte n-grams. Each feature has a learned vector; the mean of the vectors
goes through a linear layer and a softmax. Training is plain stochastic gradient descent in numpy over a
bounded sample. As the layers are linear, a trained model is one weight per feature and class difference,
so scoring is a table lookup and a mean over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.arrowtext import CHUNK_BYTES, mix64, row_groups, text_bytes


@dataclass(frozen=True)
class SubwordSettings:
    bits: int = 16  # features are hashed into 2**bits rows
    dim: int = 8
    orders: tuple[int, ...] = (3, 4, 5)  # byte n-grams, at most 8
    epochs: int = 6
    rate: float = 0.5
    sample_per_class: int = 2000  # bound of the training sample: so many labelled rows of each class
    seed: int = 7


# --- features --------------------------------------------------------------------------------------------

BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 18)
        inverse = pow(BASE, -1, 1 << 64)
        for key, base in (("up", BASE), ("down", inverse)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _POWERS[key] = np.cumprod(out, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of bytes other than ASCII white space; no word crosses a row."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    solid = ~space
    first = solid.copy()
    first[1:] &= space[:-1]
    last = solid.copy()
    last[:-1] &= space[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_sums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial over the bytes of each span, modulo 2**64, from one running sum."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return (total[ends] - total[starts]) * down[starts]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span: its polynomial, scrambled with the length."""
    return mix64(span_sums(data, starts, ends) + (ends - starts).astype(np.uint64))


def pair_hashes(words: np.ndarray) -> np.ndarray:
    """Hash of each two neighbouring words; 0 for a repeated word."""
    return np.where(words[1:] == words[:-1], np.uint64(0), mix64(words[1:] + mix64(words[:-1])))


def packed_ngrams(data: np.ndarray, orders: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray]]:
    """For each order, the n bytes at every position as one integer."""
    wide = data.astype(np.uint64)
    packed, have = wide, 1
    for n in sorted(orders):
        while have < n:
            more = wide[have:]
            packed = packed[: len(more)] | (more << np.uint64(8 * have))
            have += 1
        yield n, packed


def bucket(keys: np.ndarray, salt: int, bits: int) -> np.ndarray:
    """Multiplicative hash into ``2**bits`` buckets."""
    return ((keys + np.uint64(salt)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - bits)).astype(np.int32)


def feature_streams(data: np.ndarray, offsets: np.ndarray, s: SubwordSettings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(buckets, bounds)``: features in text order, those of row i in ``bounds[i]:bounds[i+1]``."""
    starts, ends = word_spans(data, offsets)
    bounds = np.searchsorted(starts, offsets)
    words = span_hashes(data, starts, ends)
    yield bucket(words, 1, s.bits), bounds
    if len(words) > 1:
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        same_row = row[1:] == row[:-1]
        pairs = pair_hashes(words)[same_row]
        yield bucket(pairs, 2, s.bits), np.searchsorted(row[1:][same_row], np.arange(len(bounds)))
    for n, packed in packed_ngrams(data, s.orders):
        at = np.arange(len(packed))
        row_end = np.repeat(offsets[1:], np.diff(offsets))[: len(packed)]
        inside = at + n <= row_end
        yield bucket(packed[inside], n << 56, s.bits), np.searchsorted(at[inside], offsets)


def long_features(data: np.ndarray, s: SubwordSettings) -> Iterator[np.ndarray]:
    """The features of one long row, part by part; words, pairs and n-grams across a cut are counted as any other."""
    open_sum, open_size = 0, 0  # polynomial and bytes of a word that a cut goes through
    last = np.zeros(0, np.uint64)  # the word before the part
    for at in range(0, len(data), CHUNK_BYTES):
        stop = min(at + CHUNK_BYTES, len(data))
        part = data[at:stop]
        starts, ends = word_spans(part, np.array([0, len(part)]))
        sums, sizes = span_sums(part, starts, ends), (ends - starts).astype(np.uint64)
        if open_size and len(starts) and starts[0] == 0:
            sums[0] = (open_sum + pow(BASE, open_size, 1 << 64) * int(sums[0])) % (1 << 64)
            sizes[0] += np.uint64(open_size)
        elif open_size:
            sums, sizes = np.append(np.uint64(open_sum), sums), np.append(np.uint64(open_size), sizes)
        open_sum, open_size = 0, 0
        if stop < len(data) and len(ends) and ends[-1] == len(part) and not (data[stop] == 32 or 9 <= data[stop] <= 13):
            open_sum, open_size = int(sums[-1]), int(sizes[-1])
            sums, sizes = sums[:-1], sizes[:-1]
        words = mix64(sums + sizes)
        yield bucket(words, 1, s.bits)
        row = np.append(last, words)
        yield bucket(pair_hashes(row), 2, s.bits)
        last = row[-1:]
        for n, packed in packed_ngrams(data[at : stop + max(s.orders) - 1], s.orders):
            yield bucket(packed[: len(part)], n << 56, s.bits)


def row_features(data: np.ndarray, s: SubwordSettings) -> Iterator[np.ndarray]:
    """The features of one row."""
    if len(data) > CHUNK_BYTES:
        yield from long_features(data, s)
    else:
        yield from (features for features, _ in feature_streams(data, np.array([0, len(data)]), s))


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


# --- training --------------------------------------------------------------------------------------------


def id_type(s: SubwordSettings) -> str:
    return "<u2" if s.bits <= 16 else "<u4"


def pack_counts(counts: np.ndarray) -> bytes:
    """In the narrowest type that holds all of them; most texts need one byte a feature."""
    return counts.astype(np.min_scalar_type(counts.max(initial=0)).newbyteorder("<")).tobytes()


def unpack_counts(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(packed, f"<u{len(packed) // max(n, 1) or 1}")


def _bags(s: SubwordSettings):
    """Per sampled row its distinct features and their counts, packed."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bag = np.zeros(1 << s.bits, np.int64)  # one for all rows: only what a row holds is kept
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            ids, weights = [], []
            for i in range(batch.num_rows):
                bag[:] = 0
                for features in row_features(data[offsets[i] : offsets[i + 1]], s):
                    bag += np.bincount(features, minlength=1 << s.bits)
                found = np.flatnonzero(bag)
                ids.append(found.astype(id_type(s)).tobytes())
                weights.append(pack_counts(bag[found]))
            columns = [batch.column(0), pa.array(ids, pa.binary()), pa.array(weights, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["label", "ids", "counts"])

    return kernel


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], s: SubwordSettings) -> tuple[np.ndarray, np.ndarray]:
    """Weight of each feature for each class, and the biases, by stochastic gradient descent.

    Classes weigh alike, however many rows each has.
    """
    random = np.random.default_rng(s.seed)
    vectors = random.uniform(-1 / s.dim, 1 / s.dim, (1 << s.bits, s.dim)).astype(np.float32)
    output = random.uniform(-1, 1, (s.dim, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    sizes = np.bincount([label for label, _, _ in rows], minlength=2)
    if len(rows) == 0 or sizes.min() == 0:
        return vectors @ output * 0, bias
    importance = len(rows) / (2 * sizes)
    steps, done = s.epochs * len(rows), 0
    for _ in range(s.epochs):
        for k in random.permutation(len(rows)):
            label, ids, counts = rows[k]
            share = (counts.astype(float) / max(1, counts.sum())).astype(np.float32)  # made again: all of them would take more room than the rows
            rate = s.rate * (1 - done / steps)
            done += 1
            mean = share @ vectors[ids]
            logits = mean @ output + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            error = p * np.float32(importance[label])
            error[label] -= np.float32(importance[label])
            back = output @ error
            output -= rate * np.outer(mean, error)
            bias -= rate * error
            # A feature's share is tiny, so its step is scaled by the number of features of the text.
            vectors[ids] -= (rate * len(ids)) ** 0.5 * 8 * np.outer(share, back)
    return vectors @ output, bias


def _trainer(s: SubwordSettings):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = []
        for batch in batches:
            packed.extend(zip(*(batch.column(c).to_pylist() for c in ("label", "ids", "counts"))))
        packed.sort(key=lambda r: (r[0], len(r[1]), *r[1:]))  # any order of arrival gives one model
        rows = []
        for label, raw, counts in packed:
            ids = np.frombuffer(raw, id_type(s))
            rows.append((label, ids, unpack_counts(counts, len(ids))))
        weights, bias = train(rows, s)
        margin = (weights[:, 1] - weights[:, 0]).astype("<f4").tobytes()
        yield pa.RecordBatch.from_pylist([{"margin": margin, "bias": float(bias[1] - bias[0])}])

    return kernel


def fit(marks: DataFrame, texts: DataFrame, s: SubwordSettings = SubwordSettings()) -> tuple[np.ndarray, float]:
    """Margin of class 1 over class 0 by feature, and the bias, from ``marks(key, label)`` and ``texts(key, text)``.

    The sample is bounded: of each class the ``sample_per_class`` marks with the smallest hash of ``key``; whole texts.
    The bias is corrected to the class shares of all marks, and holds even where a text has no feature.
    Rows with a null label are no examples; without examples of both classes every score is the share of class 1.
    """
    marks = marks.where("key is not null and label in (0, 1)")
    marks = marks.select(F.xxhash64("key").alias("order"), "key", F.col("label").cast("int").alias("label"))
    shares = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for label in (0, 1):
        part = marks.where(F.col("label") == label).orderBy("order", "key").limit(s.sample_per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most 2 * sample_per_class marks, so the texts are not shuffled to find theirs.
    sample = texts.join(F.broadcast(chosen.select("key", "label")), "key").select("label", "text")
    bags = sample.mapInArrow(_bags(s), "label int, ids binary, counts binary")
    model = bags.repartition(1).mapInArrow(_trainer(s), "margin binary, bias double").first()
    prior = float(np.log((shares.get(1, 0) + 1) / (shares.get(0, 0) + 1)))
    return np.frombuffer(model["margin"], "<f4"), model["bias"] + prior


# --- scoring ---------------------------------------------------------------------------------------------


def _scorer(model, s: SubwordSettings):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margin, bias = model.value
        for batch in batches:
            data, offsets = text_bytes(batch.column(batch.num_columns - 1))
            sums, counts = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for i, j in row_groups(offsets):
                part = data[offsets[i] : offsets[j]]
                if len(part) > CHUNK_BYTES:
                    for features in long_features(part, s):
                        sums[i] += margin.take(features).sum(dtype=float)
                        counts[i] += len(features)
                    continue
                for features, at in feature_streams(part, offsets[i : j + 1] - offsets[i], s):
                    sums[i:j] += row_sums(margin.take(features), at)
                    counts[i:j] += np.diff(at)
            logit = np.clip(sums / np.maximum(counts, 1) + bias, -500, 500)
            columns = [*batch.columns[:-1], pa.array(1 / (1 + np.exp(-logit)))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "score"])

    return kernel


def score(docs: DataFrame, model: tuple[np.ndarray, float], keep: list[str], s: SubwordSettings = SubwordSettings(), text_col: str = "text") -> DataFrame:
    """``keep`` columns and ``score``, the probability of class 1. Null or empty text scores by the bias alone."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits floats
    fields = "".join(f"`{c}` {t}, " for c, t in docs.select(*keep).dtypes)
    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(_scorer(sent, s), f"{fields}score double")


def fold(key: Column, folds: int) -> Column:
    """CRC-32 of the key as text, modulo ``folds``; a null key is in fold 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds, F.lit(0))


def fit_quality(docs: DataFrame, labels: DataFrame, s: SubwordSettings = SubwordSettings()) -> tuple[np.ndarray, float]:
    """Model of ``labels.quality`` over the texts of ``docs``, learned from rows outside fold 1 of 3."""
    marks = labels.select(F.col("doc_id").alias("key"), F.col("quality").alias("label")).where(fold(F.col("key"), 3) != 1)
    return fit(marks, docs.select(F.col("doc_id").alias("key"), "text"), s)


def keep_good(docs: DataFrame, model: tuple[np.ndarray, float], s: SubwordSettings = SubwordSettings(), text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least 0.5, with their columns."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("text", F.col("row")[text_col])
    return score(rows, model, ["row"], s).where("score >= 0.5").select("row.*")


def quality_scores(docs: DataFrame, model: tuple[np.ndarray, float], s: SubwordSettings = SubwordSettings()) -> DataFrame:
    """Per row ``doc_id, held_out, score, predicted``."""
    return score(docs, model, ["doc_id"], s).select(
        "doc_id",
        (fold(F.col("doc_id"), 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
