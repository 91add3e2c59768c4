"""Language ID by mixture inference.

Each language has a smoothed distribution of hashed byte trigrams, counted over all training texts. A word's
likelihood in a language is that of its trigrams. For each document, expectation-maximisation estimates
the shares of the languages over its words; the set of languages is chosen among the largest shares by
log-likelihood less a penalty per language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.arrowtext import CHUNK_BYTES, row_groups, text_bytes
from gridloom.llm.subword import bucket, fold, row_sums, span_hashes, word_spans

UNDETERMINED = "und"


@dataclass(frozen=True)
class MixtureSettings:
    bits: int = 16
    smoothing: float = 0.1
    rounds: int = 10  # of expectation-maximisation with all languages
    refit: int = 4  # of rounds for each smaller set
    penalty: float = 4.0  # log-likelihood per language, times half the log of the number of words


FOLD_CASE = np.arange(256, dtype=np.uint8)
FOLD_CASE[ord("A") : ord("Z") + 1] += 32


def trigram_buckets(data: np.ndarray, offsets: np.ndarray, bits: int, before: int = 32, behind: int = 32) -> np.ndarray:
    """Bucket of the trigram around each byte, with spaces around each row; white space counts as a space.

    ``before`` and ``behind`` are the bytes around ``data`` where it is a part of a row.
    """
    padded = np.concatenate([[before], data, [behind]]).astype(np.uint8)
    padded = FOLD_CASE[padded]
    padded[(padded >= 9) & (padded <= 13)] = 32
    left, right = padded[:-2].copy(), padded[2:].copy()
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    left[inner] = 32
    right[inner - 1] = 32
    packed = left.astype(np.uint64) | padded[1:-1].astype(np.uint64) << np.uint64(8) | right.astype(np.uint64) << np.uint64(16)
    return bucket(packed, 3, bits)


def long_parts(data: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
    """A long row in parts, with the bytes before and behind each."""
    for at in range(0, len(data), CHUNK_BYTES):
        stop = min(at + CHUNK_BYTES, len(data))
        yield data[at:stop], int(data[at - 1]) if at else 32, int(data[stop]) if stop < len(data) else 32


# --- learning --------------------------------------------------------------------------------------------


def _counter(s: MixtureSettings):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            data, offsets = text_bytes(batch.column(1))
            for i, j in row_groups(offsets):
                data_here, names = data[offsets[i] : offsets[j]], np.array(langs[i:j], object)
                # Several rows are within the bound; one row may be longer and comes in parts.
                parts = [(data_here, 32, 32)] if j - i > 1 else long_parts(data_here)
                for part, before, behind in parts:
                    bounds = offsets[i : j + 1] - offsets[i] if j - i > 1 else np.array([0, len(part)])
                    buckets = trigram_buckets(part, bounds, s.bits, before, behind)
                    for lang in set(names):
                        wanted = np.repeat(names == lang, np.diff(bounds))
                        table = tables.setdefault(lang, np.zeros(1 << s.bits, np.int64))
                        table += np.bincount(buckets[wanted], minlength=1 << s.bits)
        for lang, table in tables.items():
            seen = np.flatnonzero(table)
            columns = [pa.array([lang] * len(seen), pa.string()), pa.array(seen.astype(np.int32)), pa.array(table[seen])]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "bucket", "n"])

    return kernel


def learn(docs: DataFrame, s: MixtureSettings = MixtureSettings(), lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities ``[language, bucket]``, counted over every row with a language and a text.

    The model has languages x 2**bits numbers, however many texts there are.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(lang_col, text_col)
    parts = rows.mapInArrow(_counter(s), "lang string, bucket int, n bigint")
    sums = parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = np.array(sums.column("lang").to_pylist(), object)
    langs = sorted(set(names))
    table = np.full((len(langs), 1 << s.bits), s.smoothing)
    for k, lang in enumerate(langs):
        own = names == lang
        table[k, sums.column("bucket").to_numpy()[own]] += sums.column("n").to_numpy()[own]
    if not langs:
        return [], table.astype(np.float32)
    return langs, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


# --- inference -------------------------------------------------------------------------------------------


def word_logs(buckets: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Log-likelihoods ``[language, word]``."""
    logs = np.empty((len(table), len(starts)))
    for k, weights in enumerate(table):
        total = np.zeros(len(buckets) + 1)
        np.cumsum(weights.take(buckets), out=total[1:])
        logs[k] = total[ends] - total[starts]
    return logs


def relative(logs: np.ndarray) -> np.ndarray:
    """Likelihoods relative to the best language of each word."""
    return np.exp(logs - logs.max(axis=0)) if logs.shape[1] else logs


def word_likelihoods(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Relative likelihoods ``[language, word]`` and each row's bounds among the words."""
    starts, ends = word_spans(data, offsets)
    logs = word_logs(trigram_buckets(data, offsets, bits), starts, ends, table)
    return relative(logs), np.searchsorted(starts, offsets)


def long_row_likelihoods(data: np.ndarray, table: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Relative likelihoods of the different words of one long row and how often each occurs.

    The row is read in parts; a word across a cut is put together again.
    """
    keys, counts, logs = [], [], []  # of different words, parts appended and merged now and then
    odd: list[np.ndarray] = []  # words across cuts
    merged, open_word = 1 << 16, None

    def merge() -> None:
        key, at, to = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        count = np.bincount(to, np.concatenate(counts), len(key))
        log = np.concatenate(logs, axis=1)[:, at]
        keys[:], counts[:], logs[:] = [key], [count], [log]

    for part, before, behind in long_parts(data):
        bounds = np.array([0, len(part)])
        starts, ends = word_spans(part, bounds)
        found = word_logs(trigram_buckets(part, bounds, bits, before, behind), starts, ends, table)
        hashes = span_hashes(FOLD_CASE[part], starts, ends)
        whole = np.ones(len(starts), bool)
        begun = open_word
        open_word = None
        if begun is not None:
            if len(starts) and starts[0] == 0:
                found[:, 0] += begun
                whole[0] = False
            else:
                odd.append(begun)
        if len(ends) and ends[-1] == len(part) and not (behind == 32 or 9 <= behind <= 13):
            open_word, whole[-1] = found[:, -1], False
            if len(starts) == 1 and begun is not None and starts[0] == 0:
                continue  # one word fills the part
        if begun is not None and len(starts) and starts[0] == 0:
            odd.append(found[:, 0])
        key, at, count = np.unique(hashes[whole], return_index=True, return_counts=True)
        keys.append(key), counts.append(count.astype(float)), logs.append(found[:, whole][:, at])
        if sum(map(len, keys)) > 2 * merged:
            merge()
            merged = max(merged, len(keys[0]))
    if keys:
        merge()
    every = np.concatenate([*logs, np.stack(odd, axis=1)] if odd else logs, axis=1)
    return relative(every), np.concatenate([*counts, np.ones(len(odd))])


def em(likely: np.ndarray, bounds: np.ndarray, shares: np.ndarray, rounds: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``rounds`` of EM from ``shares [language, row]``; the last shares and the log-likelihood of each row.

    ``counts`` says how often each word stands in its row.
    """
    sizes = np.diff(bounds)
    safe = np.maximum(row_sums(counts, bounds), 1)
    mixed = np.zeros(0)
    for _ in range(rounds):
        joint = likely * np.repeat(shares, sizes, axis=1)
        mixed = np.maximum(joint.sum(axis=0), 1e-300)
        joint *= counts / mixed
        shares = np.stack([row_sums(j, bounds) for j in joint]) / safe
    joint = likely * np.repeat(shares, sizes, axis=1)
    mixed = np.maximum(joint.sum(axis=0), 1e-300)
    return shares, row_sums(counts * np.log(mixed), bounds)


def infer(likely: np.ndarray, bounds: np.ndarray, s: MixtureSettings, counts: np.ndarray | None = None) -> np.ndarray:
    """Shares ``[language, row]`` under the chosen set of languages; rows without words get equal shares."""
    langs, rows = len(likely), len(bounds) - 1
    counts = np.ones(bounds[-1]) if counts is None else counts
    words = row_sums(counts, bounds)
    every, fit = em(likely, bounds, np.full((langs, rows), 1 / langs), s.rounds, counts)
    cost = s.penalty * 0.5 * np.log(np.maximum(words, 2))
    best, value = every, fit - cost * langs
    rank = np.argsort(np.argsort(-every, axis=0, kind="stable"), axis=0, kind="stable")
    for size in range(langs - 1, 0, -1):
        kept = np.where(rank < size, np.maximum(every, 1e-12), 0.0)
        kept /= kept.sum(axis=0)
        shares, fit = em(likely, bounds, kept, s.refit if size > 1 else 0, counts)
        better = fit - cost * size >= value
        best = np.where(better, shares, best)
        value = np.where(better, fit - cost * size, value)
    best[:, words == 0] = 1 / langs
    return best


def _predictor(model, s: MixtureSettings):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = model.value
        for batch in batches:
            data, offsets = text_bytes(batch.column(batch.num_columns - 1))
            lettered = batch.column(batch.num_columns - 2).to_numpy(zero_copy_only=False).astype(bool)
            shares = np.zeros((len(langs), batch.num_rows))
            for i, j in row_groups(offsets) if langs else ():
                part = data[offsets[i] : offsets[j]]
                if len(part) <= CHUNK_BYTES:
                    shares[:, i:j] = infer(*word_likelihoods(part, offsets[i : j + 1] - offsets[i], table, s.bits), s)
                else:
                    likely, counts = long_row_likelihoods(part, table, s.bits)
                    shares[:, i:j] = infer(likely, np.array([0, len(counts)]), s, counts)
            known = lettered & bool(langs)
            top = shares.argmax(axis=0) if langs else np.zeros(batch.num_rows, int)
            names = [langs[k] if ok else UNDETERMINED for k, ok in zip(top.tolist(), known.tolist())]
            scores = np.where(known, shares.max(axis=0), 0.0) if langs else np.zeros(batch.num_rows)
            mixture = [
                [{"lang": langs[k], "share": float(v)} for k, v in enumerate(column) if v > 0] if ok else []
                for column, ok in zip(shares.T.tolist(), known.tolist())
            ]
            kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            extra = [pa.array(names, pa.string()), pa.array(np.clip(scores, 0, 1)), pa.array(mixture, kind)]
            columns = [*batch.columns[:-2], *extra]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-2], "lang_pred", "score", "mixture"])

    return kernel


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str], s: MixtureSettings = MixtureSettings(), text_col: str = "text") -> DataFrame:
    """``keep`` columns, ``lang_pred``, ``score`` (its share) and ``mixture`` (the chosen languages and shares).

    A null text, one without letters, and every text under a model without languages is ``und`` with score 0.
    Equal shares go to the language that sorts first.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # languages x 2**bits floats
    text = F.col(text_col)
    slim = docs.select(*keep, F.coalesce(text.rlike("\\p{L}"), F.lit(False)).alias("__letters"), text.alias("__text"))
    fields = "".join(f"`{c}` {t}, " for c, t in docs.select(*keep).dtypes)
    schema = f"{fields}lang_pred string, score double, mixture array<struct<lang string, share double>>"
    return slim.mapInArrow(_predictor(sent, s), schema)


def identify(docs: DataFrame, s: MixtureSettings = MixtureSettings()) -> DataFrame:
    """Learn outside fold 0 of 5, predict every row: ``doc_id, held_out, lang_pred, score, mixture``."""
    held = fold(F.col("doc_id"), 5) == 0
    model = learn(docs.where(~held), s)
    return predict(docs, model, ["doc_id"], s).withColumn("held_out", held)
