"""Benchmark decontamination by pigeonhole edit matching.

A test item of length m may occur in a document with up to k edits. Cut into k + 1 pieces, at least one piece
must occur unchanged; an Aho-Corasick automaton finds all piece hits in one pass over the text, and Myers'
bit-parallel algorithm verifies the window around a hit.

Items go to the tasks in blocks of bounded size, so a benchmark of any size takes more passes, not
more memory.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class MatchSettings:
    error_rate: float = 0.08  # edits per character of an item, rounded down
    min_chars: int = 20  # shorter items are searched as whole words, with the same share of edits
    block_chars: int = 4_000_000  # characters of items in one pass


def normal(text: str | None) -> str:
    """Lower case, every run of white space one space."""
    return " ".join((text or "").lower().split())


def cut(item: str, parts: int) -> list[tuple[int, str]]:
    """``parts`` pieces of nearly equal length with their offsets."""
    at = [len(item) * k // parts for k in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(at, at[1:])]


def myers(pattern: dict[str | None, int], size: int, text: str | list[str | None]) -> tuple[int, int]:
    """Smallest edit distance of the pattern to a substring of ``text``, and where the first such substring ends.

    ``pattern`` has for each character the bit mask of its places.
    """
    full, last = (1 << size) - 1, 1 << (size - 1)
    up, down, score = full, 0, size
    best, end = size, 0
    for at, char in enumerate(text, 1):
        match = pattern.get(char, 0)
        vertical = match | down
        horizontal = (((match & up) + up) ^ up) | match
        rise = down | (full & ~(horizontal | up))
        fall = up & horizontal
        if rise & last:
            score += 1
        elif fall & last:
            score -= 1
        rise = (rise << 1) & full
        fall = (fall << 1) & full
        up = fall | (full & ~(vertical | rise))
        down = rise & vertical
        if score < best:
            best, end = score, at
    return best, end


def masks(item: str | list[str | None]) -> dict[str | None, int]:
    out: dict[str | None, int] = defaultdict(int)
    for k, char in enumerate(item):
        out[char] |= 1 << k
    return dict(out)


def framed(text: str, errors: int) -> list[str | None]:
    """With more marks at both ends than edits allowed: Myers' distance to a part is then the one to the whole."""
    return [None] * (errors + 1) + list(text) + [None] * (errors + 1)


def whole_words(text: str, start: int, end: int) -> bool:
    """Whether neither end of the stretch lies within a word."""
    return not any(0 < at < len(text) and text[at - 1].isalnum() and text[at].isalnum() for at in (start, end))


class Matcher:
    """Search of one block of items, ``(item_id, normalised text)``."""

    def __init__(self, items: list[tuple[int, str]], s: MatchSettings):
        self.items = [(i, x, int(len(x) * s.error_rate)) for i, x in items if x]
        self.short = [len(x) < s.min_chars for _, x, _ in self.items]
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, item, errors) in enumerate(self.items):
            for offset, piece in cut(item, errors + 1):
                pieces[piece].append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if pieces:
            self.automaton.make_automaton()
        self.forward = [masks(x) for _, x, _ in self.items]
        self.backward = [masks(x[::-1]) for _, x, _ in self.items]
        self.framed = [masks(framed(x, e)) if short else None for (_, x, e), short in zip(self.items, self.short)]

    def _whole_words(self, k: int, text: str, start: int) -> tuple[int, int, int] | None:
        """Nearest stretch of whole words to a short item that begins near ``start``: ``(distance, start, end)``."""
        _, item, errors = self.items[k]
        found = []
        for a in range(max(0, start - 2 * errors), start + 2 * errors + 1):
            for b in range(max(a, start + len(item) - 2 * errors), min(len(text), start + len(item) + 2 * errors) + 1):
                if whole_words(text, a, b):
                    distance, _ = myers(self.framed[k], len(item) + 2 * (errors + 1), framed(text[a:b], errors))
                    if distance <= errors:
                        found.append((distance, a, b))
        return min(found, default=None)

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """Best occurrence of each item found: ``(item_id, distance, start, end)`` in the normalised text."""
        best: dict[int, tuple[int, int, int]] = {}
        seen: dict[int, list[int]] = defaultdict(list)
        for stop, (length, places) in self.automaton.iter(text) if self.items else ():
            for k, offset in places:
                _, item, errors = self.items[k]
                start = stop + 1 - length - offset  # where the item would begin without edits
                if k in best and best[k][0] == 0 or any(abs(start - x) <= errors for x in seen[k][-8:]):
                    continue
                seen[k].append(start)
                if self.short[k]:
                    found = self._whole_words(k, text, start)
                    if found and (k not in best or found < best[k]):
                        best[k] = found
                    continue
                if text.startswith(item, start) and start >= 0:
                    best[k] = (0, start, start + len(item))
                    continue
                low = max(0, start - 2 * errors)  # a hit shifted by up to ``errors`` lies in this window too
                window = text[low : start + len(item) + 2 * errors]
                distance, end = myers(self.forward[k], len(item), window)
                if distance <= errors and (k not in best or distance < best[k][0]):
                    back, width = myers(self.backward[k], len(item), window[:end][::-1])
                    best[k] = (distance, low + end - width, low + end)
        return [(self.items[k][0], *found) for k, found in sorted(best.items())]


def _search(sent, s: MatchSettings):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(sent.value, s)
        schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0), batch.column(1)):
                found = matcher.find(normal(text.as_py()))
                rows += [(doc.as_py(), *x) for x in found]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), schema.types)] if rows else [pa.array([], t) for t in schema.types]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return kernel


def _clean(sent, s: MatchSettings):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(sent.value, s)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            stay = pa.array([not matcher.find(normal(x.as_py())) for x in texts], pa.bool_())
            yield batch.select(range(batch.num_columns - 1)).filter(stay)

    return kernel


def _blocks(benchmark: DataFrame, s: MatchSettings) -> Iterator[list[tuple[int, str]]]:
    """``(item_id, normalised text)`` of all items in blocks of about ``block_chars`` characters, at least one block."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0  # one number
    passes = max(1, -(-chars // s.block_chars))
    for k in range(passes):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)
        yield [(r["item_id"], normal(r["text"])) for r in block.toLocalIterator()]


def contaminations(docs: DataFrame, benchmark: DataFrame, s: MatchSettings = MatchSettings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and item found in it: ``doc_id, item_id, distance, start, end`` (of the best occurrence, in
    the lower-cased text with single spaces).

    Null and empty texts and items match nothing; items shorter than ``min_chars`` match as whole words only. Rows
    with repeated ids are searched each by itself. Without items or documents the result is empty.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for rows in _blocks(benchmark, s):
        sent = docs.sparkSession.sparkContext.broadcast(rows)
        found = slim.mapInArrow(_search(sent, s), "doc_id bigint, item_id bigint, distance int, start bigint, end bigint")
        out = found if out is None else out.unionByName(found)
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, s: MatchSettings = MatchSettings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item was found, each judged by its own text, whatever its id (``id_col`` is not read)."""
    for rows in _blocks(benchmark, s):
        sent = docs.sparkSession.sparkContext.broadcast(rows)
        docs = docs.select("*", F.col(text_col).alias("__text")).mapInArrow(_clean(sent, s), docs.schema)
    return docs
