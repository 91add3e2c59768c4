"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding by offsets.

Pre-tokenisation runs no regular expression. Each code point gets a symbol from a class table (and from
the class of its right neighbour); each symbol is a transition function of an eight-state automaton.
Function composition is associative, so the states of a whole text come from a blocked scan: functions
are composed inside blocks side by side, the blocks are scanned by doubling, and a second pass reads off
the states. A second table says at which (state, symbol) a slice begins.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.arrowtext import row_groups, text_bytes

# Code points with the property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# Fixed value: the split pattern of the rank files, which the automaton below stands for.
SLICES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# Classes of code points.
OTHER, LETTER, NUMBER, SPACE, QUOTE, BLANK = range(6)

# Symbols: a class seen together with its right neighbour.
S_END, S_LETTER, S_SHORT, S_PAIR, S_NUMBER, S_OTHER, S_QUOTE, S_RUN, S_JOIN, S_LONE, S_PAD = range(11)

# States: what is open before a code point.
CLOSED, AFTER_JOIN, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACE, AFTER_QUOTE, IN_SUFFIX = range(8)

SCAN_BLOCK = 64
PIECE_CHARS = 1 << 18
#: Slices longer than this are merged without being remembered.
CACHED_CHARS = 48
CACHE_ENTRIES = 100_000
#: Slices up to so many bytes are merged side by side, longer ones alone.
TOGETHER_BYTES = 64
NO_RANK = np.iinfo(np.int64).max


def class_table() -> np.ndarray:
    """Class of every code point.

    Code points that Python's Unicode version does not know yet follow the installed tokenizer library: an
    encoding whose only merges are ``a`` or ``1`` with a next byte shows which of them share a slice with a
    letter or a number.
    """
    kinds = np.frombuffer("".join(map(unicodedata.category, map(chr, range(0x110000)))).encode(), np.uint8)
    table = np.full(0x110000, OTHER, np.uint8)
    table[kinds[::2] == ord("L")] = LETTER
    table[kinds[::2] == ord("N")] = NUMBER
    unknown = np.flatnonzero((kinds[::2] == ord("C")) & (kinds[1::2] == ord("n")))
    unknown = unknown[unknown < 0x40000]
    for probe, kind in (("a", LETTER), ("1", NUMBER)):
        ranks = {bytes([c]): c for c in range(256)} | {probe.encode() + bytes([c]): 256 + c for c in range(256)}
        library = tiktoken.Encoding("classes", pat_str=SLICES, mergeable_ranks=ranks, special_tokens={})
        known = np.array([library.encode_ordinary(probe + chr(c))[0] >= 256 for c in unknown.tolist()], bool)
        table[unknown[known]] = kind
    table[WHITE_SPACE] = BLANK
    table[0x20] = SPACE
    table[0x27] = QUOTE
    return table


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a slice begins, both indexed by ``symbol * 8 + state``."""
    step = np.zeros((11, 8), np.uint8)
    begin = np.ones((11, 8), np.uint8)

    def rule(symbols: list[int], target: int, inside: list[int]) -> None:
        for s in symbols:
            step[s, :] = target
            begin[s, inside] = 0

    letters = [S_LETTER, S_SHORT, S_PAIR]
    rule(letters, IN_LETTERS, [IN_LETTERS, AFTER_JOIN])
    rule([S_NUMBER], IN_NUMBERS, [IN_NUMBERS, AFTER_JOIN])
    rule([S_OTHER], IN_OTHERS, [IN_OTHERS, AFTER_JOIN, AFTER_QUOTE])
    rule([S_QUOTE], IN_OTHERS, [IN_OTHERS, AFTER_JOIN, AFTER_QUOTE])
    step[S_QUOTE, [CLOSED, IN_LETTERS, IN_NUMBERS, IN_SPACE, IN_SUFFIX]] = AFTER_QUOTE
    rule([S_RUN], IN_SPACE, [IN_SPACE])
    rule([S_JOIN], AFTER_JOIN, [])
    rule([S_LONE], CLOSED, [])
    rule([S_END], CLOSED, [])
    step[S_PAD, :] = np.arange(8)
    # A quote that opens a slice, then s, t, m, d, or the two letters of re, ve, ll.
    step[S_SHORT, AFTER_QUOTE], begin[S_SHORT, AFTER_QUOTE] = CLOSED, 0
    step[S_PAIR, AFTER_QUOTE], begin[S_PAIR, AFTER_QUOTE] = IN_SUFFIX, 0
    for s in letters:
        step[s, IN_SUFFIX], begin[s, IN_SUFFIX] = CLOSED, 0
    return step.ravel(), begin.ravel()


def symbols_of(points: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Symbols of one text (or of texts set apart by code point 0x110000, which ends both sides)."""
    ends = points == 0x110000
    kinds = table[np.where(ends, 0, points)]
    space = ((kinds == SPACE) | (kinds == BLANK)) & ~ends
    solid_next = np.zeros(len(points), bool)
    solid_next[:-1] = ~space[1:] & ~ends[1:]
    after = np.zeros(len(points), np.uint32)
    after[:-1] = points[1:]
    out = np.full(len(points), S_OTHER, np.uint8)
    out[kinds == LETTER] = S_LETTER
    out[kinds == NUMBER] = S_NUMBER
    out[kinds == QUOTE] = S_QUOTE
    for c in "stmd":
        out[points == ord(c)] = S_SHORT
    for c, follow in (("r", "e"), ("v", "e"), ("l", "l")):
        out[(points == ord(c)) & (after == ord(follow))] = S_PAIR
    out[space] = S_RUN
    out[space & solid_next & (kinds == SPACE)] = S_JOIN
    out[space & solid_next & (kinds == BLANK)] = S_LONE
    out[ends] = S_END
    return out


def slice_starts(symbols: np.ndarray) -> np.ndarray:
    """Positions at which a slice begins, by a blocked associative scan of the transition functions."""
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64)
    step, begin = _automaton()
    blocks = -(-n // SCAN_BLOCK)
    padded = np.full(blocks * SCAN_BLOCK, S_PAD, np.uint8)
    padded[:n] = symbols
    columns = np.ascontiguousarray(padded.reshape(blocks, SCAN_BLOCK).T) * np.uint8(8)
    composed = np.repeat(np.arange(8, dtype=np.uint8)[:, None], blocks, axis=1)
    for column in columns:  # all blocks at once, one symbol further each time
        composed = step.take(composed + column)
    shift = 1
    while shift < blocks:  # inclusive scan over the blocks by doubling
        later = np.take_along_axis(composed[:, shift:], composed[:, :-shift], axis=0)
        composed = np.concatenate([composed[:, :shift], later], axis=1)
        shift *= 2
    state = np.zeros(blocks, np.uint8)
    state[1:] = composed[CLOSED, :-1]
    marks = np.empty((SCAN_BLOCK, blocks), np.uint8)
    for j, column in enumerate(columns):
        at = state + column
        marks[j] = begin.take(at)
        state = step.take(at)
    return np.flatnonzero(marks.T.reshape(-1)[:n])


class Merger(dict):
    """Packed ids by slice of text. New slices are merged together, step by step, as numpy arrays."""

    def __init__(self, ranks: dict[bytes, int], pair_keys: np.ndarray, pair_ranks: np.ndarray):
        super().__init__()
        self.ranks = ranks
        self.of_byte = np.array([ranks[bytes([c])] for c in range(256)], np.int64)
        self.pair_keys, self.pair_ranks = pair_keys, pair_ranks
        self.pairs: dict[int, int] = {}

    def pack(self, slices: list[str]) -> list[bytes]:
        """Packed ids of each slice."""
        if len(self) > CACHE_ENTRIES:
            self.clear()
        fresh = [x for x in set(slices) if x not in self]
        short, raws = [], []
        for x in fresh:
            raw = x.encode("utf-8", "surrogatepass")
            if (whole := self.ranks.get(raw)) is not None:
                self[x] = whole.to_bytes(4, "little")
            elif len(raw) <= TOGETHER_BYTES:
                short.append(x)
                raws.append(raw)
            else:
                self[x] = np.array(self.merge_long(raw), "<u4").tobytes()
        if short:
            self.update(zip(short, self.merge_together(raws)))
        out = list(map(self.__getitem__, slices))
        for x in fresh:
            if len(x) > CACHED_CHARS:
                del self[x]
        return out

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NO_RANK)

    def merge_together(self, raws: list[bytes]) -> list[bytes]:
        """In each step every slice joins its leftmost pair of lowest rank; slices without one are done."""
        lengths = np.fromiter(map(len, raws), np.int64, len(raws))
        ids = self.of_byte[np.frombuffer(b"".join(raws), np.uint8)]
        word = np.repeat(np.arange(len(raws)), lengths)
        out: list[bytes] = [b""] * len(raws)
        last = np.append(word[1:] != word[:-1], True)
        ranks = np.where(last, NO_RANK, self.pair_rank(ids, np.append(ids[1:], 0)))
        while len(ids):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            sizes = np.diff(np.append(starts, len(word)))
            best = np.minimum.reduceat(ranks, starts)
            over = best == NO_RANK
            if over.any():
                packed = ids.astype("<u4").tobytes()
                for w, a, n in zip(word[starts[over]].tolist(), starts[over].tolist(), sizes[over].tolist()):
                    out[w] = packed[4 * a : 4 * (a + n)]
                stay = np.repeat(~over, sizes)
                ids, word, ranks = ids[stay], word[stay], ranks[stay]
                best, sizes = best[~over], sizes[~over]
                if not len(ids):
                    break
            hits = np.flatnonzero(ranks == np.repeat(best, sizes))
            at = hits[np.append(True, word[hits[1:]] != word[hits[:-1]])]  # one in each slice
            ids[at] = ranks[at]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            ids, word, ranks = ids[stay], word[stay], ranks[stay]
            at = at - np.arange(len(at))
            for place in (at, at[at > 0] - 1):  # only pairs beside the joined ones have changed
                right = np.minimum(place + 1, len(ids) - 1)
                inside = (place + 1 < len(ids)) & (word[place] == word[right])
                ranks[place] = np.where(inside, self.pair_rank(ids[place], ids[right]), NO_RANK)
        return out

    def merge_long(self, raw: bytes) -> list[int]:
        """The same rule for one long slice, with a heap of pairs."""
        pairs = self.pairs
        if not pairs:
            pairs.update(zip(self.pair_keys[:-1].tolist(), self.pair_ranks[:-1].tolist()))
        n = len(raw)
        ids = self.of_byte[np.frombuffer(raw, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # one of its parts has changed
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := pairs.get(rank << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[k]))
            if (h := before[i]) >= 0 and (r := pairs.get(ids[h] << 32 | rank)) is not None:
                heapq.heappush(heap, (r, h, ids[h], rank))
        return [x for x in ids if x >= 0]


def pair_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Every way to join two tokens to a token: sorted ``left << 32 | right`` and the rank; an end mark last."""
    pairs = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                pairs[left << 32 | right] = rank
    keys = np.fromiter(pairs, np.int64, len(pairs))
    order = np.argsort(keys)
    values = np.fromiter(pairs.values(), np.int64, len(pairs))[order]
    return np.append(keys[order], np.iinfo(np.int64).max), np.append(values, NO_RANK)


def safe_pieces(text: str, limit: int = PIECE_CHARS) -> Iterator[str]:
    """Cut a long text where white space follows other text: a slice begins there whatever came before."""
    at = 0
    while len(text) - at > limit:
        cut = at + limit
        while cut < len(text) and not (text[cut] in " \n\t" and not text[cut - 1].isspace() and text[cut - 1] > "\x1f"):
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def encode_text(text: str, table: np.ndarray, merger: Merger) -> bytes:
    """Packed little-endian ids of one text."""
    out = []
    for piece in safe_pieces(text) if text else ():
        points = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = slice_starts(symbols_of(points, table)).tolist()
        ends = starts[1:] + [len(piece)]
        out.append(b"".join(merger.pack([piece[a:b] for a, b in zip(starts, ends)])))
    return b"".join(out)


def encode_group(texts: list[str], table: np.ndarray, merger: Merger) -> list[bytes]:
    """Packed ids of each of several short texts, scanned together."""
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    firsts = np.cumsum(lengths) - lengths
    spread = np.full(len(points) + len(texts), 0x110000, np.uint32)
    row = np.repeat(np.arange(len(texts)), lengths)
    spread[np.arange(len(points)) + row] = points  # an end mark follows each text
    starts = slice_starts(symbols_of(spread, table))
    starts = starts[spread[starts] != 0x110000]
    owner = np.searchsorted(firsts + np.arange(len(texts)), starts, side="right") - 1
    starts -= owner
    cuts = starts.tolist()
    packed = merger.pack([joined[a:b] for a, b in zip(cuts, cuts[1:] + [len(joined)])])
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
    return [b"".join(packed[a:b]) for a, b in zip(bounds, bounds[1:])]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def token_bytes(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All token bytes in id order, and the start and length of each id."""
    size = max(ranks.values(), default=-1) + 1
    parts = [b""] * size
    for token, rank in ranks.items():
        parts[rank] = token
    lengths = np.fromiter(map(len, parts), np.int64, size)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(lengths) - lengths, lengths


def _encoder(tables):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, ranks, *pairs = tables.value
        merger = Merger(ranks, *pairs)
        _, _, lengths = token_bytes(ranks)
        for batch in batches:
            data, offsets = text_bytes(batch.column(batch.num_columns - 1))
            for i, j in row_groups(offsets):
                texts = [
                    data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[i:j], offsets[i + 1 : j + 1])
                ]
                ids = encode_group(texts, table, merger) if j - i > 1 else [encode_text(texts[0], table, merger)]
                ends = [np.cumsum(lengths[np.frombuffer(x, "<u4")]).astype("<u4").tobytes() for x in ids]
                kept = [c.slice(i, j - i) for c in batch.columns[:-1]]
                names = [*batch.schema.names[:-1], "ids", "ends"]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(ids, pa.binary()), pa.array(ends, pa.binary())], names)

    return kernel


def _decoder(tables):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, starts, lengths = token_bytes(tables.value[1])
        for batch in batches:
            out = []
            for ids, ends in zip(batch.column("ids"), batch.column("ends")):
                tokens = np.frombuffer(ids.as_buffer(), "<u4")
                stops = np.frombuffer(ends.as_buffer(), "<u4").astype(np.int64)
                sizes = lengths[tokens]
                shift = starts[tokens] - (stops - sizes)  # from a place in the text to its place in the vocabulary
                total = int(stops[-1]) if len(stops) else 0
                out.append(flat[np.arange(total) + np.repeat(shift, sizes)].tobytes())
            kept = [c for c, name in zip(batch.columns, batch.schema.names) if name not in ("ids", "ends")]
            names = [name for name in batch.schema.names if name not in ("ids", "ends")]
            first = [batch.column("ids"), pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays([*kept, *first], [*names, "ids", "decoded"])

    return kernel


def tables_of(spark: SparkSession, rank_path: str):
    """Class table, ranks and pairs, made once on the driver and sent to each worker once.

    About 8 MB for 50,000 ranks: the size follows the vocabulary, never the documents.
    """
    ranks = read_ranks(rank_path)
    return spark.sparkContext.broadcast((class_table(), ranks, *pair_table(ranks)))


def encode(docs: DataFrame, tables, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns, ``ids`` (packed little-endian 32-bit ids) and ``ends`` (for each id, the byte of the
    text at which it ends). Null text counts as empty and gives no ids. Columns not in ``keep`` are dropped,
    so clashing names do no harm; ``keep`` itself can't hold ``ids``, ``ends`` or ``decoded``.
    """
    slim = docs.select(*keep, F.col(text_col).alias("__text"))
    fields = "".join(f"`{c}` {t}, " for c, t in docs.select(*keep).dtypes)
    return slim.mapInArrow(_encoder(tables), f"{fields}ids binary, ends binary")


def decode(encoded: DataFrame, tables) -> DataFrame:
    """``encoded`` with ``decoded`` (bytes) in place of ``ends``."""
    keep = [c for c in encoded.columns if c not in ("ids", "ends")]
    fields = "".join(f"`{c}` {t}, " for c, t in encoded.select(*keep).dtypes)
    return encoded.mapInArrow(_decoder(tables), f"{fields}ids binary, decoded binary")


def _digester(tables):
    """Both kernels in one Python node; only digests leave it."""
    encoded, decoded = _encoder(tables), _decoder(tables)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in decoded(encoded(batches)):
            ids = [x.as_buffer() for x in batch.column("ids")]
            columns = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64())]
            columns.append(pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()))
            columns.append(pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in batch.column("decoded")], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [batch.schema.names[0], "n_tokens", "ids_sha256", "decoded_sha256"])

    return kernel


def digests(docs: DataFrame, rank_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode; per row the number of ids and SHA-256 of the ids and of the decoded bytes."""
    tables = tables_of(docs.sparkSession, rank_path)
    slim = docs.select(id_col, F.col(text_col).alias("__text"))
    kind = slim.dtypes[0][1]
    return slim.mapInArrow(_digester(tables), f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
