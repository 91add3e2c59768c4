"""N-gram Jaccard join: prefix filters under several global token orders, then exact verification.

Tokens are hashed word shingles. A global order ranks them by how frequent their words are (a count sketch over all
documents) and then by a salted hash; the salts give different orders. If two sets are similar enough they
share tokens of their prefixes under every such order, so a pair must pass all of them before it is verified.

Large groups of near copies are not expanded into pairs: in each bucket (prefix token and size class) all
documents are first compared with one leader and the links found give components. Buckets that are still mixed get a
second leader, each its own, so that many documents of a large group lead. Then only documents of a bucket that are still
in different components are compared, in the bucket of the first token they share (a later one can't be followed by
enough tokens). No pair that could add a link between components is left out, so the components are exact.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.arrowtext import mix64, row_groups, text_bytes
from gridloom.llm.components import components
from gridloom.llm.subword import span_hashes, word_spans
from gridloom.session import discard, materialize

#: Bytes of text that a kernel hashes at a time.
GROUP_BYTES = 1 << 18
SKETCH_BITS = 20
SKETCH_BLOCK = 4096
#: Buckets of the row filter that goes to the tasks: 128 KB, however many documents there are.
FILTER_BITS = 20
PARITY_BITS = 1024


@dataclass(frozen=True)
class JaccardSettings:
    words: int = 5  # words of a shingle
    percent: int = 80  # linked when 100 * intersection >= percent * union
    orders: int = 3  # global token orders that must agree
    common: int = 1  # under the first order, prefixes are longer by common - 1 and must share so many tokens at least


FOLD_CASE = np.arange(256, dtype=np.uint8)
FOLD_CASE[ord("A") : ord("Z") + 1] += 32


# --- shingle sets ----------------------------------------------------------------------------------------

MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(
    hashes: np.ndarray, bounds: np.ndarray, words: int, classes: np.ndarray | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """For each row, the sorted distinct 64-bit hashes of its shingles, and with ``classes`` the sum of the frequency
    classes of the words of each. A row with fewer words is one shingle of all its words.

    ``hashes`` are those of all words in order, row i's at ``bounds[i]:bounds[i+1]``.
    """
    joined = hashes
    for k in range(1, words):
        joined = mix64(joined[: max(0, len(hashes) - k)] * MIX) + hashes[k:]
    joined = mix64(joined)
    grades = None if classes is None else classes[sketch_slots(hashes)].astype(np.uint64)
    sums = None if grades is None else np.append(np.uint64(0), np.cumsum(grades))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= words:
            row, first = np.unique(joined[a : b - words + 1], return_index=True)
            yield row, None if sums is None else sums[first + a + words] - sums[first + a]
        elif b > a:
            short = np.array([b - a], np.uint64)
            for h in hashes[a:b]:
                short = mix64(short * MIX + h)
            yield short, None if sums is None else np.array([sums[b] - sums[a]], np.uint64)
        else:
            yield np.zeros(0, np.uint64), None if sums is None else np.zeros(0, np.uint64)


def word_groups(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(i, j, hashes, bounds)``: the hashed words of rows i to j, a bounded number of bytes at a time."""
    data, offsets = text_bytes(column)
    for i, j in row_groups(offsets, GROUP_BYTES):
        part = FOLD_CASE[data[offsets[i] : offsets[j]]]
        at = offsets[i : j + 1] - offsets[i]
        starts, ends = word_spans(part, at)
        yield i, j, span_hashes(part, starts, ends), np.searchsorted(starts, at)


def sketch_slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def parity_words(tokens: np.ndarray) -> np.ndarray:
    """PARITY_BITS bits, each the parity of the number of tokens hashed to it, as 64-bit words.

    A token that only one of two sets has flips one bit, so the sets differ in at least as many tokens as the words in bits.
    """
    slots = (mix64(tokens) % np.uint64(PARITY_BITS)).astype(np.int64)
    odd = (np.bincount(slots, minlength=PARITY_BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def _profiler(words: int):
    """Per row the set size, the digest and the parity bits of the set; per task one sketch of word counts, in blocks."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int32(), pa.binary()]
        names = ["id", "n", "key", "parity", "block", "counts"]
        for batch in batches:
            sizes, keys, bits = [], [], []
            for _, _, hashes, bounds in word_groups(batch.column(1)):
                np.add.at(sketch, sketch_slots(hashes), 1)
                for tokens, _ in shingle_sets(hashes, bounds, words):
                    sizes.append(len(tokens))
                    keys.append(hashlib.sha256(tokens.tobytes()).digest() if len(tokens) else None)
                    bits.append(parity_words(tokens))
            nothing = [None] * batch.num_rows
            columns = [batch.column(0), sizes, keys, bits, nothing, nothing]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds)], names)
        if sketch.any():
            blocks = range(0, len(sketch), SKETCH_BLOCK)
            packed = [zlib.compress(sketch[k : k + SKETCH_BLOCK].tobytes(), 1) for k in blocks]
            none = [None] * len(packed)
            columns = [none, none, none, none, [k // SKETCH_BLOCK for k in blocks], packed]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return kernel


def _sketch_adder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of sketch blocks while rows stream by; a task holds one array per block it owns."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            part = np.frombuffer(zlib.decompress(packed), np.uint32)
            sums[block] = sums.get(block, 0) + part.astype(np.int64)
    for block, total in sums.items():
        columns = [pa.array([block], pa.int32()), pa.array([total.tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["block", "counts"])


def count_classes(profile: DataFrame) -> np.ndarray:
    """Frequency class of each sketch slot: 0 up to twice the mean count, then one more per doubling.

    Two to the power of SKETCH_BITS bytes, for any number of documents.
    """
    tasks = int(profile.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = profile.where("block is not null").select("block", "counts").repartition(tasks, "block")
    sums = parts.mapInArrow(_sketch_adder, "block int, counts binary").collect()
    total = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in sums:
        total[r["block"] * SKETCH_BLOCK : (r["block"] + 1) * SKETCH_BLOCK] = np.frombuffer(r["counts"], np.int64)
    base = max(1.0, 2 * total.mean())
    return np.clip(np.ceil(np.log2(np.maximum(total, 1) / base)), 0, 40).astype(np.uint8)


def shared_with_larger(size, s: JaccardSettings):
    """Tokens that a set of ``size`` shares at least with a linked set that is not smaller."""
    return (2 * s.percent * size + 99 + s.percent) // (100 + s.percent)


def shared_with_any(size, s: JaccardSettings):
    """Tokens that a set of ``size`` shares at least with any linked set."""
    return (s.percent * size + 99) // 100


def in_order(tokens: np.ndarray, grades: np.ndarray, order: int) -> np.ndarray:
    """Tokens in the given global order: shingles of rare words first, then by a salted hash."""
    salt = np.uint64(0xA0761D6478BD642F * (order + 1) % 2**64)
    rank = mix64(tokens + salt) >> np.uint64(8)
    rank |= np.minimum(grades, np.uint64(255)) << np.uint64(56)
    return tokens[np.argsort(rank, kind="stable")]


def prefix_length(size: int, need: int, common: int) -> int:
    """If two sets share ``need`` tokens, prefixes of this length share ``common`` of them, or all ``need``."""
    return size - need + min(common, need)


# --- postings and sets -----------------------------------------------------------------------------------


def _filtered(batch: pa.RecordBatch, wanted: np.ndarray) -> pa.RecordBatch:
    """Rows whose filter bucket (second column) is set; others surely are not wanted."""
    keep = wanted[batch.column(1).to_numpy()]
    return batch if keep.all() else batch.filter(pa.array(keep))


def _poster(sent, s: JaccardSettings):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, wanted = sent.value
        for batch in batches:
            batch = _filtered(batch, wanted)
            ids = batch.column(0).to_numpy()
            for i, j, hashes, bounds in word_groups(batch.column(2)):
                rows, tokens, sizes, leads, places = [], [], [], [], []
                for row, (found, grades) in enumerate(shingle_sets(hashes, bounds, s.words, classes), i):
                    n = len(found)
                    size = prefix_length(n, shared_with_any(n, s), s.common)
                    rows.append(np.full(size, ids[row]))
                    tokens.append(in_order(found, grades, 0)[:size].view(np.int64))
                    sizes.append(np.full(size, n, np.int32))
                    places.append(np.arange(size, dtype=np.int32))
                    leads.append(places[-1] < prefix_length(n, shared_with_larger(n, s), s.common))
                columns = [pa.array(np.concatenate(c)) for c in (tokens, rows, sizes, leads, places)]
                yield pa.RecordBatch.from_arrays(columns, ["token", "id", "n", "lead", "at"])

    return kernel


def slot_counts(tokens: np.ndarray) -> np.ndarray:
    """How many tokens fall in each slot, at most 255; a power of two of slots, two to four tokens a slot on average."""
    slots = 64
    while slots * 4 < len(tokens):
        slots *= 2
    at = (mix64(tokens) & np.uint64(slots - 1)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=slots), 255).astype(np.uint8)


def least_difference(a: np.ndarray, b: np.ndarray) -> int:
    """Tokens that only one of two sets has, at least, by their ``slot_counts``: each of them moves one count by one."""
    a, b = a.astype(np.int64), b.astype(np.int64)
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):  # slots that agree in the lower bits, added and cut at 255 as if counted so
        a = np.minimum(a[: len(a) // 2] + a[len(a) // 2 :], 255)
    return int(np.abs(a - b).sum())


def _nearer(s: JaccardSettings):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            sizes = zip(batch.column("xn").to_pylist(), batch.column("yn").to_pylist())
            for k, (n, m) in enumerate(sizes):
                a, b = (np.frombuffer(batch.column(c)[k].as_buffer(), np.uint8) for c in ("xs", "ys"))
                both = (s.percent * (n + m) + 99 + s.percent) // (100 + s.percent)
                keep[k] = least_difference(a, b) <= n + m - 2 * both
            ids = [batch.column(c).filter(pa.array(keep)) for c in ("x", "nx", "y")]
            yield pa.RecordBatch.from_arrays(ids, ["x", "nx", "y"])

    return kernel


def _keeper(sent, s: JaccardSettings):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, wanted = sent.value
        for batch in batches:
            batch = _filtered(batch, wanted)
            for i, j, hashes, bounds in word_groups(batch.column(2)):
                sets, heads, sizes, slots = [], [], [], []
                for found, grades in shingle_sets(hashes, bounds, s.words, classes):
                    sets.append(found.tobytes())
                    sizes.append(len(found))
                    slots.append(slot_counts(found).tobytes())
                    size = prefix_length(len(found), shared_with_any(len(found), s), 1)
                    heads.append([in_order(found, grades, r)[:size].view(np.int64) for r in range(1, s.orders)])
                columns = [batch.column(0).slice(i, j - i), pa.array(sets, pa.binary()), pa.array(heads, pa.list_(pa.list_(pa.int64())))]
                columns += [pa.array(sizes, pa.int32()), pa.array(slots, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "tokens", "heads", "size", "slots"])

    return kernel


def _verifier(s: JaccardSettings):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k, (left, right) in enumerate(zip(batch.column("left"), batch.column("right"))):
                a, b = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
                both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
                keep[k] = 100 * both >= s.percent * (len(a) + len(b) - both)
            ids = [batch.column(c).filter(pa.array(keep)) for c in ("x", "y")]
            yield pa.RecordBatch.from_arrays(ids, ["x", "y"])

    return kernel


def _slot(id_col: str = "id") -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(1 << FILTER_BITS)).cast("int")


def row_filter(ids: DataFrame) -> np.ndarray:
    """A bit per hash bucket of ``id``: at most 2**FILTER_BITS integers reach the driver, whatever the number of ids."""
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[ids.select(_slot().alias("slot")).distinct().toArrow().column(0).to_numpy()] = True
    return bits


class JaccardJoin:
    """The stages of one join over ``docs`` (``id`` bigint, ``text``)."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, s: JaccardSettings):
        self.s = s
        self.spark = docs.sparkSession
        self.docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(self) -> DataFrame:
        """One row per input row: ``id, n, component``."""
        s = self.s
        kernel = _profiler(s.words)
        schema = "id bigint, n bigint, key binary, parity array<bigint>, block int, counts binary"
        profile = materialize(self.docs.mapInArrow(kernel, schema), "profile")
        self.classes = count_classes(profile)
        rows = profile.where("n is not null").select("id", "n", "key")
        same = profile.where("key is not null and id is not null").groupBy("key").agg(
            F.min("id").alias("rep"), F.first("parity").alias("parity")
        )
        same = materialize(same, "sets")
        groups = self._links(same)
        # Documents with one set share its representative; representatives share a component.
        named = same.join(groups, same["rep"] == groups["node"], "left").select(
            "key", F.coalesce("component", "rep").alias("component")
        )
        return rows.join(materialize(named, "named"), "key", "left").select(
            "id", "n", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component")
        )

    def _links(self, same: DataFrame) -> DataFrame:
        s = self.s
        reps = same.select(F.col("rep").alias("id"))
        sent = self.spark.sparkContext.broadcast((self.classes, row_filter(reps)))
        filtered = self.docs.where("id is not null").select("id", _slot().alias("slot"), "text")
        # The smaller set of a linked pair meets the larger one in its short prefix (``lead``) already.
        postings = filtered.mapInArrow(_poster(sent, s), "token bigint, id bigint, n int, lead boolean, at int")
        # Most prefix tokens are in one document only: count first, then keep those of two or more.
        postings = materialize(postings, "postings")
        counts = postings.groupBy("token").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.max("lead").alias("lead"))
        # Written before the join, here and below: the adaptive plan cuts a frequent key only where the join
        # reads two plain exchanges, not an aggregation.
        counts = materialize(counts.where("a <> b and lead").select("token"), "counts")
        shared = postings.join(counts, "token")
        # Sizes of linked sets differ by the similarity at most: same or next size class. A bucket is a
        # token and two neighbouring classes, so every linked pair is in a bucket together.
        band = self._band(F.col("n"))
        shared = shared.select("token", "id", "n", "lead", "at", F.explode(F.array(band, band + 1)).alias("band"))
        shared = materialize(shared, "shared")
        discard(postings, counts)
        smallest = F.min(F.when(F.col("lead"), F.struct("n", "id")))
        buckets = shared.groupBy("token", "band").agg(smallest.alias("first"), F.max(F.struct("n", "id")).alias("last"))
        buckets = materialize(buckets.where("first < last").select("token", "band", "first"), "buckets")
        star = shared.join(buckets, ["token", "band"]).where(F.col("first") < F.struct("n", "id"))
        star = star.select(F.col("first.id").alias("x"), F.col("first.n").alias("nx"), F.col("id").alias("y"), F.col("n").alias("ny"), "band")
        first = self._verify(self._candidates(star))
        mixed = self._mixed(shared, first)
        discard(shared, buckets)
        # An id has one row here unless rows with one id differ in their sets; then no bits are compared for it.
        bits = same.groupBy("rep").agg(F.when(F.count(F.lit(1)) == 1, F.first("parity")).alias("parity"))
        bits = materialize(bits, "parity")
        links = first.unionByName(self._verify(self._drawn(mixed, bits)))
        open_rows = self._mixed(mixed.drop("c"), links)
        discard(mixed)
        found = links.unionByName(self._verify(self._across(open_rows, bits)))
        discard(open_rows, bits)
        return materialize(components(found, "x", "y"), "components")

    def _mixed(self, shared: DataFrame, links: DataFrame) -> DataFrame:
        """The rows of buckets that hold several components, with their component ``c``."""
        groups = materialize(components(links, "x", "y"), "groups")
        marked = shared.join(groups, shared["id"] == groups["node"], "left").withColumn("c", F.coalesce("component", "id"))
        marked = marked.drop("node", "component")
        keys = marked.groupBy("token", "band").agg(F.min("c").alias("a"), F.max("c").alias("b"), F.max("lead").alias("lead"))
        keys = materialize(keys.where("a <> b and lead").select("token", "band"), "keys")
        return materialize(marked.join(keys, ["token", "band"]), "mixed")

    def _drawn(self, mixed: DataFrame, bits: DataFrame) -> DataFrame:
        """Pairs of each bucket with a document that is drawn by a hash."""
        draw = F.struct(F.xxhash64("token", "id").alias("draw"), "id", "n", "lead", "at", "c")
        leaders = materialize(mixed.groupBy("token", "band").agg(F.min(draw).alias("l")), "leaders")
        drawn = leaders.select("token", "band", "l.*").drop("draw")
        pairs = materialize(self._pairs(drawn, mixed).unionByName(self._pairs(mixed, drawn)).distinct(), "drawn")
        near = pairs
        for side in ("x", "y"):
            near = near.join(bits.select(F.col("rep").alias(side), F.col("parity").alias(f"{side}_parity")), side)
        near = materialize(near.where(self._bits_fit("nx", "ny", "x_parity", "y_parity")).select("x", "nx", "y", "ny"), "candidates")
        discard(leaders, pairs)
        return near

    def _across(self, mixed: DataFrame, bits: DataFrame) -> DataFrame:
        """Pairs of a bucket whose components differ. The bucket's largest component is not paired with itself."""
        sizes = mixed.groupBy("token", "band", "c").agg(F.count(F.lit(1)).alias("size"))
        top = materialize(sizes.groupBy("token", "band").agg(F.max(F.struct("size", "c")).alias("top")), "top")
        marked = mixed.join(top, ["token", "band"]).withColumn("major", F.col("c") == F.col("top.c")).drop("top")
        marked = materialize(marked.join(bits, marked["id"] == bits["rep"]).drop("rep"), "marked")
        minor = marked.where("not major")
        near = self._bits_fit("x.n", "y.n", "x.parity", "y.parity")
        pairs = self._pairs(minor, marked, near).unionByName(self._pairs(marked.where("major"), minor, near))
        pairs = materialize(pairs.distinct(), "candidates")
        discard(top, marked)
        return pairs

    def _bits_fit(self, nx: str, ny: str, x: str, y: str) -> Column:
        """Whether parity bits differ in no more bits than linked sets have tokens of their own."""
        differ = sum(F.bit_count(F.col(x)[k].bitwiseXOR(F.col(y)[k])) for k in range(PARITY_BITS // 64))
        return F.coalesce(differ <= F.col(nx) + F.col(ny) - 2 * self._both(F.col(nx), F.col(ny)), F.lit(True))

    def _pairs(self, smaller: DataFrame, larger: DataFrame, near: Column | None = None) -> DataFrame:
        """Pairs of rows of a bucket that can be linked, the first the smaller set.

        Left out are those of one component, those that are not ``near``, and those of which a row has too few tokens behind
        this one if it is the first that they share.
        """
        x, y = smaller.where("lead").alias("x"), larger.alias("y")
        fits = (F.col("x.c") != F.col("y.c")) & (F.struct("x.n", "x.id") < F.struct("y.n", "y.id"))
        fits &= self._sizes_fit(F.col("x.n"), F.col("y.n")) & self._own_bucket(F.col("y.n"), F.col("x.band"))
        fits &= F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) >= self._both(F.col("x.n"), F.col("y.n"))
        fits = fits if near is None else fits & near
        same = (F.col("x.token") == F.col("y.token")) & (F.col("x.band") == F.col("y.band"))
        return x.join(y, same & fits).select(F.col("x.id").alias("x"), F.col("x.n").alias("nx"), F.col("y.id").alias("y"), F.col("y.n").alias("ny"))

    def _both(self, a: Column, b: Column) -> Column:
        """Tokens that linked sets of these sizes share at least."""
        return F.call_function("div", self.s.percent * (a + b) + 99 + self.s.percent, F.lit(100 + self.s.percent))

    def _band(self, n: Column) -> Column:
        return F.floor(F.log(n.cast("double")) / F.log(F.lit(100.0 / self.s.percent)) + 1e-9).cast("int")

    def _own_bucket(self, larger: Column, band: Column) -> Column:
        """Two sets may share two buckets of a token; they count in the one of the larger class."""
        return self._band(larger) == band

    def _sizes_fit(self, smaller: Column, larger: Column) -> Column:
        return smaller * 100 >= larger * self.s.percent

    def _candidates(self, hits: DataFrame) -> DataFrame:
        """Pairs ``x, nx, y, ny`` (x the smaller set) with enough shared prefix tokens under the first order.

        One of the two prefixes ends first; all common tokens in it are hits, and it can miss no more tokens than the set may.
        """
        s = self.s
        both = self._both(F.col("nx"), F.col("ny"))
        low = self._both(F.col("nx"), F.col("nx"))
        high = F.call_function("div", s.percent * F.col("ny") + 99, F.lit(100))
        need = both - F.greatest(low - s.common, high - s.common, F.lit(0))
        hits = hits.where(self._sizes_fit(F.col("nx"), F.col("ny")) & self._own_bucket(F.col("ny"), F.col("band")))
        pairs = hits.groupBy("x", "nx", "y", "ny").agg(F.count(F.lit(1)).alias("hits")).where(F.col("hits") >= need)
        return materialize(pairs.drop("hits"), "candidates")

    def _verify(self, pairs: DataFrame) -> DataFrame:
        """Linked pairs, written: those that pass the other orders, then the exact similarity of their sets. ``pairs`` goes.

        A pair whose ends the links found before connect already is left out: it joins no components.
        """
        given = pairs
        s = self.s
        ids = pairs.select(F.col("x").alias("id")).unionByName(pairs.select(F.col("y").alias("id")))
        sent = self.spark.sparkContext.broadcast((self.classes, row_filter(ids)))
        filtered = self.docs.where("id is not null").select("id", _slot().alias("slot"), "text")
        sets = filtered.mapInArrow(_keeper(sent, s), "id bigint, tokens binary, heads array<array<bigint>>, size int, slots binary")
        sets = materialize(sets.where(F.length("tokens") > 0), "sets")
        short = (F.col("nx") - self._both(F.col("nx"), F.col("nx")) + 1).cast("int")
        heads = F.transform("heads", lambda h: F.slice(h, F.lit(1), short))
        pairs = pairs.join(sets.select(F.col("id").alias("x"), "heads"), "x").withColumn("x_heads", heads).drop("heads")
        pairs = pairs.join(sets.select(F.col("id").alias("y"), F.col("heads").alias("y_heads")), "y")
        for r in range(s.orders - 1):
            pairs = pairs.where(F.arrays_overlap(F.col("x_heads")[r], F.col("y_heads")[r]))
        pairs = met = materialize(pairs.select("x", "nx", "y").distinct(), "met")
        # Counts by slot are a sixteenth of a set or less, and rule out most pairs of long texts, for which parity bits are too few.
        for side in ("x", "y"):
            counts = sets.select(F.col("id").alias(side), F.col("size").alias(f"{side}n"), F.col("slots").alias(f"{side}s"))
            pairs = pairs.join(counts, side)
        near = pairs.select("x", "nx", "y", "xn", "xs", "yn", "ys").mapInArrow(_nearer(s), "x bigint, nx int, y bigint")
        passed = materialize(near.distinct(), "passed")
        # A set travels with each of its pairs, so one pair of each larger set is compared first: most others are then
        # within a component and need no comparison.
        least = passed.groupBy("y").agg(F.min(F.struct("nx", "x")).alias("least"))
        chosen = materialize(least.select(F.col("least.x").alias("x"), "y"), "chosen")
        first = self._exact(chosen, sets)
        groups = materialize(components(first, "x", "y"), "groups")
        rest = passed.select("x", "y").join(chosen, ["x", "y"], "left_anti")
        for side in ("x", "y"):
            named = groups.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
            rest = rest.join(named, side, "left").withColumn(f"c{side}", F.coalesce(f"c{side}", side))
        rest = materialize(rest.where("cx <> cy").select("x", "y"), "rest")
        links = first.unionByName(self._exact(rest, sets))
        discard(given, sets, met, passed, chosen, groups, rest)
        sent.unpersist()
        return links

    def _exact(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Those of ``pairs`` whose whole sets are similar enough, written."""
        for side, name in (("x", "left"), ("y", "right")):
            pairs = pairs.join(sets.select(F.col("id").alias(side), F.col("tokens").alias(name)), side)
        kernel = _verifier(self.s)
        return materialize(pairs.select("x", "y", "left", "right").mapInArrow(kernel, "x bigint, y bigint"), "links")


def similarity_components(docs: DataFrame, s: JaccardSettings = JaccardSettings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``<id_col>, n_shingles, component_id`` (the smallest id reachable by links).

    Null text, or text without words, has an empty set and no links; so has a row with a null id. Equal ids
    are one document. Only the two named columns are read. An empty table gives an empty result.
    """
    out = JaccardJoin(docs, id_col, text_col, s).run()
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_one_of_each(docs: DataFrame, s: JaccardSettings = JaccardSettings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component; rows with a null id stay."""
    found = similarity_components(docs, s, id_col, text_col).where(F.col(id_col) != F.col("component_id"))
    return docs.join(found.select(id_col).distinct(), id_col, "left_anti")
