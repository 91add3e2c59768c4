"""Repeated passages of lines by winnowing over line hashes.

Of the lines that begin within ``window`` words of a line's beginning, the one with the smallest hash is a
fingerprint; every line has such a window. The choice depends on the lines of the window alone, so equal passages have
equal fingerprints. A fingerprint is known by its surroundings, to the right (with the lines that begin within
``min_words`` words of its beginning) and to the left (with those that end within ``min_words`` words before its end), so an
early line that stands by itself can't be taken for the passage. Each of the two is joined with its first occurrence, one
row per key on that side however often a line is repeated, and the match is extended line by line both ways, as far as
twice ``min_words`` words. Stretches of matched lines with at least ``min_words`` words are deleted.

A run of at least ``min_words + window - 1`` words holds a fingerprint with its right side, whatever stands around the
run. The lines between two fingerprints of a run belong to the right side of the first of them. Shorter runs are found
where a fingerprint has its side within them. With the window of one word every line is a fingerprint, and every run of
``min_words`` is found; wider windows leave fewer fingerprints to write and join.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import discard, materialize

MIN_WORDS = 10

def _document(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``body`` and ``th``, a hash of the body: rows of equal id and text are one document."""
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body")).select(
        "id", "body", F.xxhash64("body").alias("th")
    )


def _lines(docs: DataFrame) -> DataFrame:
    """``id, th, pos, h, w``: a line's hash (128 bits of SHA-256) and weight in words, at least 1."""
    lines = docs.select("id", "th", F.posexplode(F.split("body", "\n", -1)).alias("pos", "line"))
    lines = lines.select("id", "th", "pos", F.trim("line").alias("line"))
    spaces = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit("")))
    hashed = F.substring(F.unhex(F.sha2(F.col("line"), 256)), 1, 16)
    return lines.select("id", "th", "pos", hashed.alias("h"), (spaces + 1).cast("long").alias("w"))


def _anchors(lines: DataFrame, min_words: int, window: int) -> DataFrame:
    """``id, th, pos, w, keys, right, left`` of each fingerprint; ``keys`` has one hash of the content of either side.

    ``right`` holds the lines behind the fingerprint that begin within ``reach`` words of its end, ``left`` those before it
    that end within ``reach`` words of its beginning, nearest first. Every line weighs a word at least, so there are no more
    than ``reach`` lines on a side. Sides of fewer than ``min_words`` words have no key.
    """
    reach = 2 * min_words
    doc = Window.partitionBy("id", "th")
    by_pos, by_words = doc.orderBy("pos"), doc.orderBy("at")
    # Rows of one document come together once; all windows below reuse that placement.
    rows = lines.repartition("id", "th").groupBy("id", "th", "pos").agg(F.first("h").alias("h"), F.first("w").alias("w"))
    before = F.coalesce(F.sum("w").over(by_pos.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("at", before)
    rows = rows.withColumn("pick", F.min(F.struct("h", "pos")).over(by_words.rangeBetween(0, window - 1))["pos"])
    picks = F.collect_set("pick").over(by_words.rangeBetween(-(window - 1), 0))
    line = F.struct("h", "w", "at")
    rows = rows.withColumn("mark", F.array_contains(picks, F.col("pos")))
    rows = rows.withColumn("ahead", F.collect_list(line).over(by_pos.rowsBetween(1, reach)))
    rows = rows.withColumn("behind", F.reverse(F.collect_list(line).over(by_pos.rowsBetween(-reach, -1))))
    end = F.col("at") + F.col("w")
    rows = rows.where("mark").withColumn("ahead", F.filter("ahead", lambda x: x["at"] < end + reach))
    rows = rows.withColumn("behind", F.filter("behind", lambda x: x["at"] + x["w"] > F.col("at") - reach))
    right = F.filter("ahead", lambda x: x["at"] < F.col("at") + min_words)
    left = F.filter("behind", lambda x: x["at"] + x["w"] > end - min_words)
    slim = lambda xs: F.transform(xs, lambda x: F.struct(x["h"].alias("h"), x["w"].alias("w")))

    def key(side: str, xs: Column) -> Column:
        content = F.aggregate(xs, F.concat(F.lit(side).cast("binary"), F.col("h")), lambda c, x: F.concat(c, x["h"]))
        words = F.aggregate(xs, F.col("w"), lambda n, x: n + x["w"])
        return F.when(words >= min_words, F.substring(F.unhex(F.sha2(content, 256)), 1, 16))

    keys = F.filter(F.array(key("r", right), key("l", left)), lambda k: k.isNotNull())
    return rows.select("id", "th", "pos", "w", slim("ahead").alias("right"), slim("behind").alias("left"), keys.alias("keys")).where(F.size("keys") > 0)


def _common(mine: Column, other: Column) -> Column:
    """Number of leading entries with equal hashes."""
    agree = F.zip_with(mine, other, lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
    start = F.struct(F.lit(True).alias("open"), F.lit(0).alias("n"))

    def step(state: Column, same: Column) -> Column:
        go = state["open"] & same
        return F.struct(go.alias("open"), (state["n"] + go.cast("int")).alias("n"))

    return F.aggregate(agree, start, step, lambda s: s["n"])


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, window: int = 1) -> DataFrame:
    """The lines to delete: ``id, th, pos, w, source`` (id of the document with the earlier run)."""
    anchors = materialize(_anchors(_lines(_document(docs, id_col, text_col)), min_words, window), "anchors")
    # Places alone are joined by key; the neighbours follow for the repeated ones.
    keyed = materialize(anchors.select("id", "th", "pos", F.explode("keys").alias("key")), "keyed")
    place = F.struct(F.col("id").isNull().alias("nil"), "id", "th", "pos")
    first = keyed.groupBy("key").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # Written first: the adaptive plan cuts a frequent key only where the join reads two plain exchanges.
    first = materialize(first.select("key", "first.id", "first.th", "first.pos"), "first")
    names = ("id", "th", "pos")
    later = keyed.join(first.select("key", *[F.col(c).alias(f"first_{c}") for c in names]), "key").drop("key")
    itself = [F.col(c).eqNullSafe(F.col(f"first_{c}")) for c in names]
    later = materialize(later.where(~(itself[0] & itself[1] & itself[2])).distinct(), "later")
    own = anchors.select(*[F.col(c).alias(f"own_{c}") for c in names], "w", "right", "left")
    later = later.join(own, (F.col("id").eqNullSafe(F.col("own_id"))) & (F.col("th") == F.col("own_th")) & (F.col("pos") == F.col("own_pos")))
    source = anchors.select(*[F.col(c).alias(f"at_{c}") for c in names], F.struct("right", "left").alias("first"))
    at = F.col("first_id").eqNullSafe(F.col("at_id")) & (F.col("first_th") == F.col("at_th")) & (F.col("first_pos") == F.col("at_pos"))
    later = later.join(source, at)

    def run(side: str, sign: int) -> Column:
        """The neighbours on one side that agree with those of the first occurrence, with their positions."""
        alike = F.slice(side, F.lit(1), _common(F.col(side), F.col(f"first.{side}")))
        return F.transform(alike, lambda x, i: F.struct((F.col("pos") + sign * (i + 1)).alias("pos"), x["w"].alias("w")))

    mine = F.array(F.struct("pos", "w"))
    found = F.explode(F.concat(mine, run("right", 1), run("left", -1))).alias("x")
    hits = later.select("id", "th", F.col("first_id").alias("source"), found)
    hits = hits.groupBy("id", "th", F.col("x.pos").alias("pos")).agg(F.max("x.w").alias("w"), F.min("source").alias("source"))
    # Stretches of neighbouring lines; all of a document's rows are few compared with its text.
    doc = Window.partitionBy("id", "th")
    hits = hits.withColumn("run", F.col("pos") - F.row_number().over(doc.orderBy("pos")))
    size = F.sum("w").over(Window.partitionBy("id", "th", "run"))
    hits = hits.withColumn("words", size).where(F.col("words") >= min_words).select("id", "th", "pos", "w", "source")
    hits = materialize(hits, "repeats")
    discard(anchors, keyed, first)
    return hits


def delete_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, window: int = 1) -> DataFrame:
    """``row`` (a struct of the columns of ``docs``, with ``text_col`` without the repeated lines), ``lines`` and
    ``deleted`` (line counts), ``words`` (deleted), ``sources`` (ids of earlier documents) and ``emptied`` (no
    word is left of a text that lost lines), for every row of ``docs``.

    The first of equal runs, by id and then position, stays; a null id comes after all others. Null text counts as
    one empty line and stays null. Rows of equal id and text are one document and get the same result; rows of equal id
    and different text are ordered by a hash of the text. ``docs`` may have any other columns.
    """
    gone = repeated_lines(docs, id_col, text_col, min_words, window).groupBy("id", "th")
    gone = gone.agg(F.collect_set("pos").alias("gone"), F.sum("w").alias("words"), F.array_sort(F.collect_set("source")).alias("sources"))
    gone = gone.withColumnRenamed("id", "gone_id").withColumnRenamed("th", "gone_th")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    body = F.coalesce(F.col("row")[text_col], F.lit(""))
    rows = rows.select("row", F.col("row")[id_col].alias("id"), F.xxhash64(body).alias("th"))
    rows = rows.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("th") == F.col("gone_th")), "left")
    rows = rows.withColumn("every", F.split(body, "\n", -1))
    places = F.sequence(F.lit(0), F.size("every") - 1)
    stay = F.transform(F.array_except(places, F.col("gone")), lambda i: F.get("every", i))
    hit = F.col("gone").isNotNull()
    rows = rows.withColumn("left", F.when(hit, F.array_join(stay, "\n")).otherwise(F.col("row")[text_col]))
    solid = F.coalesce(F.col("left").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    return rows.select(
        F.col("row").withField(text_col, F.col("left")).alias("row"),
        F.size("every").cast("long").alias("lines"),
        F.when(hit, F.size("gone")).otherwise(0).cast("long").alias("deleted"),
        F.coalesce("words", F.lit(0)).cast("long").alias("words"),
        F.when(hit, F.col("sources")).otherwise(F.array().cast(gone.schema["sources"].dataType)).alias("sources"),
        (hit & ~solid).alias("emptied"),
    )
