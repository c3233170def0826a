"""Order MinHash fingerprints, sensitive to edits and to the order of what a text says; DataFrame functions only.

A text is cut into units of at most ``UNIT`` characters, anew at each word, and every ``k`` units in a row are a k-mer.
K-mers that repeat within a text are numbered by occurrence, so each occurrence is an item with a hash of its own.
The hash's leading bits deal the items into ``BINS`` bins, each a sketch; the ``width`` smallest of a bin, put in text
order, are hashed as one tuple. Two texts are as alike as the share of bins, of those that either fills, with equal
tuples: swapping or replacing k-mers changes tuples where a plain MinHash would only see the set.

Numbers are packed so that arrays of longs sort natively: 6 bits of bin, 32 bits of hash, 26 bits of position.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

UNIT, K, WIDTH = 4, 3, 2
BINS = 64
ROWS_PER_RANGE = 1500
_PLACE = 26
_MASK = (1 << _PLACE) - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _bin(item: Column) -> Column:
    return F.shiftrightunsigned(item, 58)


def _items(grams: Column) -> Column:
    """Hash and position of every occurrence-numbered k-mer, in order of the hash."""

    def numbered(s: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.shiftright(F.get(s, i), _PLACE) != F.shiftright(F.get(s, i - 1), _PLACE)))

        def item(v: Column, nth: Column) -> Column:
            h = F.xxhash64(F.shiftright(v, _PLACE), nth)
            return F.shiftleft(F.shiftright(h, _PLACE), _PLACE).bitwiseOR(v.bitwiseAND(_MASK))

        return let(heads, lambda a: F.flatten(F.transform(a, lambda at, r: F.transform(
            F.slice(s, at + 1, F.coalesce(F.get(a, r + 1), F.size(s)) - at), item))))

    packed = F.transform(grams, lambda x, i: F.shiftleft(x, _PLACE).bitwiseOR(i.cast("long").bitwiseAND(_MASK)))
    return F.sort_array(let(F.sort_array(packed), numbered))


def signature(text: Column, k: int = K, width: int = WIDTH) -> Column:
    """Array of one number for each bin that has items: the bin in its low bits, the tuple's hash above."""

    def grams(u: Column) -> Column:
        n = F.size(u)
        each = F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.xxhash64(*[F.get(u, i + (j - 1)) for j in range(k)]))
        return F.when(n >= k, each).otherwise(F.array(F.xxhash64(F.concat_ws(" ", u))))

    def tuples(items: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(items) - 1), lambda i: (i == 0) | (_bin(F.get(items, i)) != _bin(F.get(items, i - 1))))

        def tuple_of(i: Column) -> Column:
            own = _bin(F.get(items, i))
            least = F.filter(F.slice(items, i + 1, width), lambda v: _bin(v) == own)
            placed = F.sort_array(F.transform(least, lambda v: F.shiftleft(v, 64 - _PLACE).bitwiseOR(F.shiftrightunsigned(v, _PLACE))))
            return F.pmod(F.xxhash64(F.transform(placed, lambda v: v.bitwiseAND((1 << 64 - _PLACE) - 1))), F.lit(1 << 34)) * BINS + own

        return F.transform(heads, tuple_of)

    units = F.regexp_extract_all(text, F.lit(rf"(\S{{1,{UNIT}}})"), F.lit(1))
    return let(units, lambda u: F.when(F.size(u) == 0, F.array().cast("array<bigint>")).otherwise(let(_items(grams(u)), tuples)))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal tuples among the bins that either signature fills; 1 for two empty ones."""
    filled = F.size(F.array_union(F.transform(a, lambda x: F.pmod(x, F.lit(BINS))), F.transform(b, lambda x: F.pmod(x, F.lit(BINS)))))
    return F.when(filled == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / filled)


def as_text(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x)), 10, "0")), "")


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, signature, next_text, next_signature) of every row: the next is the next row in descending doc_id,
    after the last comes the first. Null texts count as empty, whose signature is empty.

    Rows are dealt into ranges of ids of about equal width. Each range finds its own successors; the first row of every
    range, one row each, gives the successor of the last row of the range before. Null ids come last, rows that share
    an id are ordered by text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ends = rows.agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    ranges = max(1, ends.n // ROWS_PER_RANGE)
    width = ((ends.high or 0) - (ends.low or 0)) // ranges + 1
    rows = rows.withColumn("range", F.coalesce(F.expr(f"(doc_id - {ends.low or 0}L) div {width}L"), F.lit(-1).cast("long")))
    order = [F.desc_nulls_last("doc_id"), F.asc("text")]
    own = Window.partitionBy("range").orderBy(*order)
    signed = rows.withColumn("signature", signature(F.col("text")))
    led = signed.withColumns({"next_text": F.lead("text").over(own), "next_signature": F.lead("signature").over(own)})
    firsts = rows.withColumn("nth", F.row_number().over(own)).where("nth = 1")
    firsts = firsts.select("range", F.struct("text", signature(F.col("text")).alias("signature")).alias("first"))
    down = Window.orderBy(F.desc("range"))  # one row for each range
    everything = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = rows.select("range").distinct()
    to = heads.select("range", F.coalesce(F.lead("range").over(down), F.first("range").over(everything)).alias("to"))
    after = to.join(firsts.withColumnRenamed("range", "to"), "to").select("range", F.col("first").alias("after"))
    led = led.join(after, "range")
    inside = F.col("next_signature").isNotNull()
    return led.select("doc_id", "text", "signature", F.when(inside, F.col("next_text")).otherwise(F.col("after.text")).alias("next_text"),
                      F.when(inside, F.col("next_signature")).otherwise(F.col("after.signature")).alias("next_signature"))


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last third of code points is the start of the next text.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next). An empty text is its own
    edited text; in a table of one row the next is the row itself; an empty table gives an empty result. Columns other
    than doc_id and text are not read.
    """
    rows = with_next(docs)
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "signature", "next_signature")
    rows = rows.withColumn("edited_signature", signature(F.col("edited")))
    return rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text(F.col("signature")).alias("fingerprint"),
                       as_text(F.col("edited_signature")).alias("edited_fingerprint"), likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
                       likeness(F.col("signature"), F.col("next_signature")).alias("near_next"))
