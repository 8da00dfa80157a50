"""Document fingerprints (operator 1): a homomorphic multiset hash, in DataFrame functions only.

A text is the multiset of its paragraphs (lines). Every paragraph is hashed to a wide vector and the fingerprint is
the sum of the vectors, each lane modulo 2**32. So the order of the paragraphs does not matter, and a paragraph is
inserted or deleted by adding or subtracting its vector (`combined`). The vector has two parts:

* IDENTITY lanes of 32 bits hashed from the paragraph as it is. Two texts have equal fingerprints when their
  paragraphs are the same, and otherwise with negligible chance.
* LIKENESS lanes: a paragraph's runs of up to RUN words each add the bits of a hash, and one lane counts the runs.
  Twice a lane less that count is a signed sum, so the cosine of two fingerprints estimates the cosine of the two
  multisets of runs, with a standard error of 1/sqrt(LIKENESS). It is clamped to 0..1; 1 if both have no words.

Neighbours: rows are dealt to at most BUCKETS ranges of equal width over the ids. Only the first id of each range
(one row a range, a bounded broadcast) is needed to hand a copy of the next range's first row to a range, so whole
texts are shuffled once, and everything after happens inside the ranges.

Null text is empty. Null ids come first. Rows repeated under one id follow each other by text. With one row the next
document is itself. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IDENTITY = 8
LIKENESS = 64
RUN = 3
ROWS_A_BUCKET = 32
BUCKETS = 1 << 16

_MASK = (1 << 32) - 1
_PIECES = r"(?=\n)"
_RUNS = r"(?:[^\s]++[^\S\n]*+){1,%d}" % RUN


def _units(text: Column) -> Column:
    """Paragraphs, marked by a line break before them, and runs of words, which never begin with white space."""
    return F.concat(F.split(F.concat(F.lit("\n"), text), _PIECES), F.regexp_extract_all(text, F.lit(_RUNS), F.lit(0)))


def _sums() -> list[Column]:
    """Sums over the units `u`: identity lanes, then pairs of likeness lanes in one long, then the number of runs."""
    paragraph = F.col("paragraph")
    out = []
    for k in range(IDENTITY // 2):
        h = F.xxhash64(F.lit(k), "u")
        out.append(F.sum(F.when(paragraph, h.bitwiseAND(_MASK)).otherwise(0)))
        out.append(F.sum(F.when(paragraph, F.shiftrightunsigned(h, 32)).otherwise(0)))
    ones = (1 << 32) + 1
    for k in range(LIKENESS // 2):
        bit = F.shiftrightunsigned(F.col("h"), k).bitwiseAND(ones)  # bits k and k + 32, in lanes of 32 bits
        out.append(F.sum(F.when(paragraph, 0).otherwise(bit)))
    return [*out, F.sum(F.when(paragraph, 0).otherwise(1))]


def _summed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Fingerprints of the texts `t`: their lanes as the array `lanes`."""
    units = rows.select(*keys, F.explode(_units(F.col("t"))).alias("u"))
    units = units.select(*keys, "u", F.col("u").startswith("\n").alias("paragraph"), F.xxhash64("u").alias("h"))
    names = [f"l{k}" for k in range(IDENTITY + LIKENESS // 2 + 1)]
    sums = units.groupBy(*keys).agg(*[s.alias(n) for s, n in zip(_sums(), names)])
    low = [F.col(n).bitwiseAND(_MASK) for n in names[:IDENTITY]]
    pairs = names[IDENTITY:-1]
    low += [F.col(n).bitwiseAND(_MASK) for n in pairs] + [F.shiftrightunsigned(n, 32).bitwiseAND(_MASK) for n in pairs]
    return sums.select(*keys, F.array(*low, F.col(names[-1]).bitwiseAND(_MASK)).alias("lanes"))


def text_of(lanes: str) -> Column:
    """A fingerprint as text: eight hexadecimal digits a lane."""
    return F.lower(F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def likeness(a: str, b: str) -> Column:
    """Cosine of two fingerprints' runs, from 0 to 1."""

    def signed(lanes: str) -> Column:
        runs = F.element_at(lanes, -1)
        return F.transform(F.slice(lanes, IDENTITY + 1, LIKENESS), lambda x: 2.0 * x - runs)

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda total, p: total + p)

    x, y = signed(a), signed(b)
    cosine = F.try_divide(dot(x, y), F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))
    equal = F.slice(a, IDENTITY + 1, LIKENESS + 1) == F.slice(b, IDENTITY + 1, LIKENESS + 1)
    return F.when(equal, 1.0).otherwise(F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)), F.lit(0.0)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, lanes) of every distinct row: the fingerprint as numbers below 2**32."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    found = _summed(rows.withColumn("text_key", F.xxhash64("t")), ["id", "text_key"])
    return found.select(F.col("id").alias(id_col), "text_key", "lanes")


def combined(a: str, b: str, sign: int = 1) -> Column:
    """Lanes of the texts of `a` and `b` together, or with sign -1 of `a` without the paragraphs of `b`."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + sign * y, F.lit(1 << 32)))


def _dealt(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows (`id`, `t`) in `bucket`s by id, and `ghost` copies of the row behind each bucket."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    ids = rows.select("id")
    low, high, n = ids.agg(F.min("id"), F.max("id"), F.count("*")).first()
    low, high = low or 0, high or 0
    buckets = max(1, min(BUCKETS, n // ROWS_A_BUCKET))
    width = (high - low) // buckets + 1
    bucket = F.coalesce(F.floor((F.col("id") - low) / width), F.lit(0)).cast("long").alias("bucket")
    if width > 1 << 50:  # the quotient above is of doubles
        bucket = F.coalesce(F.shiftright("id", 48) - (low >> 48), F.lit(0)).cast("long").alias("bucket")
    first = F.min(F.struct(F.col("id").isNotNull().alias("some"), F.col("id")))
    firsts = ids.select("id", bucket).groupBy("bucket").agg(first["id"].alias("first"))
    # at most BUCKETS rows: the first id of each range, and the range before it (before the first: the last)
    order = Window.orderBy("bucket")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag("bucket").over(order), F.last("bucket").over(whole)).alias("before")
    firsts = firsts.select("bucket", "first", before)
    placed = rows.select("id", "t", bucket).join(F.broadcast(firsts), "bucket")
    here = F.struct("bucket", F.lit(False).alias("ghost"))
    there = F.struct(F.col("before").alias("bucket"), F.lit(True).alias("ghost"))
    homes = F.when(F.col("id").eqNullSafe(F.col("first")), F.array(here, there)).otherwise(F.array(here))
    return placed.select("id", "t", F.inline(homes))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's rows: fingerprints of every text and of its edited text, and how alike they and the next are."""
    inside = Window.partitionBy("bucket").orderBy("ghost", "id", "t")
    rows = _dealt(docs, id_col, text_col).withColumns({"place": F.row_number().over(inside), "next": F.lead("t").over(inside)})
    size = F.char_length("t").cast("long")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.expr("substring(t, 1, cast(n_chars - floor(n_chars / 2) as int))"), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half))
    rows = rows.select("bucket", "place", "ghost", "id", "t", "next", size.alias("n_chars"))
    rows = rows.select("bucket", "place", "ghost", "id", "n_chars", "t", F.when(~F.col("ghost"), edited).alias("edited"))
    both = F.array(
        F.struct(F.lit(0).alias("which"), F.col("t").alias("t"), F.lit(None).cast("string").alias("sha")),
        F.struct(F.lit(1).alias("which"), F.col("edited").alias("t"), F.sha2("edited", 256).alias("sha")),
    )
    keys = ["bucket", "place", "ghost", "id", "n_chars"]
    texts = rows.select(*keys, F.inline(both)).where("t is not null")
    found = _summed(texts, [*keys, "which", "sha"])
    # both fingerprints of a row, and that of the next, meet inside the bucket
    pair = Window.partitionBy("bucket").orderBy("place", "which")
    found = found.select(
        *keys, "which", "lanes", F.lead("lanes", 1).over(pair).alias("second"), F.lead("lanes", 2).over(pair).alias("third"), F.lead("sha", 1).over(pair).alias("edited_sha256")
    ).where("which = 0 and not ghost")
    return found.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256",
        text_of("lanes").alias("fingerprint"), text_of("second").alias("edited_fingerprint"),
        likeness("lanes", "second").alias("near_edited"), likeness("lanes", "third").alias("near_next"),
    )
