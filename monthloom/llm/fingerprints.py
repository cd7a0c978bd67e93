"""Document fingerprints: one-permutation MinHash with optimal densification and b-bit packing.

All by DataFrame functions. Every shingle is hashed once; the hash's top bits name its bin, and the least hash
of each bin is kept. An empty bin tries other bins in an order of its own until one is occupied: ``ATTEMPTS``
fixed permutations of the bins first, then all occupied bins by a hash. So it picks uniformly among the occupied
bins, and alike in all documents. Of each bin the ``LOW`` lowest bits
are stored, packed into 64-bit words; agreement by chance is subtracted when two fingerprints are compared.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from monthloom.llm.common import SPACES, id_key, text_or_empty
from monthloom.sources.store import cut_lineage

BINS, LOW, SHINGLE = 256, 4, 5
_SHIFT = 64 - (BINS.bit_length() - 1)
#: The last hash of a bin stands for an empty one.
_LAST = (1 << _SHIFT) - 1
_WORDS = BINS * LOW // 64
_PER_WORD = 64 // LOW
ATTEMPTS = 12
_ATTEMPTS = [random.Random(f"bins {t}").sample(range(BINS), BINS) for t in range(ATTEMPTS)]
#: Coarse pieces of the id range, and rows aimed at in each bucket of neighbouring ids.
PIECES, BUCKET_ROWS = 64, 1024


def with_fingerprint(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Add ``name``: the packed words of the fingerprint of ``text``; no words at all give an empty array.

    Shingles are runs of ``SHINGLE`` lower-cased words; fewer words are one shingle. Every step is a column
    that the next one uses more than once, so none is computed again inside a loop over an array.
    """
    w, h, s, o, m, v, e, d = (f"_{name}_{c}" for c in "whsomved")
    rows = rows.withColumn(w, F.split(F.btrim(F.lower(F.col(text)), F.lit(SPACES)), r"[\x20\x09-\x0D]+", -1))
    rows = rows.withColumn(h, F.when(F.col(w)[0] != "", F.transform(w, lambda x: F.xxhash64(x))).otherwise(F.array().cast("array<bigint>")))
    size = F.size(h)
    shifted = [F.slice(h, i + 1, F.greatest(size - (SHINGLE - 1), F.lit(0))) for i in range(SHINGLE)]
    rows = rows.withColumn(s, F.when(size >= SHINGLE, F.transform(
        F.arrays_zip(*[c.alias(f"w{i}") for i, c in enumerate(shifted)]),
        lambda z: F.xxhash64(*[z[f"w{i}"] for i in range(SHINGLE)])))
        .when(size > 0, F.array(F.xxhash64(F.array_join(F.col(h).cast("array<string>"), " "))))
        .otherwise(F.array().cast("array<bigint>")))
    empties = F.array(*[F.lit(((b - BINS // 2) << _SHIFT) + _LAST) for b in range(BINS)])
    rows = rows.withColumn(o, F.when(F.size(s) > 0, F.sort_array(F.concat(s, empties))))
    rows = rows.withColumn(m, F.filter(o, lambda x, i: (i == 0) | (F.shiftright(x, _SHIFT) != F.shiftright(F.get(F.col(o), i - 1), _SHIFT))))
    rows = rows.withColumn(v, F.filter(m, lambda x: x.bitwiseAND(_LAST) != _LAST))

    rows = rows.withColumn(e, F.transform(m, lambda x: F.when(x.bitwiseAND(_LAST) != _LAST, x)))

    def borrowed(b: Column) -> Column:
        tried = [F.get(F.col(e), F.get(F.array(*map(F.lit, t)), b)) for t in _ATTEMPTS]
        rest = F.array_min(F.transform(v, lambda x: F.struct(F.xxhash64(b, F.shiftright(x, _SHIFT)).alias("r"), x.alias("x"))))["x"]
        return F.coalesce(*tried, rest)
    rows = rows.withColumn(d, F.when(F.size(v) > 0, F.transform(e, lambda x, b: F.coalesce(x, borrowed(b)))))
    packed = F.transform(F.sequence(F.lit(0), F.lit(_WORDS - 1)), lambda k: F.aggregate(
        F.slice(F.col(d), k * _PER_WORD + 1, _PER_WORD), F.lit(0).cast("bigint"),
        lambda a, x: F.shiftleft(a, LOW).bitwiseOR(x.bitwiseAND((1 << LOW) - 1))))
    rows = rows.withColumn(name, F.when(F.size(d) == BINS, packed).otherwise(F.array().cast("array<bigint>")))
    return rows.drop(w, h, s, o, m, v, e, d)


def as_text(fingerprint: str) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(one: str, two: str) -> Column:
    """Estimated Jaccard similarity of two fingerprints: agreeing bins, less those that agree by chance.

    Two empty fingerprints are alike (1), an empty and another one are not (0).
    """
    ones = sum(1 << i for i in range(0, 64, LOW))

    def differing(x: Column, y: Column) -> Column:
        bits = x.bitwiseXOR(y)
        pairs = bits.bitwiseOR(F.shiftrightunsigned(bits, 1))
        return F.bit_count(pairs.bitwiseOR(F.shiftrightunsigned(pairs, 2)).bitwiseAND(F.lit(ones)))
    apart = F.aggregate(F.zip_with(one, two, differing), F.lit(0), lambda a, x: a + x)
    chance = 2.0 ** -LOW
    estimate = (1 - apart / BINS - chance) / (1 - chance)
    empty = (F.size(one) == 0).cast("int") + (F.size(two) == 0).cast("int")
    return (F.when(empty == 2, 1.0).when(empty == 1, 0.0)
            .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), estimate))))


def with_next(rows: DataFrame, key: str, order: list[str], columns: dict[str, str]) -> DataFrame:
    """Add columns of the next row by ``key`` (then ``order``); the last row's next is the first.

    Rows are shuffled once, into buckets of neighbouring keys: quantiles cut the key range into ``PIECES``, and
    each piece evenly into buckets. The first row of a bucket is also sent to the bucket before it.
    """
    facts = rows.agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high"),
                     F.percentile_approx(key, [i / PIECES for i in range(1, PIECES)], 10_000).alias("cuts")).first()
    total, low = facts.n, facts.low if facts.n else 0
    cuts = sorted({low, *(facts.cuts or [])})
    spans = [b - a for a, b in zip(cuts, [*cuts[1:], (facts.high if facts.n else 0) + 1])]
    share = max(1.0, total / len(cuts) / BUCKET_ROWS)  # buckets in a piece
    steps = [max(1, int(span / share)) for span in spans]
    lows, widths = F.array(*map(F.lit, cuts)).cast("array<bigint>"), F.array(*[F.lit(float(w)) for w in steps])
    piece = F.size(F.filter(lows, lambda c: c <= F.col(key))) - 1
    far = F.col(key).cast("double") - F.get(lows, F.col("_piece")).cast("double")
    placed = rows.withColumn("_piece", piece).withColumn("_bucket", F.floor(far / F.get(widths, F.col("_piece"))))

    firsts = placed.groupBy("_piece", "_bucket").agg(F.min(key).alias("_first"))
    inner = Window.partitionBy("_piece").orderBy("_bucket")
    firsts = firsts.withColumn("_before", F.lag("_bucket").over(inner))
    # one row for each of the at most PIECES pieces
    pieces = firsts.groupBy("_piece").agg(F.max("_bucket").alias("_end"))
    wrap = F.array_max(F.collect_list(F.struct("_piece", "_end")).over(Window.partitionBy()))
    pieces = pieces.select("_piece", F.coalesce(F.lag(F.struct("_piece", "_end")).over(Window.orderBy("_piece")), wrap).alias("_last"))
    firsts = cut_lineage(firsts.join(F.broadcast(pieces), "_piece").select(
        "_piece", "_bucket", "_first", F.when(F.col("_before").isNotNull(), F.col("_piece")).otherwise(F.col("_last._piece")).alias("_to_piece"),
        F.coalesce("_before", "_last._end").alias("_to_bucket")), "bucket-firsts")

    own = F.struct(F.col("_piece").alias("_p"), F.col("_bucket").alias("_b"), F.lit(0).alias("_copy"))
    sent = F.struct(F.col("_to_piece").alias("_p"), F.col("_to_bucket").alias("_b"), F.lit(1).alias("_copy"))
    dealt = (placed.join(firsts, ["_piece", "_bucket"])
             .withColumn("_to", F.explode(F.when(F.col(key) == F.col("_first"), F.array(own, sent)).otherwise(F.array(own))))
             .select(*rows.columns, "_to.*"))
    along = Window.partitionBy("_p", "_b").orderBy("_copy", key, *order)
    return (dealt.withColumns({new: F.lead(old).over(along) for new, old in columns.items()})
            .where("_copy = 0").select(*rows.columns, *columns))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of the text with its last half replaced from the next document.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.
    Documents follow one another by ``doc_id`` (null first), rows sharing an id by text. A null text is empty;
    a single row is its own next. No rows give no rows.
    """
    rows = with_fingerprint(docs.select(id_key().alias("_did"), "doc_id", text_or_empty().alias("text")), "text", "print")
    rows = with_next(rows, "_did", ["text"], {"next_text": "text", "next_print": "print"})
    half = F.floor(F.char_length("text") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(
        F.substring(F.col("text"), F.lit(1), F.char_length("text") - half), F.substring(F.col("next_text"), F.lit(1), half)))
    rows = with_fingerprint(rows, "edited", "edited_print")
    return rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                       as_text("print").alias("fingerprint"), as_text("edited_print").alias("edited_fingerprint"),
                       likeness("print", "edited_print").alias("near_edited"), likeness("print", "next_print").alias("near_next"))
