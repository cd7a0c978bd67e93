"""Lines repeated across documents, found by one sort of their hashes.

Hashes of the lines' keys are range-partitioned together with the document id and sorted by key, document
(largest first) and position. Each partition is then read as a stream that meets the first occurrence of a
key before all others, so a key's verdict needs no more memory than the rows of its first ``min_docs - 1``
documents. A very frequent line spans several partitions; only the first and last key of a partition can do
so, and these are settled from one summary row per partition. What comes out is a compressed bitmap of the
lines to keep for each document that loses any; texts stay where they are until the bitmaps are applied.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from monthloom.llm.common import LOWER, SPACES, UPPER, id_key, ship, text_or_empty
from monthloom.sources.store import cut_lineage

DROP, EDGE, SUMMARY = 0, 1, 2
_JUDGED = "kind byte, h1 long, h2 long, did long, th long, pos int, n long"


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row per line long enough to be compared: 128 bits of its key, document, text hash and position."""
    return (docs.select(id_key().alias("did"), F.xxhash64(text_or_empty()).alias("th"),
                        F.posexplode(F.split(text_or_empty(), "\n", -1)).alias("pos", "line"))
            .withColumn("line", F.btrim("line", F.lit(SPACES)))
            .where(F.char_length("line") >= min_chars)
            .withColumn("line", F.translate("line", UPPER, LOWER))
            .select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"), "did", "th", "pos"))


class _Stream:
    """Judges sorted rows of one partition; holds the undecided rows of one key."""

    def __init__(self, min_docs: int):
        self.min_docs, self.key, self.out = min_docs, None, []
        self.is_first = True

    def emit(self, kind: int, did, th, pos, n: int = 0) -> None:
        h1, h2 = self.key
        self.out.append((np.full(len(did), kind, np.int8), np.full(len(did), h1), np.full(len(did), h2), did, th, pos,
                         np.full(len(did), n, np.int64)))

    def open(self, key: tuple, largest) -> None:
        self.is_first = self.key is None
        self.key, self.largest, self.last, self.docs, self.held = key, largest, None, 0, []

    def feed(self, did, th, pos) -> None:
        changes = int((did[1:] != did[:-1]).sum()) + int(self.last is None or did[0] != self.last)
        self.docs, self.last = self.docs + changes, did[-1]
        if self.is_first:
            self.emit(EDGE, did, th, pos)
            return
        later = did != self.largest
        rows = (did[later], th[later], pos[later])
        if self.docs >= self.min_docs:
            for held in (*self.held, rows):
                self.emit(DROP, *held)
            self.held = []
        else:
            self.held.append(rows)

    def summary(self) -> None:
        self.emit(SUMMARY, np.array([self.largest]), np.zeros(1, np.int64), np.zeros(1, np.int32), self.docs)

    def close(self) -> None:
        if self.key is not None and self.is_first:
            self.summary()

    def end(self) -> None:
        if self.key is not None:
            self.summary()
            if not self.is_first:
                for held in self.held:
                    self.emit(EDGE, *held)

    def flush(self) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*self.out)]
        self.out = []
        kinds = [pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                          ["kind", "h1", "h2", "did", "th", "pos", "n"])


def _judge(min_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Stream(min_docs)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            h1, h2, did, th, pos = (batch.column(c).to_numpy() for c in ("h1", "h2", "did", "th", "pos"))
            starts = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
            ends = np.r_[starts[1:], len(h1)]
            worth = ends - starts > 1  # a key of one row matters only where it may go on in another batch
            worth[0] = worth[-1] = True
            for s, e in zip(starts[worth].tolist(), ends[worth].tolist()):
                key = (h1[s], h2[s])
                if key != state.key:
                    state.close()
                    state.open(key, did[s])
                state.feed(did[s:e], th[s:e], pos[s:e])
            if state.out:
                yield state.flush()
        state.end()
        if state.out:
            yield state.flush()
    return run


@F.pandas_udf(T.BinaryType())
def pack_keep(dropped: pd.Series) -> pd.Series:
    """Bit i (most significant first) tells whether line i stays; lines past the end stay. Deflated."""
    def pack(positions):
        bits = np.ones((int(max(positions)) // 8 + 1) * 8, np.uint8)
        bits[np.asarray(positions)] = 0
        return zlib.compress(np.packbits(bits).tobytes(), 6)
    return dropped.map(pack)


def keep_bits(packed: bytes, n_lines: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8))[:n_lines].astype(bool)
    return np.r_[bits, np.ones(n_lines - len(bits), bool)]


@F.pandas_udf(T.StructType().add("text", T.StringType()).add("dropped", T.LongType()))
def _kept(text: pd.Series, keep: pd.Series) -> pd.DataFrame:
    texts, dropped = [], []
    for t, k in zip(text, keep):
        if t is None or k is None:
            texts.append(None)
            dropped.append(None)
            continue
        lines = t.split("\n")
        bits = keep_bits(bytes(k), len(lines))
        texts.append("\n".join(line for line, stays in zip(lines, bits) if stays))
        dropped.append(int((~bits).sum()))
    return pd.DataFrame({"text": pd.Series(texts, dtype=object), "dropped": pd.Series(dropped, dtype="Int64")})


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``did, th, keep``: packed keep bitmaps of the documents that lose lines.

    A line's key (stripped, A-Z lower-cased) of at least ``min_chars`` code points that occurs in at least
    ``min_docs`` documents stays only in the largest ``doc_id`` holding it. ``did`` is the id with null as
    the smallest, ``th`` the hash of the whole text: rows sharing an id but not a text have bitmaps of their
    own, repeated rows share one. Null and empty texts have one empty line, which always stays.
    """
    ship(docs.sparkSession)
    keys = cut_lineage(line_keys(docs, min_chars), "line-keys")
    judged = cut_lineage(
        keys.repartitionByRange(F.col("h1"), F.col("h2"), F.col("did").desc())
        .sortWithinPartitions("h1", "h2", F.col("did").desc(), "th", "pos")
        .mapInArrow(_judge(min_docs), _JUDGED), "line-verdicts")
    settled = (judged.where(F.col("kind") == SUMMARY).groupBy("h1", "h2")
               .agg(F.sum("n").alias("n_docs"), F.max("did").alias("largest"))
               .where(F.col("n_docs") >= min_docs))
    # two keys for each partition of the sort at most; the planner broadcasts them if they are few
    edges = (judged.where(F.col("kind") == EDGE).join(settled, ["h1", "h2"])
             .where("did != largest").select("did", "th", "pos"))
    dropped = judged.where(F.col("kind") == DROP).select("did", "th", "pos").unionByName(edges)
    return (dropped.groupBy("did", "th").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))
            .select("did", "th", pack_keep("dropped").alias("keep")))


def drop_repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with ``text`` reduced to the lines that stay, ``n_lines`` before and ``n_dropped``.

    Other columns pass through (a clashing ``n_lines`` or ``n_dropped`` is replaced). A null text without
    dropped lines stays null. An empty table gives an empty table.
    """
    bitmaps = keep_bitmaps(docs, min_chars, min_docs).withColumnsRenamed({"did": "_did", "th": "_th", "keep": "_keep"})
    joined = (docs.withColumns({"_did": id_key(), "_th": F.xxhash64(text_or_empty())})
              .join(bitmaps, ["_did", "_th"], "left")
              .withColumn("_new", _kept(F.when(F.col("_keep").isNotNull(), F.col("text")), F.col("_keep"))))
    columns = {"text": F.coalesce("_new.text", "text"),
               "n_lines": F.size(F.split(text_or_empty(), "\n", -1)).cast("long"),
               "n_dropped": F.coalesce("_new.dropped", F.lit(0)).cast("long")}
    rest = [c for c in docs.columns if c not in columns]
    return joined.select(*rest, *[c.alias(n) for n, c in columns.items()])
