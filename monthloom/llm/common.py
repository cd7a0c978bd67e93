"""Small helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words and are stripped from lines: ``[\x20\x09-\x0D]``.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for a null ``doc_id`` in sort and join keys: smaller than every other id.
NULL_ID = -(1 << 63)


def ship(spark: SparkSession) -> None:
    """Let the executors' Python import this package, wherever the session was started."""
    context = spark.sparkContext
    if getattr(context, "_monthloom_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="monthloom-"), "monthloom.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    context._monthloom_shipped = True


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def id_key(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column), F.lit(NULL_ID)).cast("long")


def word_count(column: str = "text") -> Column:
    return F.regexp_count(text_or_empty(column), F.lit(WORD)).cast("long")


def utf8_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column, without copying; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0]:ends[-1]], ends - ends[0]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges ``starts[i] … starts[i] + lengths[i] - 1``."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 22):
    """Pieces of a batch with about ``most`` bytes of ``column`` each, at least one row."""
    _, offsets = utf8_view(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def give_back() -> None:
    """Return freed memory of this Python worker to the system. Workers outlive their tasks and stages, so what
    one stage has freed would still count against the executor in the next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim:
        trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for ``mapInArrow``, giving freed memory back when the task ends."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()
    return task


class WordPool:
    """Ids of words seen before, so that each is encoded once. When there are too many, words met only once go.

    The usual bounds keep a pool within about 30 MB; a Python worker keeps its pool from task to task.
    """

    def __init__(self, encode, most_words: int = 250_000, most_ids: int = 2_000_000):
        self.encode, self.most_words, self.most_ids = encode, most_words, most_ids
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, tuple[pa.Array, np.ndarray]] = {}  # by what leads them: words and their slots
        self.sizes, self.flat, self.met = array("q"), array("i"), np.zeros(0, np.uint8)

    def shrink(self) -> None:
        old, sizes, met, flat = self.known, np.array(self.sizes), self.met, np.array(self.flat)
        starts = np.cumsum(sizes) - sizes
        self.clear()
        if (met > 1).sum() > self.most_words // 2:
            return
        at, kept = 0, []
        for lead, (words, slots) in old.items():
            often = met[slots] > 1
            kept.append(slots[often])
            self.known[lead] = words.filter(pa.array(often)), np.arange(at, at + len(kept[-1]))
            at += len(kept[-1])
        slots = np.concatenate(kept)
        self.sizes.frombytes(sizes[slots].tobytes())
        self.flat.frombytes(flat[ragged(starts[slots], sizes[slots])].tobytes())
        self.met = np.ones(len(slots), np.uint8)

    def slots(self, words: pa.Array, lead: str) -> np.ndarray:
        """Slots of distinct words; those not met before are encoded."""
        known, slots = self.known.get(lead, (words.slice(0, 0), np.zeros(0, np.int64)))
        at = pc.index_in(words, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
        fresh = at < 0
        found = np.empty(len(words), np.int64)
        found[~fresh] = slots[at[~fresh]]
        if fresh.any():
            new = words.filter(pa.array(fresh))
            encode, base = self.encode, len(self.sizes)
            lists = [encode(lead + w) for w in new.to_pylist()]
            self.sizes.extend(map(len, lists))
            self.flat.extend(chain.from_iterable(lists))
            self.met = np.r_[self.met, np.zeros(len(new), np.uint8)]
            found[fresh] = np.arange(base, base + len(new))
            self.known[lead] = pa.concat_arrays([known, new]), np.r_[slots, found[fresh]]
        self.met[found] = np.minimum(self.met[found], 8) + 1
        return found

    def ids_of_texts(self, texts: pa.Array, split_is_safe, whole, lead: str, lead_first: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the bounds of each text's.

        Texts are cut before every space. ``split_is_safe(words, codes, bounds)`` tells which texts may be
        encoded word by word in that cut; another goes through ``whole(text)``. A word is encoded with ``lead``
        in front, a text's first one only if ``lead_first``.
        """
        if len(self.sizes) > self.most_words or len(self.flat) > self.most_ids:
            self.shrink()
        split = pc.split_pattern(texts.fill_null(""), " ")
        bounds = split.offsets.to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        words, codes = coded.dictionary, coded.indices.to_numpy()
        safe = split_is_safe(words, codes, bounds)
        by_words = safe & (np.diff(utf8_view(texts)[1]) > 0)
        used = np.repeat(by_words, np.diff(bounds))
        led = used.copy()
        firsts = bounds[:-1][by_words]
        if not lead_first:
            led[firsts] = False
        needed = np.zeros(len(words), bool)
        needed[codes[led]] = True
        slot_of = np.zeros(len(words), np.int64)
        slot_of[needed] = self.slots(words.filter(pa.array(needed)), lead)
        slots = slot_of[codes]
        if not lead_first:
            heads, which = np.unique(codes[firsts], return_inverse=True)
            slots[firsts] = self.slots(words.take(pa.array(heads)), "")[which]
        others = [(i, whole(texts[i].as_py() or "")) for i in np.flatnonzero(~safe).tolist()]
        return self._gather(slots, bounds, used, others)

    def _gather(self, slots, bounds, used, others):
        sizes = np.r_[np.array(self.sizes, np.int64), 0]
        starts = np.cumsum(sizes) - sizes
        lengths = np.where(used, sizes[slots], 0)
        ids = np.array(self.flat, np.int32)[ragged(starts[slots], lengths)]
        ends = np.r_[0, np.cumsum(lengths)][bounds]
        if not others:
            return ids, ends
        counts = np.diff(ends)
        parts, at = [], 0
        for i, own in others:
            parts += [ids[at:ends[i]], np.array(own, np.int32)]
            at = ends[i]
            counts[i] = len(own)
        return np.concatenate([*parts, ids[at:]]), np.r_[0, np.cumsum(counts)]
