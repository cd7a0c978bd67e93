"""Spelling variants by a bit-sliced position index.

The vocabulary (words of enough length and occurrences) is posted under the halves of its words: two words one
edit apart share the first or the last half, counted by the shorter one's length. Words of a posting key form a
block whose index holds a bitset over the block for each (position, letter). All words of one length are looked
up together: word-parallel recurrences carry the set of words equal so far, the set with one replaced letter, and,
read at shifted positions, the set with one letter more. A pair sharing both halves is taken from the first only.
Results are counts and best neighbours per word, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthloom.llm.common import LOWER, UPPER, frugal, ship
from monthloom.sources.store import cut_lineage

RUN = "([A-Za-z\\u00C0-\\u00FF]+)"
#: Words of a block's index, and the letters (words times length) it may hold.
BLOCK, BLOCK_LETTERS = 4096, 1 << 16
#: Words looked up together.
LOOKUPS = 256


def slips(doc_id: Column, word: Column, every: int) -> Column:
    """``word`` without one code point where ``every`` divides the checksum of document and word.

    A null id reads as an empty one.
    """
    h = F.crc32(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), word))
    at = (h % F.char_length(word)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))
                  ).otherwise(word)


def vocabulary(docs: DataFrame, least_letters: int = 5, least_count: int = 3, every: int = 97) -> DataFrame:
    """``word, n``: distinct words of all texts after the planted slips, long and frequent enough."""
    runs = (docs.select("doc_id", F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), 1)).alias("run")))
    return (runs.select(slips(F.col("doc_id"), F.col("run"), every).alias("word"))
            .where(F.char_length("word") >= least_letters)
            .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count))


def postings(words: DataFrame) -> DataFrame:
    """``m, side, half, word, n, longer`` for the keys a word of length L meets others under: as the shorter or an
    equal one (m = L) and as the longer one (m = L - 1)."""
    cells = [F.struct((F.col("size") - longer).alias("m"), F.lit(side).alias("side"),
                      (F.expr(f"left(word, (size - {longer}) div 2)") if side == 0
                       else F.expr(f"right(word, size - {longer} - (size - {longer}) div 2)")).alias("half"),
                      F.lit(bool(longer)).alias("longer")) for longer in (0, 1) for side in (0, 1)]
    return (words.withColumn("size", F.char_length("word")).select("word", "n", F.explode(F.array(*cells)).alias("p"))
            .select("p.*", "word", "n"))


class Index:
    """A block's words of m or m + 1 letters as bitsets over the block, one for each (position, letter)."""

    def __init__(self, words: list[str], m: int):
        letters = np.array([[ord(c) for c in w.ljust(m + 1, "\0")] for w in words], np.int32).reshape(len(words), m + 1)
        self.m, self.size, self.width = m, len(words), (len(words) + 63) // 64
        self.alphabet = np.unique(letters)
        ids = np.searchsorted(self.alphabet, letters)
        flags = np.zeros((m + 1, len(self.alphabet) + 1, self.width * 64), bool)
        for at in range(m + 1):
            flags[at, ids[:, at], np.arange(len(words))] = True
        self.bits = self._packed(flags)
        longer = letters[:, m] != 0
        self.all = self._packed(self._filled(np.ones(len(words), bool)))
        self.longer, self.equal = self._packed(self._filled(longer)), self._packed(self._filled(~longer))

    def _filled(self, flags: np.ndarray) -> np.ndarray:
        return np.r_[flags, np.zeros(self.width * 64 - len(flags), bool)]

    @staticmethod
    def _packed(flags: np.ndarray) -> np.ndarray:
        return np.packbits(flags, axis=-1, bitorder="little").view(np.uint64)

    def near(self, words: list[str], second_half: bool) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``words`` (all of m letters) and in the index of the pairs exactly one edit apart; in second-half
        blocks without those that share the first half as well."""
        codes = np.array([[ord(c) for c in w] for w in words], np.int32).reshape(len(words), self.m)
        ids = np.searchsorted(self.alphabet, codes)
        known = self.alphabet[np.minimum(ids, len(self.alphabet) - 1)] == codes
        ids[~known] = len(self.alphabet)  # a letter no word holds: an empty bitset
        same = np.repeat(self.all[None], len(words), axis=0)
        replaced, more, skip = np.zeros_like(same), same.copy(), same
        for at in range(self.m):
            here, shifted = self.bits[at][ids[:, at]], self.bits[at + 1][ids[:, at]]
            replaced = (replaced & here) | (same & ~here)
            same = same & here
            more = (more & shifted) | same
            if at + 1 == self.m // 2:
                skip = same
        found = (replaced & self.equal) | (more & self.longer)
        if second_half:
            found &= ~skip
        row, word = np.nonzero(found)
        bits = np.unpackbits(found[row, word][:, None].view(np.uint8), axis=1, bitorder="little")
        which, bit = np.nonzero(bits)
        return row[which], word[which] * 64 + bit


def _best(target: list[str], other: list[str], n: list[int]) -> pa.RecordBatch:
    """Per target: how many others, and the best of them (most frequent, then smallest)."""
    found: dict[str, list] = {}
    for t, o, k in zip(target, other, n):
        have = found.get(t)
        if have is None:
            found[t] = [1, -k, o]
        else:
            have[0] += 1
            if (-k, o) < (have[1], have[2]):
                have[1:] = -k, o
    columns = list(zip(*((t, *v) for t, v in found.items()))) or [[], [], [], []]
    types = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["word", "near", "minus_n", "other"])


def _look_up(m: int, side: list[int], half: list[str], words: list[str], counts: list[int], longer: list[bool],
             indexed: list[bool], asking: list[bool]) -> pa.RecordBatch:
    """Neighbours within one packed block: several keys of one m share an index, and only pairs of one key count."""
    place = np.flatnonzero(indexed)
    key = {k: i for i, k in enumerate(dict.fromkeys(zip(side, half)))}
    group = np.array([key[k] for k in zip(side, half)])
    index = Index([words[i] for i in place.tolist()], m)
    target, other, n = [], [], []
    for second in (0, 1):
        ask = np.flatnonzero(np.array(asking) & (np.array(side) == second))
        for at in range(0, len(ask), LOOKUPS):
            mine = ask[at:at + LOOKUPS]
            a, b = index.near([words[i] for i in mine.tolist()], bool(second))
            a, b = mine[a], place[b]
            keep = group[a] == group[b]
            for i, j in zip(a[keep].tolist(), b[keep].tolist()):
                target.append(words[i])
                other.append(words[j])
                n.append(counts[j])
                if longer[j]:
                    target.append(words[j])
                    other.append(words[i])
                    n.append(counts[i])
    return _best(target, other, n)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pack whole keys of one m into blocks, from rows sorted by m, key, part and indexed words first.

    Parts of a split key are blocks of their own: their index stays while the key's other words pass through it.
    """
    names = ("side", "half", "word", "n", "longer", "indexed")
    held: list[list] = [[] for _ in (*names, "asking")]
    now = (None, None, None, 0)

    def flush(keep_index: bool = False) -> pa.RecordBatch:
        done = [list(c) for c in held]
        for c, values in zip(held, done):
            c[:] = [v for v, i in zip(values, done[5]) if i] if keep_index else []
        held[6][:] = [False] * len(held[6])
        return _look_up(now[0], *done)
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in names]
        columns.append([not v for v in columns[4]])
        keys = zip(batch.column("m").to_pylist(), columns[0], columns[1], batch.column("part").to_pylist())
        for row, key in zip(zip(*columns), keys):
            full = len(held[0]) >= BLOCK or len(held[0]) * ((now[0] or 0) + 1) >= BLOCK_LETTERS
            if key == now:
                if now[3] and not row[5] and len(held[0]) >= 3 * BLOCK:
                    yield flush(keep_index=True)
            elif held[0] and (full or key[0] != now[0] or key[3] or now[3]):
                yield flush()
            now = key
            for c, value in zip(held, row):
                c.append(value)
    if held[0]:
        yield flush()


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, best_n, best`` of the words (``word, n``, distinct) that have a word one edit away.

    A key with more words than a block is split: each part indexes its share of them, and all the key's shorter
    words are looked up in every part, so each pair is met once.
    """
    posted = postings(words)
    keys = ["m", "side", "half"]
    size_of_block = F.greatest(F.lit(64), F.least(F.lit(BLOCK), F.expr(f"CAST({BLOCK_LETTERS} div (m + 1) AS INT)")))
    met = (posted.groupBy(*keys).agg(F.count("*").alias("words"), F.count_if(~F.col("longer")).alias("short"))
           .where("words > 1 AND short > 0")
           .select(*keys, F.ceil(F.col("words") / size_of_block).cast("int").alias("parts")))
    rows = posted.join(met, keys).withColumn("own", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    parts = F.when(F.col("longer") | (F.col("parts") == 1), F.array("own")).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = (rows.withColumn("part", F.explode(parts))
             .select(*keys, F.when(F.col("parts") > 1, F.col("part") + 1).otherwise(0).alias("part"), "word", "n", "longer",
                     (F.col("part") == F.col("own")).alias("indexed")))
    found = (dealt.repartition(*keys, "part").sortWithinPartitions(*keys, "part", F.desc("indexed"))
             .mapInArrow(frugal(_blocks), "word string, near long, minus_n long, other string"))
    return (found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct("minus_n", "other")).alias("best"))
            .select("word", "n_near", (-F.col("best.minus_n")).alias("best_n"), F.col("best.other").alias("best")))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for every word with a form (``word, form``): the form's form and so on, to the last.

    Each step doubles the distance gone. A form occurs at least twice as often as its word, so chains are shorter
    than the logarithm of the largest count and cannot run in circles.
    """
    current = cut_lineage(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = current.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                            F.col("next").isNotNull().alias("moved"))
        current = cut_lineage(moved, "spelling-roots")
        if current.where("moved").isEmpty():
            return current.drop("moved")
        current = current.drop("moved")


def variants(docs: DataFrame, least_letters: int = 5, least_count: int = 3, every: int = 97, times: int = 2) -> DataFrame:
    """Per vocabulary word: ``word, form, root, n, n_near, form_n``.

    Words are maximal runs of ASCII and Latin-1 letters (by the code points U+00C0 to U+00FF) with A-Z lower-cased.
    A null or empty text has none; repeated rows and rows sharing an id all count; a null id reads as an
    empty one where slips are drawn. The form is the near word of largest ``n``, ties to the smallest in code-point
    order, if it has ``times`` as many occurrences. No words: an empty table. Only ``doc_id`` and ``text`` are read.
    """
    ship(docs.sparkSession)
    words = cut_lineage(vocabulary(docs.select("doc_id", "text"), least_letters, least_count, every), "spelling-words")
    near = near_words(words)
    good = F.col("best_n") >= times * F.col("n")
    placed = cut_lineage(
        words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                                                F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n")),
        "spelling-forms")
    ends = roots(placed.where("form IS NOT NULL").select("word", "form"))
    return (placed.join(ends, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
