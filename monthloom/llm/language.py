"""Language by cross-parsing: whose text does a document repeat in the fewest phrases?

For every language a bounded sample of labelled texts becomes a suffix automaton over bytes. A document is
parsed against it greedily: each phrase is the longest piece that occurs in the sample, the next begins where
it ends. The number of phrases, times the logarithm of the sample's length, over the document's length is an
entropy estimate; the language with the least wins. Automata are dense tables whose missing transitions lead
on from the root with their sign changed, so that many pieces of many documents step through together, one
table lookup per byte and language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from monthloom.llm.common import ship, slices, utf8_view

UNKNOWN = "und"
#: Bound of the training sample, for each language: so many different texts, an excerpt of so many code points from
#: a place anywhere in each, and so many bytes in all.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_BYTES = 200, 400, 50_000
#: Long documents are parsed in pieces of so many bytes at the same time.
PIECE = 1024
SCHEMA = "pred string, score double"


def normal(text: Column) -> Column:
    """Lower case, with every run of characters that are not letters as one space."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")


def is_training(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 != 2


def suffix_automaton(text: np.ndarray, symbols: int) -> np.ndarray:
    """Transitions of the suffix automaton of ``text`` (numbers below ``symbols``): states x symbols.

    State 0 is the root. A missing transition holds ``-1 - s`` where s is where the root goes on that symbol, or
    the last state, from which every symbol begins a phrase.
    """
    n = 2 * max(1, len(text))
    go = np.empty((n, symbols), np.int32)  # rows are filled as states arise; the rest takes no memory
    go[0] = -1
    link, length = [-1] * n, [0] * n
    size, last = 1, 0
    for c in text.tolist():
        new, size = size, size + 1
        go[new] = -1
        length[new] = length[last] + 1
        p = last
        while p != -1 and go[p, c] == -1:
            go[p, c] = new
            p = link[p]
        if p == -1:
            link[new] = 0
        else:
            q = int(go[p, c])
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone, size = size, size + 1
                length[clone] = length[p] + 1
                go[clone] = go[q]
                link[clone] = link[q]
                while p != -1 and go[p, c] == q:
                    go[p, c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    root = np.where(go[0] == -1, size, go[0]).astype(np.int32)
    table = np.empty((size + 1, symbols), np.int32)
    table[:size], table[size] = go[:size], -1 - root
    for rows in np.array_split(table[:size], max(1, size >> 12)):  # in place, without copies of the whole
        np.copyto(rows, -1 - root, where=rows == -1)
    return table


class Model:
    """Languages with their automata in one table."""

    def __init__(self, samples: dict[str, bytes]):
        self.languages = sorted(samples)
        seen = sorted(set(b"".join(samples.values())))
        self.classes = np.zeros(256, np.int32)  # 0: a byte no sample holds
        self.classes[seen] = np.arange(1, len(seen) + 1)
        width, tables, last, at = len(seen) + 1, [], [], 0
        # places in the flattened table of all languages; an automaton has two states a byte, one more and the last
        places = sum(2 * max(1, len(text)) + 2 for text in samples.values()) * width
        kind = np.int32 if places < 1 << 31 else np.int64
        for name in self.languages:
            table = suffix_automaton(self.classes[np.frombuffer(samples[name], np.uint8)], width)
            table = table.astype(kind, copy=False)
            # entries become places; a negative one begins a phrase
            for rows in np.array_split(table, max(1, len(table) >> 12)):
                fresh = rows < 0
                rows += np.where(fresh, -at, at).astype(kind)
                rows *= kind(width)
                rows += np.where(fresh, width - 1, 0).astype(kind)
            at += len(table)
            last.append(at - 1)
            tables.append(table.ravel())
        self.table = np.concatenate(tables) if tables else np.zeros(1, np.int32)
        self.begin = np.array(last, kind) * kind(width)
        self.logs = np.log(np.array([max(2, len(samples[name])) for name in self.languages]))

    def _step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after a symbol, and where it began a phrase."""
        here = self.table[state + symbol]
        fresh = here < 0
        return np.where(fresh, -1 - here, here), fresh

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrase counts of the greedy parse of each text, texts x languages."""
        sizes = np.diff(offsets)
        pieces = -(-sizes // PIECE)
        owner = np.repeat(np.arange(len(sizes)), pieces)
        begin = np.repeat(offsets[:-1], pieces) + (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * PIECE
        size = np.minimum(PIECE, offsets[1:][owner] - begin)
        symbols = self.classes[data]
        order = np.argsort(-size, kind="stable")  # the pieces still running come first at every step
        counts = np.zeros((len(self.begin), len(owner)), np.int64)
        state = np.repeat(self.begin[:, None], len(owner), axis=1)
        first = begin[order]
        running = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), side="left")
        for step, alive in enumerate(running.tolist()):
            state[:, :alive], fresh = self._step(state[:, :alive], symbols[first[:alive] + step])
            counts[:, :alive] += fresh
        back = np.argsort(order)
        counts, state = counts[:, back], state[:, back]
        self._carry(counts, state, owner, begin, size, symbols)
        out = np.zeros((len(sizes), len(self.begin)))
        for row, c in zip(out.T, counts):
            row += np.bincount(owner, c, len(sizes))
        return out

    def _carry(self, counts: np.ndarray, end: np.ndarray, owner: np.ndarray, begin: np.ndarray, size: np.ndarray,
               symbols: np.ndarray) -> None:
        """Turn counts and end states of pieces entered afresh into those of pieces entered where the last one ended.

        Both ways through a piece are followed together and left where they meet, mostly after a few symbols. A piece
        that they leave apart changes how the next is entered, so that one is followed again.
        """
        entered = np.repeat(self.begin[:, None], len(owner), axis=1)
        after = np.flatnonzero(owner[1:] == owner[:-1]) + 1  # pieces that are not the first of their text
        lang, piece = (x.ravel() for x in np.meshgrid(np.arange(len(self.begin)), after, indexing="ij"))
        while len(piece):
            old, new = entered[lang, piece], end[lang, piece - 1]
            entered[lang, piece] = new
            change, moved = np.zeros(len(piece), np.int64), []
            at, step = np.flatnonzero(old != new), 0
            old, new = old[at], new[at]
            while len(at):
                symbol = symbols[begin[piece[at]] + step]
                (old, was), (new, now) = self._step(old, symbol), self._step(new, symbol)
                change[at] += now.astype(np.int64) - was
                step += 1
                apart, done = old != new, size[piece[at]] == step
                moved.append((at[apart & done], new[apart & done]))
                on = apart & ~done
                at, old, new = at[on], old[on], new[on]
            counts[lang, piece] += change
            for which, state in moved:
                end[lang[which], piece[which]] = state
            which = np.concatenate([w for w, _ in moved]) if moved else np.zeros(0, np.int64)
            lang, piece = lang[which], piece[which] + 1
            last = np.r_[owner[1:] != owner[:-1], True]
            on = ~last[piece - 1]
            lang, piece = lang[on], piece[on]

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language of least entropy, and its share when entropies are weighed as 2^(-8 h / least)."""
        entropy = self.phrases(data, offsets) * self.logs / np.maximum(1, np.diff(offsets))[:, None]
        best = entropy.argmin(axis=1)
        least = np.maximum(entropy.min(axis=1, keepdims=True), 1e-12)
        weight = np.exp2(-8 * (entropy / least - 1))
        return best, weight.max(axis=1) / weight.sum(axis=1)


def training_sample(docs: DataFrame) -> dict[str, bytes]:
    """Excerpts of at most ``SAMPLE_DOCS`` different labelled texts a language, ``SAMPLE_BYTES`` in all.

    Every part of every labelled text can be drawn: texts come in the order of a hash, however often they are
    repeated, and the hash also says where in the text its excerpt lies. So the sample depends on the labelled
    texts alone. Hashes are counted before they are ranked; texts are read again for the chosen hashes only.
    """
    rows = (docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & is_training(F.col("doc_id")))
            .select("lang", F.xxhash64("text").alias("h"), "text"))
    chosen = (rows.groupBy("lang", "h").agg(F.lit(1).alias("one"))
              .withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
              .where(F.col("place") <= SAMPLE_DOCS).select("lang", "h", "place"))
    # few rows for each language, whatever the number of documents
    found = rows.join(F.broadcast(chosen), ["lang", "h"])
    spare = F.greatest(F.lit(0), F.length("text") - 2 * SAMPLE_CHARS)  # twice as much, as normalising shortens
    start = F.pmod("h", spare + 1).cast("int") + 1
    drawn = (found.select("lang", "place", F.substring(F.col("text"), start, F.lit(2 * SAMPLE_CHARS)).alias("text"))
             .groupBy("lang", "place").agg(F.min("text").alias("text"))
             .select("lang", "place", F.substring(normal(F.col("text")), 1, SAMPLE_CHARS).alias("text")))
    parts: dict[str, list[str]] = {}
    for lang, _, text in sorted(drawn.collect()):
        parts.setdefault(lang, []).append(text)
    joined = {lang: " ".join(t).encode()[:SAMPLE_BYTES] for lang, t in parts.items()}
    return {lang: text for lang, text in joined.items() if text.strip()}


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, "_normal", 1 << 23):
                best, score = model.predict(*utf8_view(part.column("_normal")))
                names = np.array(model.languages, dtype=object)[best]
                rest = [part.column(c) for c in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(names, pa.string()), pa.array(score)],
                                                 [*part.schema.names[:-1], "_pred", "_score"])
    return run


def identify(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",),
             names: tuple[str, str, str] = ("held_out", "lang_pred", "score")) -> DataFrame:
    """``keep`` columns of every row with ``held_out``, ``lang_pred`` and ``score``, or as ``names`` calls them
    where a kept column has such a name.

    Learns from text and label of the rows whose ``crc32(doc_id) % 4`` is not 2 (a null id, text or label
    never teaches). A null text, one without a letter, or no labelled text at all: ``und`` with score 0.
    Equal entropies go to the first language by code point. ``held_out`` is false for a null id.
    """
    ship(docs.sparkSession)
    model = Model(training_sample(docs))
    base = docs.select(*keep, F.coalesce(~is_training(F.col("doc_id")), F.lit(False)).alias("_held"),
                       F.coalesce(F.rlike("text", F.lit(r"\p{L}")), F.lit(False)).alias("_letters"),
                       F.coalesce(normal(F.col("text")), F.lit("")).alias("_normal"))
    if not model.languages:
        return base.select(*keep, F.col("_held").alias(names[0]), F.lit(UNKNOWN).alias(names[1]), F.lit(0.0).alias(names[2]))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:-1])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by the sample
    found = base.mapInArrow(_predict(shared), f"{fields}, _pred string, _score double")
    return found.select(*keep, F.col("_held").alias(names[0]),
                        F.when(F.col("_letters"), F.col("_pred")).otherwise(UNKNOWN).alias(names[1]),
                        F.when(F.col("_letters"), F.col("_score")).otherwise(0.0).alias(names[2]))
