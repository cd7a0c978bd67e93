"""SentencePiece BPE encoding and decoding by a table of each prefix's last token.

In a merge-type vocabulary the encoding of every prefix of a text ends in one definite token: of the pieces
that end there, the only one compatible with the last token of the prefix before it. An Aho-Corasick automaton
lists the pieces ending at each place, longest first; the compatibility of two neighbours is decided by
replaying only the merges along their common border. The ids are then read backwards through the table.
Since no piece has the space mark after another character, a text falls into words that are encoded
independently, and each distinct word once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthloom.llm.common import WordPool, frugal, ship, slices

MARK = "▁"
NEVER = 1 << 62
#: Remembered answers about neighbouring tokens, about 100 bytes each; bytes of text encoded at once.
MOST_PAIRS, SLICE = 250_000, 1 << 20


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


class PieceModel:
    """Pieces, merge ranks and border histories of a SentencePiece BPE model with byte fallback."""

    def __init__(self, proto: bytes):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        size = sp.get_piece_size()
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) for i in range(size)]
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        if any(MARK in p.lstrip(MARK) for p, s in zip(self.pieces, special) if not s):
            raise ValueError("pieces with a space mark inside are not supported")
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.special = np.array(special)
        self.rank = {p: int(-sp.get_score(i)) for i, p in enumerate(self.pieces) if not special[i]}
        self.right: dict[int, list] = {}
        self.left: dict[int, list] = {}
        self.length = [len(p) for p in self.pieces]
        self.known = {p for p in self.rank if len(p) == 1}
        self.unknown = re.compile("([^" + re.escape("".join(sorted(self.known))) + "])")
        self.automaton = ahocorasick.Automaton()
        for i, p in enumerate(self.pieces):
            if not special[i] and self._histories(i, p):
                self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.compatible: dict[int, bool] = {}
        self.bytes = [b"" if s else p.replace(MARK, " ").encode() for p, s in zip(self.pieces, special)]
        self.sizes = np.array([len(b) for b in self.bytes])

    def _histories(self, token: int, piece: str) -> bool:
        """Merge the piece by itself, noting its outermost symbols and when each was merged; False if it
        does not come back whole."""
        symbols, right, left = list(piece), [], []
        if any(c not in self.known for c in symbols):
            return False
        first, last = symbols[0], symbols[-1]
        while len(symbols) > 1:
            at = min(range(len(symbols) - 1), key=lambda k: self.rank.get(symbols[k] + symbols[k + 1], NEVER))
            rank = self.rank.get(symbols[at] + symbols[at + 1], NEVER)
            if rank == NEVER:
                return False
            if at == 0:
                left.append((first, rank))
            if at == len(symbols) - 2:
                right.append((last, rank))
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
            first, last = symbols[0], symbols[-1]
        self.right[token], self.left[token] = [*right, (piece, NEVER)], [*left, (piece, NEVER)]
        return True

    def fits(self, one: int, two: int) -> bool:
        """Whether the border between two tokens survives merging their joined text."""
        key = one * len(self.pieces) + two
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) > MOST_PAIRS:
                self.compatible.clear()
            known = self.compatible[key] = self._fits(one, two)
        return known

    def _fits(self, one: int, two: int) -> bool:
        right, left, i, j = self.right[one], self.left[two], 0, 0
        while True:
            (a, a_next), (b, b_next) = right[i], left[j]
            across = self.rank.get(a + b, NEVER)
            # of equal ranks the leftmost goes first: inside the left token, across, inside the right one
            if across < a_next and across <= b_next and across != NEVER:
                return False
            if a_next == b_next == NEVER:
                return True
            if a_next <= b_next:
                i += 1
            else:
                j += 1

    def _known_ids(self, text: str) -> list[int]:
        last: list[int | None] = [None] * (len(text) + 1)
        length, fits = self.length, self.fits
        for end, token in self.automaton.iter(text):
            if last[end + 1] is None:
                start = end + 1 - length[token]
                if start == 0 or fits(last[start], token):
                    last[end + 1] = token
        ids, at = [], len(text)
        while at:
            ids.append(last[at])
            at -= length[last[at]]
        ids.reverse()
        return ids

    def marked_ids(self, text: str) -> list[int]:
        """Ids of a text whose spaces are marks already; characters without a piece become bytes."""
        if self.known.issuperset(text):
            return self._known_ids(text)
        ids = []
        for part in self.unknown.split(text):
            if part and (len(part) > 1 or part in self.known):
                ids += self._known_ids(part)
            else:
                ids += [self.byte[b] for b in part.encode()]
        return ids

    def whole_ids(self, text: str) -> list[int]:
        ids = []
        for run in re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK)) if text else ():
            ids += self.marked_ids(run)
        return ids

    @staticmethod
    def safe_texts(words: pa.Array, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Texts without an empty word (spaces side by side or at an end) and without a mark of their own."""
        odd = pc.or_(pc.equal(words, ""), pc.match_substring(words, MARK)).to_numpy(zero_copy_only=False)
        return np.diff(np.r_[0, np.cumsum(odd[codes])][bounds]) == 0

    def encode(self, pool: WordPool, texts: pa.Array) -> pa.ListArray:
        ids, bounds = pool.ids_of_texts(texts, self.safe_texts, self.whole_ids, MARK, True)
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))

    def decode(self, lists: pa.ListArray) -> pa.Array:
        """Piece texts are joined for all lists at once; lists with bytes or control ids go to the library."""
        bounds = lists.offsets.to_numpy().astype(np.int64)
        ids = lists.values.to_numpy()[bounds[0]:bounds[-1]]
        bounds = bounds - bounds[0]
        pieces = self.bytes
        raw = b"".join([pieces[i] for i in ids.tolist()])
        ends = np.r_[0, np.cumsum(self.sizes[ids])][bounds]
        special = np.diff(np.r_[0, np.cumsum(self.special[ids])][bounds]) > 0
        # the first piece's space mark is the one that encoding put there
        heads = ids[bounds[:-1][np.diff(bounds) > 0]]
        skip = np.zeros(len(ends) - 1, np.int64)
        skip[np.diff(bounds) > 0] = [int(self.pieces[h].startswith(MARK)) for h in heads.tolist()]
        out = []
        for i, (a, b, s) in enumerate(zip((ends[:-1] + skip).tolist(), ends[1:].tolist(), special.tolist())):
            out.append(self.library.decode(ids[bounds[i]:bounds[i + 1]].tolist()) if s else raw[a:b].decode())
        return pa.array(out, pa.string())


_LOADED: dict[int, tuple[PieceModel, WordPool]] = {}


def _loaded(proto: bytes) -> tuple[PieceModel, WordPool]:
    """The model and its words, kept in the Python worker from task to task."""
    key = hash(proto)
    if key not in _LOADED:
        model = PieceModel(proto)
        _LOADED[key] = model, WordPool(model.marked_ids)
    return _LOADED[key]


def _with(column: str, name: str, make, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, column, SLICE) if pa.types.is_string(batch.schema.field(column).type) else (
                batch.slice(at, 512) for at in range(0, batch.num_rows, 512)):
            keep = [c for c in part.schema.names if c != column]
            yield pa.RecordBatch.from_arrays([*map(part.column, keep), make(part.column(column))], [*keep, name])


def _fields(df: DataFrame, without: str) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if f.name != without)


def encode(docs: DataFrame, model: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the array ``ids`` in place of ``text``: the ids the library gives, without begin or end.

    A null or empty text has no ids. An ``ids`` column of the input is replaced; others pass through.
    """
    ship(docs.sparkSession)
    with open(model or default_model(), "rb") as f:
        proto = f.read()
    rest = docs.drop(ids) if ids in docs.columns else docs
    rest = rest.select(*[c for c in rest.columns if c != text], text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pool = _loaded(proto)
        return _with(text, ids, lambda column: own.encode(pool, column), batches)
    return rest.mapInArrow(frugal(run), f"{_fields(rest, text)}`{ids}` array<int>")


def decode(encoded: DataFrame, model: str | None = None, ids: str = "ids", text: str = "text") -> DataFrame:
    """``encoded`` with ``text`` in place of ``ids``; a null array decodes to an empty text."""
    ship(encoded.sparkSession)
    with open(model or default_model(), "rb") as f:
        proto = f.read()
    rest = encoded.drop(text) if text in encoded.columns else encoded
    rest = rest.select(*[c for c in rest.columns if c != ids],
                       F.coalesce(F.col(ids), F.array().cast("array<int>")).alias(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = _loaded(proto)
        return _with(ids, text, own.decode, batches)
    return rest.mapInArrow(frugal(run), f"{_fields(rest, ids)}`{text}` string")
