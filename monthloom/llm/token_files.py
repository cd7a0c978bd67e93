"""Token ids in files of fixed-width bit-packed blocks.

Documents are range-partitioned by id, tokenized and packed into blocks of whole documents; every id takes as
many bits as the vocabulary needs. A block row holds its shard, number, first id within the shard, bit width,
the packed ids, and the ids and sizes of its documents, so any block is unpacked alone, with numpy, and any id
is found from the block starts. Files are Parquet tables of such rows: Spark commits them whole, on any store.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from monthloom.llm.common import WordPool, frugal, id_key, ship, slices

BLOCK_IDS = 1 << 16
#: Remembered words, their ids and pieces (about 80 MB in all), and bytes of text encoded at once.
MOST_WORDS, MOST_IDS, MOST_PIECES, SLICE = 500_000, 4_000_000, 200_000, 1 << 22
BLOCKS = ("shard int, block int, first_id long, width int, n_ids int, doc_ids array<long>, sizes array<int>, "
          "payload binary")
#: How byte-level tokenizers of this family cut texts before merging (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Any character that some definition calls white space.
WHITE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids as ``width`` bits each, least significant first, without gaps."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, width: int, start: int, count: int) -> np.ndarray:
    """``count`` ids from place ``start`` on, reading only their bytes."""
    bit = np.arange(start, start + count, dtype=np.int64) * width
    if count == 0:
        return np.zeros(0, np.uint32)
    low = int(bit[0]) >> 3
    data = np.frombuffer(payload, np.uint8, min(len(payload) - low, (count * width + 7 >> 3) + 1), low)
    data = np.r_[data, np.zeros(8, np.uint8)].astype(np.uint64)
    at = (bit >> 3) - low
    word = sum(data[at + k] << np.uint64(8 * k) for k in range((width + 7 >> 3) + 1))
    return ((word >> (bit & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.uint32)


class ByteBpe:
    """A byte-level BPE tokenizer that encodes each distinct word once."""

    def __init__(self, source: str):
        self.tokenizer = Tokenizer.from_str(source)
        spec = json.loads(source)
        cut = spec.get("pre_tokenizer") or {}
        added = [t["content"] for t in spec.get("added_tokens", [])]
        self.by_words = (cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
                         and not spec.get("normalizer") and not spec.get("post_processor") and spec["model"]["type"] == "BPE"
                         and not any(" " in t for t in added))
        self.marks = [t[:2] for t in added]
        self.model, self.pattern, self.pieces = self.tokenizer.model, regex.compile(PATTERN), {}
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.width = max(1, int(self.tokenizer.get_vocab_size() - 1).bit_length())

    def whole_ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def piece_ids(self, piece: str) -> list[int]:
        """Ids of a piece that the merges see as a whole."""
        known = self.pieces.get(piece)
        if known is None:
            if len(self.pieces) > MOST_PIECES:
                self.pieces.clear()
            shown = piece.encode().decode("latin-1").translate(self.letters)
            known = self.pieces[piece] = [t.id for t in self.model.tokenize(shown)]
        return known

    def word_ids(self, word: str) -> list[int]:
        bare = word[1:] if word[:1] == " " else word
        if bare.isalpha():
            return self.piece_ids(word)
        if bare[:-1].isalpha() and bare[-1] in ".,":
            return self.piece_ids(word[:-1]) + self.piece_ids(word[-1])
        if not word.isascii() and max(word) >= "ɐ" or any(m in word for m in self.marks):
            return self.whole_ids(word)
        ids = []
        for piece in self.pattern.findall(word):
            ids += self.piece_ids(piece)
        return ids

    def safe_texts(self, words: pa.Array, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Texts in which no space stands between two white spaces: elsewhere a cut before a space changes nothing."""
        if not self.by_words:
            return np.zeros(len(bounds) - 1, bool)
        starts, ends = (pc.or_(pc.equal(words, ""), pc.match_substring_regex(words, p)).to_numpy(zero_copy_only=False)
                        for p in (f"^{WHITE}", f"{WHITE}$"))
        odd = np.zeros(len(codes), bool)
        odd[1:] = starts[codes[1:]] & ends[codes[:-1]]
        odd[bounds[:-1][bounds[:-1] < len(codes)]] = False
        return np.diff(np.r_[0, np.cumsum(odd)][bounds]) == 0

    def encode(self, pool: WordPool, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return pool.ids_of_texts(texts, self.safe_texts, self.whole_ids, " ", False)


_LOADED: dict[int, tuple[ByteBpe, WordPool]] = {}


def _loaded(source: str) -> tuple[ByteBpe, WordPool]:
    key = hash(source)
    if key not in _LOADED:
        own = ByteBpe(source)
        _LOADED[key] = own, WordPool(own.word_ids, MOST_WORDS, MOST_IDS)
    return _LOADED[key]


def _blocks(source: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pool = _loaded(source)
        shard, number, first = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids, bounds = own.encode(pool, part.column("text"))
                counts = np.diff(bounds)
                closed = np.insert(ids, bounds[1:], end_id).astype(np.uint32)
                ends = bounds + np.arange(len(bounds))
                doc_ids, rows, a = part.column("doc_id"), [], 0
                while a < len(counts):
                    b = max(a + 1, int(np.searchsorted(ends, ends[a] + BLOCK_IDS, side="right")) - 1)
                    rows.append((shard, number, first, own.width, int(ends[b] - ends[a]), doc_ids.slice(a, b - a).to_pylist(),
                                 (counts[a:b] + 1).tolist(), pack(closed[ends[a]:ends[b]], own.width)))
                    first, number, a = first + int(ends[b] - ends[a]), number + 1, b
                types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
                names = ["shard", "block", "first_id", "width", "n_ids", "doc_ids", "sizes", "payload"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2) -> None:
    """Write the ids of all documents, each closed by ``end_id``, in ascending ``doc_id`` order (null first,
    rows of one id by text). A null or empty text is its end id alone."""
    ship(docs.sparkSession)
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        source = f.read()
    (docs.select(id_key().alias("did"), "doc_id", "text").repartitionByRange("did")
     .sortWithinPartitions("did", F.col("text").asc_nulls_first()).select("doc_id", "text")
     .mapInArrow(frugal(_blocks(source, end_id)), BLOCKS).write.option("compression", "zstd").parquet(path))


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of a written table, with ``start``: the place of their first id among all ids."""
    rows = spark.read.schema(BLOCKS).parquet(path)
    sizes = rows.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    # one row for each shard, which is a partition of the writing job
    base = sizes.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("base"))
    return rows.join(F.broadcast(base), "shard").withColumn("start", F.col("base") + F.col("first_id")).drop("base")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            block = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
            ids = unpack(block["payload"], block["width"], 0, block["n_ids"]).astype("<u4")
            ends = np.cumsum(block["sizes"])
            starts = ends - block["sizes"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(block["doc_ids"], pa.int64()), pa.array(starts + block["start"]),
                 pa.array(np.asarray(block["sizes"], np.int64)),
                 pa.array([ids[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())], pa.binary())],
                ["doc_id", "start", "n_tokens", "ids"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document; ids are little-endian unsigned 32-bit integers."""
    ship(spark)
    found = blocks(spark, path).select("doc_ids", "sizes", "width", "n_ids", "payload", "start")
    return found.mapInArrow(frugal(_documents), "doc_id long, start long, n_tokens long, ids binary")


def read_ids(spark: SparkSession, path: str, start: int, count: int) -> np.ndarray:
    """``count`` ids from place ``start`` of all ids on; only the blocks that hold them are read."""
    rows = (blocks(spark, path).where((F.col("start") < start + count) & (F.col("start") + F.col("n_ids") > start))
            .select("start", "n_ids", "width", "payload").orderBy("start").collect())
    parts = []
    for row in rows:
        a, b = max(0, start - row.start), min(row.n_ids, start + count - row.start)
        parts.append(unpack(bytes(row.payload), row.width, a, b - a))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)
