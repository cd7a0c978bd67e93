import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from monthloom.llm.common import WordPool
from monthloom.llm.token_files import ByteBpe, default_tokenizer, pack, read_documents, read_ids, unpack, write_tokens
from monthloom.sources.store import scratch_path


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_tokenizer())


@pytest.mark.parametrize("width", [1, 3, 7, 8, 13, 16, 17, 25, 32])
def test_packing(width):
    values = np.random.default_rng(width).integers(0, 1 << width, 1000).astype(np.uint32)
    packed = pack(values, width)
    assert len(packed) == -(-1000 * width // 8)
    for start, count in ((0, 1000), (137, 500), (999, 1), (5, 0)):
        assert unpack(packed, width, start, count).tolist() == values[start:start + count].tolist()


def test_random_strings(library):
    rng = random.Random(2)
    parts = ["a", "b", " ", "  ", "\n", "'s", "é", "ß", "the", "in", "日", "\x00", "\t", "1", "23", "<|endoftext|>", "<|", "!", "...", "\xa0"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(4000)] + [""]
    with open(default_tokenizer(), encoding="utf-8") as f:
        own = ByteBpe(f.read())
    ids, bounds = own.encode(WordPool(own.word_ids), pa.array(texts))
    want = library.encode_batch(texts, add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [e.ids for e in want]


@pytest.mark.parametrize("which", ["odd", "clashing", "small", "none"])
def test_files(spark, which, request, library):
    df = request.getfixturevalue(which)
    path = scratch_path(spark, "test-tokens")
    write_tokens(df, path)
    rows = sorted(((-1 if r.doc_id is None else r.doc_id, r.text is not None, r.text or "", r.doc_id) for r in df.select("doc_id", "text").collect()))
    stream, want = [], []
    for *_, text, i in rows:
        ids = library.encode(text, add_special_tokens=False).ids + [2]
        want.append((i, len(stream), len(ids), ids))
        stream += ids
    got = sorted(((r.doc_id, r.start, r.n_tokens, np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in read_documents(spark, path).collect()),
                 key=lambda r: r[1])
    assert got == want
    for start, count in ((0, 10), (len(stream) // 2, 500), (max(0, len(stream) - 3), 9)):
        assert read_ids(spark, path, start, count).tolist() == stream[start:start + count]
