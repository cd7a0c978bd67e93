import random

import pyarrow as pa
import pytest
import sentencepiece

from monthloom.llm.common import WordPool
from monthloom.llm.sentencepieces import PieceModel, decode, default_model, encode


@pytest.fixture(scope="module")
def model():
    with open(default_model(), "rb") as f:
        return PieceModel(f.read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=default_model())


def test_random_strings(model, library):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab  \n▁éßtheing'日😀\x00\t") for _ in range(rng.randrange(40))) for _ in range(1500)]
    texts += ["".join(rng.choice(model.pieces[259:]) for _ in range(rng.randrange(1, 8))).replace("▁", " ") for _ in range(1500)]
    texts += [" " * k + "the" + " " * k for k in range(40)] + [""]
    lists = model.encode(WordPool(model.marked_ids), pa.array(texts))
    assert lists.to_pylist() == [library.encode(t) for t in texts]
    assert model.decode(lists).to_pylist() == [library.decode(library.encode(t)) for t in texts]


def test_fits_means_that_the_pair_stays(model, library):
    rng, live = random.Random(6), sorted(model.right)
    for _ in range(3000):
        a, b = rng.choice(live), rng.choice(live)
        if model.pieces[b].startswith("▁"):
            continue
        joined = model.pieces[a] + model.pieces[b]
        ids = library.encode("x" + joined.replace("▁", " ")) if joined.startswith("▁") else None
        if ids is not None and ids[0] == library.encode("x")[0]:
            assert model.fits(a, b) == (ids[1:] == [a, b])


@pytest.mark.parametrize("which", ["odd", "clashing", "small", "none"])
def test_frames(which, request, library):
    df = request.getfixturevalue(which).select("doc_id", "text", *(["ids"] if which == "clashing" else []))
    want = sorted(((r.doc_id, library.encode(r.text or "")) for r in df.collect()), key=repr)
    coded = encode(df)
    assert sorted(((r.doc_id, r.ids) for r in coded.collect()), key=repr) == want
    assert sorted(((r.doc_id, r.text) for r in decode(coded).collect()), key=repr) == sorted(
        ((i, library.decode(ids)) for i, ids in want), key=repr)
