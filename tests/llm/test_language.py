import zlib

import numpy as np
from pyspark.sql import functions as F

from monthloom.llm.language import PIECE, Model, identify, normal, suffix_automaton, training_sample


def greedy(text: bytes, sample: bytes) -> int:
    count, at = 0, 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at:at + n + 1] in sample and text[at:at + 1] in sample:
            n += 1
        count, at = count + 1, at + n
    return count


def test_automaton_accepts_exactly_the_substrings():
    text = np.array([1, 2, 1, 1, 2, 3, 1, 2], np.int32)
    go = suffix_automaton(text, 4)
    inside = {tuple(text[i:j]) for i in range(8) for j in range(i, 9)}
    def accepts(word):
        state = 0
        for c in word:
            state = go[state, c]
            if state < 0:
                return False
        return True
    words = [()]
    for _ in range(4):
        words += [w + (c,) for w in words for c in (1, 2, 3)]
    assert all(accepts(w) == (w in inside) for w in set(words))


def test_phrases_are_the_greedy_parse():
    rng = np.random.default_rng(3)
    sample = {"x": bytes(rng.integers(97, 100, 300).astype(np.uint8)), "y": b"abc abd zzz"}
    model = Model(sample)
    texts = [bytes(rng.integers(97, 102, n).astype(np.uint8)) for n in (1, 2, 50, 1000)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    got = model.phrases(data, np.r_[0, np.cumsum([len(t) for t in texts])])
    for row, text in zip(got, texts):
        for name, value in zip(model.languages, row):
            assert value == greedy(text, sample[name])


def test_long_texts_have_the_phrases_of_one_parse():
    """Pieces are joined: the counts are those of a parse without pieces, also where phrases outlast a piece."""
    rng = np.random.default_rng(5)
    words = [bytes(rng.integers(97, 101, 6).astype(np.uint8)) for _ in range(40)]
    sample = {"x": b" ".join(words[int(i)] for i in rng.integers(0, 40, 60)), "y": b"ab" * 900, "z": bytes(range(97, 105)) * 300}
    model = Model(sample)
    texts = [b" ".join(words[int(i)] for i in rng.integers(0, 40, n)) for n in (1, 146, 147, 300, 1200)]
    texts += [b"ab" * 2600, b"a" * 3000, bytes(range(97, 105)) * 500, b"", b"ab" * 512, b"ab" * 1024 + b"q" + b"ab" * 700]
    data = np.frombuffer(b"".join(texts), np.uint8)
    got = model.phrases(data, np.r_[0, np.cumsum([len(t) for t in texts])])
    for row, text in zip(got, texts):
        for name, value in zip(model.languages, row):
            assert value == greedy(text, sample[name]), (name, text[:20], len(text))


def test_predictions_by_brute_force(small):
    """Whole long texts against the sample, phrase by phrase."""
    docs = small.orderBy(F.length("text").desc_nulls_last()).limit(12)
    sample = training_sample(small)
    normals = {r.doc_id: r.t.encode() for r in docs.select("doc_id", normal(F.col("text")).alias("t")).collect()}
    assert max(len(t) for t in normals.values()) > 3 * PIECE
    model = Model(sample)
    for text in normals.values():
        least = [greedy(text, sample[name]) * np.log(len(sample[name])) for name in model.languages]
        best, _ = model.predict(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert model.languages[best[0]] == model.languages[int(np.argmin(least))]


def test_sample_takes_different_texts_from_anywhere(spark):
    """Copies take one place, and an excerpt may lie behind the beginning of its text."""
    schema = "doc_id long, text string, lang string"
    ids = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 4 != 2]
    copies = [(i, "the very same text", "en") for i in ids[:1000]]
    others = [(i, "".join(chr(97 + (i // 26 ** k) % 26) for k in range(3)) + " word", "en") for i in ids[1000:1100]]
    sample = training_sample(spark.createDataFrame(copies + others, schema))["en"].decode()
    assert sample.count("very same") == 1 and sample.count(" word") == 100
    ends = [(i, "x" * 3000 + f" end{'abcdefghij'[n % 10]}" * 300, "fr") for n, i in enumerate(ids[:60])]
    assert "end" in training_sample(spark.createDataFrame(ends, schema))["fr"].decode()


def test_held_out_accuracy(small):
    rows = identify(small, ("doc_id", "lang")).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_labels_and_ids_of_held_out_rows_do_not_matter(small):
    changed = small.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit("zz")).otherwise(F.col("lang")))
    a, b = ({r.doc_id: (r.lang_pred, r.score) for r in identify(d).collect()} for d in (small, changed))
    assert a == b


def test_odd(odd, clashing, none):
    for df in (odd, clashing):
        rows = identify(df, ("doc_id", "text")).collect()
        assert len(rows) == df.count()
        for r in rows:
            letters = any(c.isalpha() for c in r.text or "")
            assert (r.lang_pred == "und") == (not letters)
    assert identify(none).collect() == []


def test_nothing_to_learn_from(small):
    assert {r.lang_pred for r in identify(small.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
