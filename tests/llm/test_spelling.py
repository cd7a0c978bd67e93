import random
import re
import zlib
from collections import Counter

import pytest

import monthloom.llm.spelling as spelling
from monthloom.llm.spelling import Index, near_words, variants


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 97 == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1:]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def brute(words):
    out, form = {}, {}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def as_dict(df):
    got = [(r.word, (r.form, r.root, r.n, r.n_near, r.form_n)) for r in df.collect()]
    assert len(dict(got)) == len(got)
    return dict(got)


def test_index_finds_exactly_one_edit():
    rng = random.Random(1)
    for m in (1, 2, 5, 9):
        words = sorted({"".join(rng.choice("abcé") for _ in range(m + rng.randrange(2))) for _ in range(300)})
        asked = [w for w in words if len(w) == m] + ["z" * m]
        a, b = Index(words, m).near(asked, False)
        assert sorted(zip(a.tolist(), b.tolist())) == [
            (i, j) for i, w in enumerate(asked) for j, v in enumerate(words) if one_edit(w, v)]


@pytest.mark.parametrize("block", [4096, 64])
def test_near_words_in_whole_and_split_keys(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    rng = random.Random(block)
    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(5, 8))): rng.randrange(3, 9) for _ in range(900)}
    words |= {"hot" + "".join(rng.choice("ab") for _ in range(6)): rng.randrange(3, 50) for _ in range(200)}
    got = {r.word: (r.n_near, r.best_n, r.best) for r in near_words(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    want = {}
    for w in words:
        near = [v for v in words if one_edit(w, v)]
        if near:
            best = min(near, key=lambda v: (-words[v], v))
            want[w] = (len(near), words[best], best)
    assert got == want


def test_documents_against_brute_force(small):
    rows = [(r.doc_id, r.text) for r in small.collect()]
    words = brute_words(rows)
    assert len(words) > 1000
    assert as_dict(variants(small)) == brute(words)


def test_chains_ties_and_long_words(spark):
    text = " ".join(["abcde"] * 3 + ["abcdef"] * 6 + ["abcdeg"] * 12 + ["abcdeh"] * 12 + ["xbcdeh"] * 40 + ["ÄÖÜäö"] * 3 + ["äÖÜäö"] * 3
                    + ["q" * 5000] * 3 + ["q" * 4999] * 9)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = as_dict(variants(df, every=1 << 40))
    assert got["abcde"] == ("abcdeg", "xbcdeh" if got["abcdeg"][0] else "abcdeg", 3, 3, 12)
    assert got["abcdeh"][:2] == ("xbcdeh", "xbcdeh") and got["abcdef"][0] == "abcdeg"
    assert got["q" * 5000][0] == "q" * 4999 and got["ÄÖÜäö"][3] == 1 and got["ÄÖÜäö"][0] is None


def test_odd(odd, clashing, none):
    want = brute(brute_words([(r.doc_id, r.text) for r in odd.collect()]))
    assert as_dict(variants(odd)) == want == as_dict(variants(clashing))
    assert variants(none).collect() == []
