import hashlib
import struct

import pytest
import xxhash

from monthloom.llm.fingerprints import _ATTEMPTS, fingerprint_edits

LOW = -(1 << 63)


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def check(df, tolerance):
    rows = sorted((r.doc_id if r.doc_id is not None else LOW, r.text or "", r.doc_id) for r in df.select("doc_id", "text").collect())
    want = []
    for n, (_, text, i) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), text, edited, after))
    got = sorted(fingerprint_edits(df).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.n_chars, r.edited_sha256))
    want.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    assert [(r.doc_id, r.n_chars, r.edited_sha256) for r in got] == [w[:3] for w in want]
    prints = {}
    for r, (*_, text, edited, after) in zip(got, want):
        for t, p in ((text, r.fingerprint), (edited, r.edited_fingerprint)):
            assert prints.setdefault(t, p) == p
        for other, near in ((edited, r.near_edited), (after, r.near_next)):
            a, b = shingles(text), shingles(other)
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert 0 <= near <= 1
            if text == other or (not a) != (not b):
                assert near == true
            elif min(len(a), len(b)) >= 40:
                assert abs(near - true) < tolerance


@pytest.mark.parametrize("which", ["odd", "clashing"])
def test_odd(which, request):
    check(request.getfixturevalue(which), 0.25)


def test_documents(small):
    check(small, 0.25)


def test_none_and_one(spark, none):
    assert fingerprint_edits(none).collect() == []
    row = fingerprint_edits(spark.createDataFrame([(7, "a b c d e f")], "doc_id long, text string")).first()
    assert row.near_next == 1.0 and row.edited_sha256 == hashlib.sha256(b"a b c a b c").hexdigest()


def xx(data, seed=42):
    return struct.unpack("<q", struct.pack("<Q", xxhash.xxh64(data, seed=seed % (1 << 64)).intdigest()))[0]


def plain_print(text):
    """Binning, densification and packing, bin by bin."""
    words = [xx(w.encode()) for w in text.lower().split()]
    if not words:
        return ""
    hashes = [xx(" ".join(map(str, words)).encode())] if len(words) < 5 else []
    for i in range(len(words) - 4):
        h = 42
        for w in words[i:i + 5]:
            h = xx(struct.pack("<q", w), h)
        hashes.append(h)
    bins = {}
    for h in hashes:
        bins[(h >> 56) + 128] = min(h, bins.get((h >> 56) + 128, h))
    out = []
    for b in range(256):
        lent = [bins[t[b]] for t in _ATTEMPTS if t[b] in bins]
        if b in bins:
            out.append(bins[b])
        elif lent:
            out.append(lent[0])
        else:
            out.append(min((xx(struct.pack("<q", h >> 56), xx(struct.pack("<i", b))), h) for h in bins.values())[1])
    return "".join(f"{h & 15:x}" for h in out)


def test_fingerprints_by_brute_force(small):
    texts = {r.doc_id: r.text or "" for r in small.collect()}
    got = fingerprint_edits(small).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.fingerprint == plain_print(texts[r.doc_id]), r.doc_id
    assert any(0 < len(t.split()) < 200 for t in texts.values())
