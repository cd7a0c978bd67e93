import random

import pyarrow as pa
import pytest

from monthloom.llm.common import utf8_view
from monthloom.llm.secret_scan import BASE, MORE, Rule, TrigramIndex, candidates, find_secrets, trigram_query, trigrams_of

RULES = BASE + MORE


def brute(text, rules=RULES):
    found = [(m.start(), n, m.end()) for n, r in enumerate(rules) for m in r.compiled().finditer(text or "") if len(m[r.group]) >= r.at_least]
    return [(rules[n].kind, s, e) for s, n, e in sorted(found)]


def check(df):
    got = sorted(((r.doc_id, [tuple(s) for s in r.secrets]) for r in find_secrets(df).collect()), key=repr)
    assert got == sorted(((r.doc_id, brute(r.text)) for r in df.collect()), key=repr)


def secrets_in(rng):
    parts = ["token", "SECRET", "Api_Key", "apikey", "password", "paſsword", "=", ":", " ", '"', "'", "abcdef", "0123456789abcdef" * 2, "é",
             "AKIA" + "A1" * 9, "AKIA", "ghp_" + "x" * 36, "xoxb-1234567890-ab", "eyJh.eyJi.sig", "-----BEGIN RSA PRIVATE KEY-----", "\n"]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(25)))


def test_generated(spark):
    rng = random.Random(1)
    check(spark.createDataFrame([(i, secrets_in(rng)) for i in range(2000)], "doc_id long, text string"))


@pytest.mark.parametrize("which", ["odd", "clashing", "small", "none"])
def test_frames(which, request):
    check(request.getfixturevalue(which))


def test_queries():
    assert trigram_query("abcd") == ("and", frozenset({"abc", "bcd"}))
    assert trigram_query("a[bc]d") == ("or", frozenset({"abd", "acd"}))
    assert trigram_query("[0-9a-f]+") is True and trigram_query("ab") is True and trigram_query("(abc)?") is True
    assert trigram_query("(?:abc)+x*def") == ("and", frozenset({"abc", "def"}))
    assert trigram_query("abc|x") is True
    assert trigram_query(BASE[1].pattern) == ("and", frozenset({"aki", "kia"}))


def test_candidates_hold_every_match():
    rng = random.Random(7)
    texts = [secrets_in(rng) for _ in range(1500)]
    for rule in (*RULES, Rule("x", "(foo|bar)?baz(qux){2}")):
        query = trigram_query(rule.pattern)
        postings = TrigramIndex(sorted(trigrams_of(query))).build(*utf8_view(pa.array(texts)))
        possible = set(candidates(query, postings, len(texts)).tolist())
        assert possible >= {i for i, t in enumerate(texts) if rule.compiled().search(t)}
        if query is not True:
            assert len(possible) < len(texts)
