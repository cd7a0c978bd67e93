import collections
import string

from monthloom.llm.line_dedup import drop_repeated_lines, keep_bits, keep_bitmaps

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
BLANK = " \t\n\x0b\f\r"


def brute(rows, min_chars=40, min_docs=5):
    low = -(1 << 63)
    held = collections.defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            held[line.strip(BLANK).translate(FOLD)].add(low if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            k = line.strip(BLANK).translate(FOLD)
            if len(k) < min_chars or len(held[k]) < min_docs or max(held[k]) == (low if i is None else i):
                kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def check(df, **more):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in drop_repeated_lines(df, **more).collect()), key=repr)
    assert got == brute(rows, **more)


def test_odd(odd, none):
    check(odd)
    check(none)


def test_clashing_columns(clashing):
    kept = drop_repeated_lines(clashing)
    assert set(kept.columns) == set(clashing.columns)
    assert {r.keep for r in kept.collect()} == {"x"}
    check(clashing)


def test_documents(small):
    check(small)


def test_line_over_many_partitions(spark):
    """A third of all lines is one line; it spans several sorted partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        rows = [(i, "\n".join(["x" * 45] + [f"{i} {j} " + "y" * 40 for j in range(2)])) for i in range(500)]
        check(spark.createDataFrame(rows, "doc_id long, text string"))
        check(spark.createDataFrame([(i, "z" * 50) for i in range(100)], "doc_id long, text string"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_bitmaps(spark):
    rows = [(i, f"short {i}\n" + "a" * 41 + "\nlast") for i in range(5)]
    maps = {r.did: r.keep for r in keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sorted(maps) == [0, 1, 2, 3]
    assert keep_bits(bytes(maps[0]), 3).tolist() == [True, False, True]
