"""Runs of words against a search of all periods at all places."""

import hashlib
import random
import zlib
from fractions import Fraction

import pytest
from sottovoce.llm import periodic_runs


def all_runs(words, least=24, periods=3):
    """Every maximal stretch of every period, by start and period; a stretch keeps its smallest period."""
    found = {}
    for q in range(1, len(words) // periods + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, periods * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items())


def shaped(rng):
    """Words of one of several shapes: free, repeated, nested, Fibonacci, one word, nearly one word."""
    k = rng.choice([1, 2, 3, 5, 50])
    base = [b"w%d" % rng.randint(0, k) for _ in range(rng.randint(0, 150))]
    shape = rng.randint(0, 6)
    if shape == 1:
        return base + base[: rng.randint(1, 30)] * rng.randint(1, 9) + base[:5]
    if shape == 2:
        return (base[: rng.randint(1, 9)] * 3 + base[:3]) * rng.randint(1, 8)
    if shape == 3:
        a, b = [b"a"], [b"a", b"b"]
        for _ in range(rng.randint(1, 10)):
            a, b = b, b + a
        return b
    if shape == 4:
        return [b"x"] * rng.randint(0, 300)
    if shape == 5:
        return [w for _ in range(rng.randint(1, 6)) for w in [b"a"] * rng.randint(20, 30) + [b"b"]]
    return [w for _ in range(6) for w in base[: rng.randint(1, 40)] * rng.randint(1, 4)] if shape == 6 else base


@pytest.mark.parametrize("seed", range(12))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(12):
        documents = [shaped(rng) for _ in range(rng.randint(1, 7))]
        documents += documents[:2]  # copies share the grammar
        whose, start, length, period = (x.tolist() for x in periodic_runs.runs_of(documents))
        got = list(zip(whose, start, length, period, strict=True))
        assert got == [(d, *r) for d, words in enumerate(documents) for r in all_runs(words)]


@pytest.mark.parametrize(("least", "periods"), [(24, 3), (30, 4), (100, 3)])
def test_other_limits(least, periods):
    rng = random.Random(least)
    documents = [shaped(rng) for _ in range(40)]
    got = list(zip(*(x.tolist() for x in periodic_runs.runs_of(documents, least, periods)), strict=True))
    assert got == [(d, *r) for d, words in enumerate(documents) for r in all_runs(words, least, periods)]


def test_grammar_derives_the_words():
    rng = random.Random(1)
    words = [w for _ in range(50) for w in shaped(rng)]
    numbers = {w: i for i, w in enumerate(sorted(set(words)))}
    import numpy as np

    ids = np.array([numbers[w] for w in words])
    g = periodic_runs.re_pair(ids.copy(), len(numbers))

    def derive(x):
        return [x] if x < g.n_words else derive(g.left[x - g.n_words]) + derive(g.right[x - g.n_words])

    assert [y for x in g.sequence for y in derive(x)] == ids.tolist() and len(g.sequence) < len(words) / 4
    pairs = list(zip(g.sequence[:-1], g.sequence[1:], strict=True))
    # No pair of two different symbols is left twice.
    assert all(pairs.count(p) == 1 for p in pairs if p[0] != p[1])


def plain(doc_id, text):
    """The contract of the query, word for word."""
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = all_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_follows_its_contract(spark, tmp_path):
    rng = random.Random(4)
    texts = [b" ".join(shaped(rng)).decode() for _ in range(120)]
    texts += [None, "", " \t\n", "one", "a\xa0b\x1cc " * 30, "\x0b".join(["å é"] * 20), "long tail of words here " * 4000]
    rows = [(i, t, "clash", 5) for i, t in enumerate(texts)]
    rows += [(None, texts[1], "x", 1), rows[3], rows[3]]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))) > 5
    spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int").write.parquet(f"{tmp_path}/documents.parquet")
    out = periodic_runs.op12_periodic_runs(spark, str(tmp_path))
    assert [f.dataType.simpleString() for f in out.schema] == ["bigint"] * 6 + ["string"] * 2
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in out.collect()), key=order) == sorted((plain(r[0], r[1]) for r in rows), key=order)


def test_full_output_and_empty_tables(spark):
    text = "start " + "la di da " * 12 + "end"
    (r,) = periodic_runs.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (r.n_words, [tuple(x) for x in r.runs], tuple(r.best), r.collapsed) == (38, [(1, 36, 3)], (1, 36, 3), "start la di da end")
    assert periodic_runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError, match="24 words"):
        periodic_runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string"), least=5)
