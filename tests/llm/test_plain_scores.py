"""The URL classifier against a regression written out one row and one weight at a time."""

import math
from collections import defaultdict
from zlib import crc32

import pytest
from sottovoce.llm import url_filters

ROWS = [("a.com", "/buy/now", 1), ("b.net", "/wiki/x", 0), ("a.com", "/wiki/x", 1), ("", "", 0), ("é.org", "/p", 0), ("b.net", "/wiki/x", 0)]


def grams(host, path):
    out = set()
    for tag, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        data = text.encode()
        out |= {tag.encode() + data[i : i + n] for n in (3, 4, 5) for i in range(len(data) - n + 1)}
    return sorted(out)


def plain_train(rows, rounds, rate=8.0, decay=1e-4):
    w, bias = defaultdict(float), 0.0
    for _ in range(rounds):
        step, shift = defaultdict(float), 0.0
        for host, path, y in rows:
            g = grams(host, path)
            z = sum(w[crc32(x) % url_filters.BUCKETS] for x in g) / math.sqrt(max(len(g), 1)) + bias
            error = 1 / (1 + math.exp(-z)) - y
            shift += error
            for x in g:
                step[crc32(x) % url_filters.BUCKETS] += error / math.sqrt(max(len(g), 1))
        for k in set(w) | set(step):
            w[k] = w[k] * (1 - rate * decay) - rate / len(rows) * step[k]
        bias -= rate / len(rows) * shift
    return w, bias


@pytest.mark.parametrize("rounds", [1, 7, 60])
def test_training_and_scores_equal_a_plain_regression(spark, rounds):
    w, bias = plain_train(ROWS, rounds)
    model = url_filters.train(ROWS, rounds=rounds)
    assert model[1] == pytest.approx(bias, abs=1e-9) and all(model[0][k] == pytest.approx(v, abs=1e-9) for k, v in w.items())
    assert {int(k) for k in model[0].nonzero()[0]} <= set(w)
    pages = [(1, "http://a.com/buy/now?x=1"), (2, "http://B.net/wiki/y#z"), (3, None), (4, "nothing"), (5, "https://é.org/p")]
    got = {r.page_id: r for r in url_filters.judge(spark.createDataFrame(pages, "page_id long, url string"), model, rules=()).collect()}
    for i, host, path in ((1, "a.com", "/buy/now"), (2, "b.net", "/wiki/y"), (3, "", ""), (4, "", ""), (5, "é.org", "/p")):
        g = grams(host, path)
        z = sum(w[crc32(x) % url_filters.BUCKETS] for x in g) / math.sqrt(max(len(g), 1)) + bias
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-z)), abs=2e-6)
        assert got[i].verdict == ("block" if got[i].score > 0.5 else "allow")
