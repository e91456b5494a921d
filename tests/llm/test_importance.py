"""Importance resampling against its plain definition, and CRCs against zlib."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from sottovoce.llm import importance


@pytest.mark.parametrize("reach", [1, 3, 16, 128])
def test_crcs_equal_zlib(reach, monkeypatch):
    rng = random.Random(reach)
    monkeypatch.setattr(importance, "AT_A_TIME", 500)
    data = np.frombuffer(bytes(rng.randrange(256) for _ in range(6000)), np.uint8)
    start = np.array([rng.randrange(4000) for _ in range(400)])
    end = start + np.array([rng.choice([1, 2, 3, 5, 16, 17, 127, 128, 129, 256, 257, 700, 1999]) for _ in range(400)])
    got = importance.PositionTable(reach).crcs(data, start, end)
    assert got.tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(start, end, strict=True)]


def plain_features(text):
    lower = (text or "").translate({i: i + 32 for i in range(65, 91)})
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain(rows, target, percent=5):
    found = [(i, *plain_features(t)) for i, t in rows]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for x in target for b in plain_features(x)[1])
    S, T = sum(s.values()), sum(t.values())  # noqa: N806
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    out = []
    for i, n, f in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    may = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    rank = {id(r): k for k, r in enumerate(may[: percent * len(may) // 100], 1)}
    return [(*r[:4], rank.get(id(r))) for r in out]


WORDS = "The river ran past the old mill while children watched ÉCOLE über straße 42 7th x- y_z naïve I'm ß 가나 end".split()
AWKWARD = [None, "", " \t", "...", "a", "A b", "one-two_three", "É\xa0é z\x7fq", "w" * 700 + " " + "é" * 300 + " tail", "\0\n" * 10]


def corpus():
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.choice([5, 19, 20, 21, 60, 200])))) for i in range(300)]
    rows += list(enumerate(AWKWARD, 300)) + [(400, "many words " * 20_000), (-5, rows[0][1]), (7, rows[7][1]), (7, rows[7][1]), (None, rows[9][1])]
    return rows


def same(got, want):
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in got), key=order) == sorted(want, key=order)


def test_query_follows_its_contract(spark, tmp_path):
    rows, target = corpus(), [" ".join(WORDS[3:9]), "the old MILL again", None, "über straße 42"]
    spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], "doc_id long, text string, rank string, row int, score int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = importance.op11_importance(spark, str(tmp_path))
    assert out.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    same(out.collect(), plain(rows, target))


@pytest.mark.parametrize("percent", [0, 37, 100])
def test_shares_ties_and_an_empty_target(spark, percent):
    rows = corpus()[:80] + [(5, corpus()[5][1])] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    same(importance.resample(docs, docs.limit(0), percent=percent).collect(), plain(rows, [], percent))


def test_empty_table_and_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(docs, docs).count() == 0
    texts = [t for _, t in corpus()[:320]]
    words, whose, buckets = importance.features(texts)
    assert words.tolist() == [plain_features(t)[0] for t in texts]
    assert all(sorted(buckets[whose == i].tolist()) == sorted(plain_features(t)[1]) for i, t in enumerate(texts))


def test_ranks_are_numbers_in_order(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("x"), (F.col("id") % 3).alias("y"))
    got = importance.ranked(rows, F.desc("x")).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 5001)) and all(r["rank"] == 5000 - r.x for r in got)
