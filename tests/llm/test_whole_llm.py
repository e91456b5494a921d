"""Corpus operators do the whole job: cases that earlier versions lost."""

import random

import pytest
from sottovoce.llm import audio_fingerprints, secret_scans


@pytest.mark.parametrize("rate", [0.1, 0.15])
def test_fingerprint_search_finds_short_copies_with_replaced_words(spark, rate):
    """Against all offsets, for recordings of 31 to 60 frames, some with words in front."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = []
    for q in range(0, 120, 2):
        words = [word() for _ in range(rng.randint(31, 60))]
        copy = [word() if rng.random() < rate else w for w in words]
        rows += [(q, " ".join(words)), (q + 1, " ".join([word() for _ in range(rng.choice([0, 0, 3]))] + copy))]
    _, matches = audio_fingerprints.align(spark.createDataFrame(rows, "id long, text string"), "id % 2 = 0")
    found = {(r.query_id, r.match_id) for r in matches.collect()}
    marks = {i: audio_fingerprints.fingerprint(audio_fingerprints.chroma_of_text(t)) for i, t in rows}
    want = set()
    for q in range(0, 120, 2):
        for m, f in marks.items():
            tried = (audio_fingerprints.bit_errors(marks[q], f, o) for o in range(16 - len(f), len(marks[q]) - 15)) if m != q else ()
            if any(n >= 16 and e <= 0.25 * 32 * n for n, e in tried):
                want.add((q, m))
    assert found <= want and len(found) >= 0.9 * len(want) > 40


def test_a_new_rule_version_replaces_the_spans_of_the_old_one(spark):
    assign = next(r for r in secret_scans.RULES if r.kind == "assign")
    old, new = (assign,), (assign._replace(version=assign.version + 1, least=assign.least + 10),)
    short, long = (f"password = '{'aB3x' * n}'" for n in (assign.least // 4 + 1, assign.least))
    history = spark.createDataFrame([(1, short), (2, long)], "doc_id long, text string")
    one = secret_scans.increment(history, rules=old)
    both = one.union(secret_scans.increment(history, one, rules=new))
    found = lambda rules: {r.doc_id: len(r.spans) for r in secret_scans.findings(history, ["doc_id"], both, rules=rules).collect()}
    assert found(old) == {1: 1, 2: 1} and found(new) == {1: 0, 2: 1}
