"""Empty tables, very long texts and clashing columns where the operators' own tests have none."""

import pytest
from sottovoce.llm import audio_fingerprints, mixing, near_dedup, revisits, secret_scans, token_counts

LONG = " ".join(f"w{i % 977} x{i % 7}." for i in range(60_000))


def empty(spark, schema="doc_id long, text string, source string"):
    return spark.createDataFrame([], schema)


def test_empty_tables(spark):
    assert token_counts.token_counts(empty(spark)).count() == 0
    nothing = secret_scans.increment(empty(spark))
    assert nothing.count() == 0 and secret_scans.findings(empty(spark), ["doc_id"], nothing).count() == 0
    members, matches = audio_fingerprints.align(empty(spark, "id long, text string"), "id % 2 = 0")
    assert members.count() == matches.count() == 0


def test_very_long_texts(spark):
    words = len(LONG.split())
    rows = [(1, LONG, "a"), (2, "one two", "a"), (3, "three", "b")]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), max_repeats=2.0).collect()
    assert {r.n_tokens for r in out} == {words, 2, 1}
    # A turn that holds another one, 40,000 frames in.
    turns = [(0, " ".join(LONG.split()[40_000:40_080])), (1, LONG)]
    _, matches = audio_fingerprints.align(spark.createDataFrame(turns, "id long, text string"), "id = 0")
    assert [(r.query_id, r.match_id) for r in matches.collect()] == [(0, 1)]


def test_very_long_pages(spark, tmp_path):
    url = "http://host/" + "p/" * 20_000
    schema = "page_id long, url string, html string"
    spark.createDataFrame([(i, url, LONG * 3) for i in range(6)] + [(9, None, None)], schema).write.parquet(f"{tmp_path}/pages.parquet")
    assert revisits.op2_revisits(spark, str(tmp_path)).count() >= 6


@pytest.mark.parametrize("extra", ["key string, lead long, h long, n_shingles int, component_id int, kept int", "size int, root long, member long, a long, b long, set array<long>"])
def test_near_dedup_beside_clashing_columns(spark, extra):
    n = len(extra.split(", "))
    rows = [(i, " ".join(f"w{j}" for j in range(30 if i < 3 else 31 + i)), *[None] * n) for i in range(6)]
    got = {r.id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, f"doc_id long, text string, {extra}"), 3, 85).collect()}
    plain = {r.id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), 3, 85).collect()}
    assert got == plain and got[1][1] == 0
