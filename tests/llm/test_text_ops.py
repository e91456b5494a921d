"""Line dedup, quality rules, secret scans and mixing on small and awkward inputs."""

import hashlib
import random
import re
from collections import Counter

import pytest
from sottovoce.llm import line_dedup, mixing, quality_rules, secret_scans

PROSE = "The river ran past the old mill and the children watched it from the bridge every day. "
LONG = PROSE * 400
DOCS = [
    (1, "a line.\nb line.\nc line.\nd line.", "s0"),
    (2, "x.\na line.\nb line.\nc line.\ny.", "s1"),
    (3, None, None),
    (4, "", "s0"),
    (5, "a line.\nb line.\nc line.\nd line.\na line.\nb line.\nc line.", "s1"),
    (5, "a line.\nb line.\nc line.\nd line.\na line.\nb line.\nc line.", "s1"),
    (6, LONG, "s0"),
    (None, "\n\n\n\n", "s2"),
    (7, "home | menu | login\n" + " ".join(f"Word{i} goes{i} on{i}, and{i} it{i} ends{i} well{i} here{i}." for i in range(20)), "s0"),
    (8, "password: abcdef9 and token=ab token = 'longer_value' AKIA" + "A" * 16 + " " + "0af" * 9 + " 가나 secret:zzzzzzz", "s3"),
]
SCHEMA = "doc_id long, text string, source string, key string, pos int, id string, block string, spans string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "k", 1, "i", "b", "s") for r in DOCS], SCHEMA)


def test_line_dedup_keeps_first_and_merges(docs):
    out = {(r.doc_id, r.text, r.d_removed) for r in line_dedup.dedup_lines(docs).collect()}
    assert (1, "a line.\nb line.\nc line.\nd line.", 0) in out
    assert (2, "x.\ny.", 3) in out
    assert (5, "", 7) in out
    assert (3, None, 0) in out and (4, "", 0) in out and (None, "\n\n\n\n", 0) in out
    assert line_dedup.dedup_lines(docs).count() == len(DOCS)


def test_line_dedup_keeps_first_occurrences_that_overlap_their_repetition(spark):
    texts = ["a.\na.\na.\na.\na.", "a.\na.\na.\na.", "b.\nc.\nb.\nc.\nb.\nc.", "d.\ne.\nf.\nd.\ne.\nf.", "long " * 50_000 + "\n" * 30]
    rows = [(i, t, i, i) for i, t in enumerate(texts)]
    out = {r.doc_id: (r.text, r.d_lines, r.d_removed) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, d_lines int, d_removed int")).collect()}
    assert out == {0: ("a.\na.\na.", 5, 2), 1: ("", 4, 4), 2: ("b.\nc.\nb.\nc.", 6, 2), 3: ("d.\ne.\nf.", 6, 3), 4: (texts[4], 31, 0)}


def test_line_dedup_carries_columns_and_empty_tables(spark, docs):
    assert line_dedup.dedup_lines(docs).columns == [*docs.columns, "d_lines", "d_removed"]
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_counts_match_brute_force(spark):
    texts = [t for _, t, _ in DOCS] + ["a b c a b c", "a b c d a b c d a", "x x x x x", "one two", "\u00a0 a\u3000b \x0b c", "# * $ %\n# * $ %\n\n \n", "p q r s p q r t q r s"]
    rows = quality_rules.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        n, chars, symbols, dups, rep = quality(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dups, rep)
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n)
        assert not (r.base_failed and r.kept)


def test_quality_cleaning_cuts_lines_and_drops_documents(docs):
    out = {r.doc_id: r for r in quality_rules.clean(docs).collect()}
    assert set(out) == {7} and not out[7].text.startswith("home") and quality_rules.clean(docs).columns == docs.columns
    assert quality_rules.clean(docs.limit(0)).count() == 0


def line_rule(line):
    """A plain version of the line rules."""
    bare = line.rstrip(" \t\n\x0b\x0c\r")
    if not bare:
        return None
    if any(p in line.lower() for p in quality_rules.BOILERPLATE):
        return "boilerplate"
    marks, blanks = sum(c in quality_rules.BREADCRUMB for c in bare), sum(c in " \t\x0b\x0c\r" for c in line)
    left = re.sub(f"{quality_rules.BETWEEN}", "", re.sub(f"(?i){quality_rules.MENU}", " ", bare, flags=re.A))
    if (marks and marks * 3 > blanks) or (re.match(f"(?i){quality_rules.MENU}", bare) and not left):
        return "navigation"
    if sum(c in quality_rules.SYMBOLS for c in bare) > 0.1 * len(bare):
        return "symbols"
    if bare.rstrip(quality_rules.CLOSING)[-1:] not in quality_rules.TERMINAL and not any(x in line for x in (". ", "! ", "? ")):
        return "punctuation"
    return None


def test_quality_verdicts_match_a_plain_version(spark):
    rng = random.Random(4)
    say = lambda n: " ".join(f"w{rng.randint(0, 9999)}" for _ in range(n))
    line = lambda: rng.choice([say(9) + ".", say(6), say(4) + "! " + say(2), "Home | Menu > login", "home about " * 40, "back next x", say(3) + "." + '"' * rng.randint(0, 12), "a > b > c", say(5) + " # $ % & * |", "All Rights Reserved " + say(2), "", "  ", say(4) + "\u2026\u201d", "|", say(8) + ")"])
    texts = ["\n".join(line() for _ in range(rng.randint(1, 40))) for _ in range(300)]
    for r in quality_rules.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        rules = [(x, line_rule(x)) for x in texts[r.doc_id].split("\n")]
        count = Counter(v for _, v in rules if v)
        lost = sum(len(re.sub("[ \t\x0b\x0c\r]", "", x)) for x, v in rules if v)
        assert (r.n_no_punctuation, r.n_navigation, r.n_boilerplate, r.n_symbol_lines) == (count["punctuation"], count["navigation"], count["boilerplate"], count["symbols"])
        assert r.removed_chars == lost and r.kept == (not r.base_failed and lost <= 0.5 * r.word_chars)


def base_spans(text):
    out = []
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out += [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secret_spans_match_brute_force(spark):
    texts = [t for _, t, _ in DOCS] + ["token=token: abcdefgh", "\U0001f600 PASSWORD = 'a-b/c=d+e' API_KEY:xyz123456", "secret" * 50, "deadbeef" * 3 + "\U0001f600" + "cafe" * 7, "AKIA" * 9]
    history = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ledger = secret_scans.increment(history)
    found = {r.doc_id: r.spans for r in secret_scans.findings(history, ["doc_id"], ledger).collect()}
    for i, t in enumerate(texts):
        assert [tuple(s) for s in found[i] if s.rank < 3] == base_spans(t or "")


def test_ledger_scans_only_unseen_pairs(spark):
    first = spark.createDataFrame([("p1", "token=abcdef1"), ("p2", "plain")], "path string, text string")
    one = secret_scans.increment(first, rules=secret_scans.RULES[:2])
    assert one.count() == 2
    grown = first.union(spark.createDataFrame([("p3", "token=abcdef1"), ("p4", "new AKIA" + "B" * 20)], first.schema))
    two = secret_scans.increment(grown, one)
    seen = {bytes(r.blob): set(r.scanned) for r in two.collect()}
    assert len(seen) == 3
    known = hashlib.sha256(b"plain").digest()
    assert seen[known] == {r.key for r in secret_scans.RULES[2:]}
    paths = {r.path: [s.kind for s in r.spans] for r in secret_scans.findings(grown, ["path"], one.union(two)).collect()}
    assert paths == {"p1": ["assign"], "p2": [], "p3": ["assign"], "p4": ["access"]}
    assert secret_scans.increment(grown, one.union(two)).count() == 0


def test_mixing_takes_each_document_and_keeps_the_limit(spark):
    rows = [(i, "w " * 10, "big") for i in range(900)] + [(i, "w " * 10, "small") for i in range(900, 1000)] + [(2000, None, None), (2001, "one", None), (2002, "", "empty")]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), max_repeats=2.0, block_docs=16).collect()
    times = Counter(r.row.doc_id for r in out)
    assert all(times[i] == 1 for i in range(900)) and all(1 <= times[i] <= 3 for i in range(900, 1000)) and set(times) >= {2000, 2001, 2002}
    assert {r.source for r in out} == {"big", "small", None, "empty"}


@pytest.mark.parametrize("target", [1.4, 1.6, 1.9, 2.5])
def test_mixing_exponent_equals_a_plain_bisection(spark, target):
    from math import log2

    sizes = {"a": 5000, "b": 700, "c": 260, "d": 40}
    rows = spark.createDataFrame([(s, 1, n) for s, n in sizes.items()], "source string, n_docs long, n_tokens long")
    got = mixing.source_plan(rows, None, target, 1000).first().exponent
    shares = [n / sum(sizes.values()) for n in sizes.values()]
    bits = lambda x: sum(-(p**x) / sum(q**x for q in shares) * log2(p**x / sum(q**x for q in shares)) for p in shares)
    low, high = 0.0, 1.0
    for _ in range(60):
        low, high = ((low + high) / 2, high) if bits((low + high) / 2) >= target else (low, (low + high) / 2)
    assert got == pytest.approx(0.0 if bits(0) < target else low, abs=2e-6)
    assert (got == 0) == (target > 2)


def test_mixing_to_entropy_and_budget(spark):
    rows = [(i, "w " * 10, f"s{0 if i < 600 else i % 4}") for i in range(1000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), max_repeats=None, target_entropy=1.9, budget=5000, block_docs=8)
    got = {r.source: r["sum(n_tokens)"] for r in out.groupBy("source").sum("n_tokens").collect()}
    total = sum(got.values())
    assert 4900 <= total <= 5000
    from math import log2

    assert abs(sum(-v / total * log2(v / total) for v in got.values()) - 1.9) < 0.03
    assert mixing.mix(out.sparkSession.createDataFrame([], "doc_id long, text string, source string")).count() == 0
