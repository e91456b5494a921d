"""Encoding by an index of pairs against the tokenizers library: the public vocabulary, and small invented ones."""

import hashlib
import random

import numpy as np
import pytest
from sottovoce.llm import word_bpe
from tokenizers import Tokenizer, models

AWKWARD = [
    None, "", " \t\n", " ", "Don't stop<|endoftext|>x<|startoftext|> a’b É́  c", "ΟΔΟΣ İx", "a\x1cb \x00 x", "aaaaaa !!!!!!!???? '''s",
    "<|endoftext", "x" * 5000, "!?" * 4000, "́́ é  z\u0085y", "가나다 \U0001f600\U0001f493 ²½٠", "the river " * 3000,
]


def texts():
    rng = random.Random(3)
    pools = ["ab", "aehinorst ", "éÉßñ'sd .", "0123 ab²", "́aéİΣσς각あ   \U0001f600", "<|endoftext|>a", "!?.,'\"-", "lowering merges the inning thing "]
    return AWKWARD + ["".join(rng.choice(pool) for _ in range(rng.randint(1, 60))) for pool in pools for _ in range(60)]


def test_equals_the_library_on_awkward_texts(spark):
    rows = list(enumerate(texts()))
    table = spark.createDataFrame([(i, t, "clash", 1) for i, t in [*rows, *rows[:20], (None, "null id")]], "doc_id long, text string, ids string, n_tokens int")
    library = Tokenizer.from_file(word_bpe.public_vocabulary())
    got = {}
    for r in word_bpe.recoded(table).collect():
        assert got.setdefault(r.id, r) == r
    assert word_bpe.recoded(table).count() == len(rows) + 21
    for i, t in [*rows, (None, "null id")]:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids and got[i].n_tokens == len(ids)
        assert got[i].decoded.decode() == library.decode(ids, skip_special_tokens=False)


def test_query_digests_and_empty_tables(spark, tmp_path):
    rows = list(enumerate(texts()[:12]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    library = Tokenizer.from_file(word_bpe.public_vocabulary())
    want = set()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert {tuple(r) for r in word_bpe.op13_word_bpe(spark, str(tmp_path)).collect()} == want
    assert word_bpe.recoded(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", range(60))
def test_index_keeps_the_order_of_merges_that_wait_for_lower_ranks(seed):
    """Merges in any order, so that a merge often makes a pair of a lower rank than its own."""
    rng = random.Random(seed)
    signs = [s for _, s in sorted((b, s) for s, b in word_bpe._byte_of().items())]
    vocab = {t: i for i, t in enumerate([*signs, *(s + "</w>" for s in signs)])}
    parts, merges = ["a", "b", "c", "a</w>", "b</w>"], []
    for _ in range(40):
        a, b = rng.choice([p for p in parts if not p.endswith("</w>")]), rng.choice(parts)
        if len(a + b) < 20 and (a, b) not in merges:
            merges.append((a, b))
            if a + b not in vocab:
                vocab[a + b] = len(vocab)
                parts.append(a + b)
    rng.shuffle(merges)
    library = Tokenizer(models.BPE(vocab=vocab, merges=merges, end_of_word_suffix="</w>"))
    index = word_bpe.PairIndex(vocab, merges)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 40))) for _ in range(300)] + ["a" * n for n in range(1, 30)]
    ids, starts = index.encode([w.encode() for w in words])
    assert any(index.one_by_one)
    for w, low, high in zip(words, starts[:-1], starts[1:], strict=True):
        assert ids[low:high].tolist() == library.encode(w, add_special_tokens=False).ids


def test_blocks_and_memory_do_not_change_results(monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["alpha", "Beta,", "x" * 150, f"n{rng.randint(0, 99)}", "café"]) for _ in range(30)) for _ in range(40)]
    whole = list(word_bpe.TextCoder(word_bpe.public_vocabulary()).block(texts))
    monkeypatch.setattr(word_bpe, "REMEMBERED", 2000)
    monkeypatch.setattr(word_bpe, "INDEXED", 50)
    coder = word_bpe.TextCoder(word_bpe.public_vocabulary())
    assert [x for i in range(0, 40, 3) for x in coder.block(texts[i : i + 3])] == whole
