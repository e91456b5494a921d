"""The pipeline on awkward documents: every stage's decisions against plain versions of them."""

import hashlib
import random
import re
import zlib
from array import array
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from sottovoce.llm import packing
from sottovoce.llm.common import scratch
from tokenizers import Tokenizer

from .test_search_ops import classes_of
from .test_text_ops import line_rule, quality


def test_stages_take_effect(spark):
    rng = random.Random(6)
    say = lambda n: " ".join(" ".join(f"w{rng.randint(0, 99999)}" for _ in range(9)) + "." for _ in range(n))
    body = [say(12) for _ in range(40)]
    passage = [say(1), say(1), say(1)]
    rows = [(i, b, "en", f"s{i % 3}", len(b)) for i, b in enumerate(body)]
    rows.append((100, "\n".join([say(8), *passage, say(8)]), "en", "s0", 0))
    rows.append((101, "\n".join([say(8), *passage, say(8)]), "en", "s1", 0))
    rows.append((102, body[3] + " tail word.", "en", "s1", 0))  # a near copy
    rows += [(103, "too short.", "en", "s0", 0), (104, None, None, None, None), (105, "same words here " * 60, "en", "s2", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = scratch(stage(spark, docs, ""), "t")
        kept[name] = docs.collect()
        assert name == "packing" or docs.columns == columns
    ids = {n: {r.doc_id for r in rs} for n, rs in kept.items()}
    assert ids["quality rules"] == {*range(40), 100, 101, 102}
    texts = {r.doc_id: r.text for r in kept["line dedup"]}
    assert all(p in texts[100] and p not in texts[101] for p in passage)
    assert ids["near dedup"] == ids["line dedup"] - {102}
    assert ids["mixing"] == ids["near dedup"] and len(kept["mixing"]) >= len(kept["near dedup"])
    assert ids["packing"] == ids["mixing"] and sum(r.length for r in kept["packing"]) == sum({(r.doc_id): r.doc_tokens * sum(x.doc_id == r.doc_id for x in kept["mixing"]) for r in kept["packing"]}.values())


# Plain versions of the stages: each takes and gives rows (doc_id, text, lang, source, n_chars).


def plain_clean(rows):
    out = []
    for r in rows:
        n, chars, _, _, repeated = quality(r[1])
        lines = (r[1] or "").split("\n")
        stay = [x for x in lines if line_rule(x) is None]
        lost = sum(len(re.sub("[ \t\x0b\x0c\r]", "", x)) for x in lines if line_rule(x))
        if n >= 50 and 100 * repeated <= 50 * n and lost <= 0.5 * chars:
            out.append((r[0], "\n".join(stay), r[2], r[3], len("\n".join(stay))))
    return out


def plain_line_dedup(rows):
    windows = {}
    for i, text, *_ in sorted(set(r[:2] for r in rows)):
        lines = text.split("\n")
        for pos in range(len(lines) - 2):
            if any(x.strip(" \t\x0b\x0c\r") for x in lines[pos : pos + 3]):
                windows.setdefault(tuple(lines[pos : pos + 3]), []).append((i, text, pos))
    gone, own = defaultdict(set), defaultdict(set)
    for first, *later in windows.values():
        for i, text, pos in later:
            gone[i, text] |= {pos, pos + 1, pos + 2}
            if first[:2] == (i, text):
                own[i, text] |= {first[2], first[2] + 1, first[2] + 2}
    out = []
    for r in rows:
        cut = gone[r[:2]] - own[r[:2]]
        text = "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in cut) if cut else r[1]
        if not cut or text.strip(" \t\n\x0b\x0c\r"):
            out.append((r[0], text, r[2], r[3], len(text)))
    return out


def plain_near_dedup(rows):
    classes = classes_of([r[:2] for r in rows], 5, 80)
    return [r for r in rows if classes[r[0]][1] == r[0]]


def plain_mixing(rows, limit=1.5):
    """Every source has one block here, so a partial pass is a prefix of the source in the order of its keys."""
    words = {id(r): len(re.findall(r"[^\x20\x09-\x0D]+", r[1])) for r in rows}
    total = defaultdict(int)
    for r in rows:
        total[r[3]] += words[id(r)]
    most, least = max(total.values()), min(total.values())
    low, high = 0.0, 1.0
    for _ in range(48):
        low, high = (low, (low + high) / 2) if (least / most) ** ((low + high) / 2 - 1) <= limit else ((low + high) / 2, high)
    x = round(0.0 if most / least <= limit else high, 6)
    out = []
    for source, n in total.items():
        repeats = round((n / most) ** (x - 1), 6)
        passes, mine = int(repeats), [r for r in rows if r[3] == source]
        out += mine * passes
        rest, upto = n * round(repeats * 1000000) // 1000000 - passes * n, 0
        for r in sorted(mine, key=lambda r: hashlib.md5(f"17:doc:{passes + 1}:{r[0]}".encode()).hexdigest()):
            upto += words[id(r)]
            if upto <= rest:
                out.append(r)
    return out


def crawled():
    """Documents of three sources with junk lines, repeated passages, near copies, and rows that no stage may trip over."""
    rng = random.Random(16)
    say = lambda n: " ".join(f"w{rng.randint(0, 9999)}" for _ in range(n)) + "."
    passages = [[say(8), say(8), say(8), say(8)] for _ in range(3)]
    rows = []
    for i in range(120):
        lines = [say(rng.randint(25, 30) if i % 7 == 6 else rng.randint(6, 14)) for _ in range(rng.randint(3, 14))]
        if i % 3 == 0:
            lines[1:1] = passages[i % 9 // 3][: rng.randint(3, 4)]
        if i % 4 == 0:
            lines += ["home | menu | login", "no closing mark here", "All rights reserved by us", ""]
        if i % 7 == 0 and rows:
            # One word in every three lines differs, so no passage repeats, but most shingles do.
            lines = [re.sub(r"w\d+", "other", x, count=1) if k % 3 == 2 else x for k, x in enumerate(rows[-1][1].split("\n"))]
        rows.append((i, "\n".join(lines), "en", "big" if i % 5 else f"small{i % 2}", 0))
    rows += [(200, None, None, None, None), (201, "", "en", "big", 0), (202, "short.", "en", "big", 6), (203, "same words here. " * 60, "en", "big", 0), (204, "\n".join(say(9) for _ in range(900)), "en", "big", 1)]
    return rows


@pytest.mark.parametrize("which", ["whole", "empty"])
def test_every_stage_equals_its_plain_version(spark, which):
    rows = crawled() if which == "whole" else []
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    plain = {"quality rules": plain_clean, "line dedup": plain_line_dedup, "near dedup": plain_near_dedup, "mixing": plain_mixing if rows else list}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch(stage(spark, docs, ""), "stage")
        before, rows = len(rows), plain[name](rows)
        assert Counter(tuple(r) for r in docs.collect()) == Counter(rows), name
        assert which == "empty" or len(rows) != before or name == "line dedup"
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    library = Tokenizer.from_file(packing.public_vocabulary())
    library.encode_special_tokens = True
    ids = {r[0]: [*library.encode(r[1], add_special_tokens=False).ids, 0] for r in rows}
    copies, taken, at = Counter(r[0] for r in rows), defaultdict(Counter), defaultdict(list)
    for p in pieces:
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert len(part) == p.length and p.doc_tokens == len(ids[p.doc_id]) and zlib.crc32(array("I", part).tobytes()) == p.ids_crc32
        taken[p.doc_id].update(range(p.start, p.start + p.length))
        at[p.sequence_id].append((p.offset, p.length))
    assert all(taken[i] == Counter({k: n for k in range(len(ids[i]))}) for i, n in copies.items())
    for places in at.values():
        places.sort()
        assert all(a + n == b for (a, n), (b, _) in zip([(0, 0), *places], places, strict=False)) and sum(n for _, n in places) <= 1024
