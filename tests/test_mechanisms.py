"""Operators that work in rounds, blocks and by pointers, against plain walks."""

import random
from collections import defaultdict

import pytest
from sottovoce.functions.similar import similarity
from sottovoce.functions.split import pieces
from sottovoce.operators import timing, tracks

CUES = "file_id long, idx int, start_ms long, end_ms long, text string"


def track(rng, files, n, step=900):
    rows = []
    for f in range(files):
        at = 0
        for i in range(1, rng.randint(1, n) + 1):
            at += rng.randint(0, step)
            said = " ".join(rng.choice(["go", "on", "then", "no", "yes", "가자", "x1"]) for _ in range(rng.randint(0, 5)))
            rows.append((f, i, at, at + rng.choice([0, 300, 900, 2500]), said))
            at += rng.choice([0, 100, 700])
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_matching_in_rounds_equals_the_walk_in_reference_order(spark, seed):
    rng = random.Random(seed)
    ours, truth = track(rng, 6, 40, 400), track(rng, 7, 40, 400)
    want = set()
    for f in range(7):
        used, mine = set(), sorted((r for r in ours if r[0] == f), key=lambda r: (r[2], r[1]))
        for t in sorted((r for r in truth if r[0] == f), key=lambda r: (r[2], r[1])):
            best, top = None, 0.0
            for o in mine:
                if o[1] in used or o[3] < t[2] - 2000 or o[2] > t[3] + 2000:
                    continue
                score = similarity(o[4], t[4]) + (0.3 if min(o[3], t[3]) > max(o[2], t[2]) else 0.0)
                if score > top:
                    best, top = o[1], score
            if best is not None and top >= 0.3:
                used.add(best)
                want.add((f, best, t[1], round(top, 9)))
            else:
                want.add((f, None, t[1], None))
        want |= {(f, o[1], None, None) for o in mine if o[1] not in used}
    got = tracks.match_to_reference_track(spark.createDataFrame(ours, CUES), spark.createDataFrame(truth, CUES)).collect()
    assert len(got) == len(want) and {(r.file_id, r.our_idx, r.truth_idx, None if r.score is None else round(r.score, 9)) for r in got} == want


def test_matching_of_long_equal_texts(spark):
    """More than 200 words: frequent ones do not count, so equal texts are not alike beyond doubt."""
    text = "a b " * 150
    (r,) = tracks.match_to_reference_track(spark.createDataFrame([(1, 1, 0, 1000, text)], CUES), spark.createDataFrame([(1, 1, 0, 1000, text)], CUES)).collect()
    assert r.score == pytest.approx(similarity(text, text) + 0.3)


def merged(cues, most, gap):
    out = []
    for _, _, start, end, text in cues:
        if out and 0 <= start - out[-1][1] <= gap and end - out[-1][0] <= most:
            out[-1] = [out[-1][0], end, f"{out[-1][2]} {text}".strip()]
        else:
            out.append([start, end, text])
    return [(i, *x) for i, x in enumerate(out, 1)]


@pytest.mark.parametrize(("most", "gap", "back"), [(4000, 250, False), (9000, 250, True), (600, 700, False), (0, 250, False)])
def test_merging_by_pointers_equals_the_walk(spark, most, gap, back):
    rng = random.Random(most)
    rows = []
    for f in range(5):
        at = 0
        for i in range(1, 120):
            at += rng.choice([0, 0, 100, 250, 251, 700] if f else [0, 100, 200])
            length = rng.choice([100, 400, 1500, 6000]) if not (back and rng.random() < 0.1) else -900
            rows.append((f, i, at, at + length, rng.choice(["say", " it", "", "out "])))
            at += length
    got = defaultdict(list)
    for r in timing.merge_fragments(spark.createDataFrame(rows, CUES), most, gap).orderBy("file_id", "idx").collect():
        got[r.file_id].append((r.idx, r.start_ms, r.end_ms, r.text))
    for f in range(5):
        mine = [r for r in rows if r[0] == f]
        assert got[f] == (merged(mine, most, gap) if most else [r[1:] for r in mine])


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_runs_of_samples_are_the_same_in_any_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(timing, "BLOCK", block)
    rng = random.Random(block)
    on = [(m, i) for m in range(4) for i in range(120) if rng.random() < 0.15 * (m + 1)]
    for least in (1, 3, 8):
        want = set()
        for m in range(4):
            mine = [i for k, i in on if k == m]
            starts = [i for n, i in enumerate(mine) if not n or i - mine[n - 1] - 1 >= least]
            ends = [i for n, i in enumerate(mine) if n + 1 == len(mine) or mine[n + 1] - i - 1 >= least]
            want |= {(m, a, b) for a, b in zip(starts, ends, strict=True)}
        assert {tuple(r) for r in timing._runs(spark.createDataFrame(on, "media_id int, i long"), least).collect()} == want


def cut(text, most, wide, other):
    """The rule word for word: recursion on what is left."""
    import re

    def size(x):
        total = 0.0
        for c in re.sub(r"<[^>]+>|[\r\n]", "", x):
            total += wide if "가" <= c <= "힣" else other
        return total

    text = text.strip()
    if not text or size(text) <= most:
        return [text] if text else []
    found = [(0, m.start()) for m in re.finditer(r"(?<=[.?!。？！])\s+", text)]
    found += [(1, m.end(1)) for m in re.finditer(r"([,;、]|고|며|는데|지만|면서|다가|거나)\s+", text)]
    found += [(2, m.start()) for m in re.finditer(r"\s+", text)]
    for _, at in sorted(found, key=lambda f: (f[0], abs(f[1] - len(text) / 2))):
        if text[:at].strip() and text[at:].strip() and size(text[:at].strip()) <= most:
            return [text[:at].strip(), *cut(text[at:], most, wide, other)]
    return [text]


def test_pieces_of_long_texts():
    assert pieces("안녕하세요. 오늘 날씨가 참 좋습니다.", 12, 1.0, 0.5)[0] == "안녕하세요."
    assert pieces("가" * 40, 16, 1.0, 0.5) == ["가" * 40] and pieces(" 짧다 ", 16, 1.0, 0.5) == ["짧다"] and pieces(" ", 5) == []
    # A colon and an ellipsis end nothing; an ending does.
    assert pieces("하나: 둘 그리고 셋 넷", 9, 1.0, 0.5) == cut("하나: 둘 그리고 셋 넷", 9, 1.0, 0.5) == ["하나: 둘 그리고", "셋 넷"]
    rng = random.Random(2)
    words = ["그러니까", "말은,", "있는데", "가고", "끝.", "왜?", "a:", "b…", "<i>옛날", "이야기</i>", "<font size=3>큰", "글</font>", "x;", "가나다라마바사아자차카타"]
    for _ in range(400):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\n"]) for _ in range(rng.randint(1, 14)))
        for weights in ((1.0, 0.5), (1.0, 0.3)):
            assert pieces(text, 12, *weights) == cut(text, 12, *weights)


def test_resplit_keeps_what_it_cannot_cut_and_moves_bounds_into_silence(spark):
    rows = [(1, 1, 0, 6000, "안녕하세요. 오늘 날씨가 참 좋습니다."), (1, 2, 7000, 9000, " 짧은 줄 "), (1, 3, 9000, 9900, f" {'가' * 40} "), (2, 1, 0, 10, None)]
    profile = {"limits": {"chars_per_line": 12, "max_lines": 1, "char_weights": {"cjk": 1.0, "other": 0.5}}}
    speech = spark.createDataFrame([(1, 0, 1800), (1, 2600, 6000)], "file_id long, start_ms long, end_ms long")
    out = timing.resplit_cues(spark.createDataFrame(rows, CUES), profile, speech).orderBy("file_id", "idx").collect()
    assert [(r.idx, r.origin_idx, r.text) for r in out if r.file_id == 1] == [(1, 1, "안녕하세요."), (2, 1, "오늘 날씨가 참 좋습니다."), (3, 2, " 짧은 줄 "), (4, 3, f" {'가' * 40} ")]
    assert out[0].end_ms == out[1].start_ms == 2200 and [r.text for r in out if r.file_id == 2] == [None]


def walked(segments, told, good_enough=0.6, window=6, least=0.3):
    """The walk along both texts of one file."""
    out, free = [], 0
    for _, _, start, end, said in segments:
        ratios = [similarity(said, line) for line in told[free : free + window]] or [0.0]
        best = ratios.index(max(ratios))
        if ratios[best] >= least:
            out += [(start, start, line, "script", 0.0, tracks.NO_SOUND + tracks.SKIPPED) for line in told[free : free + best]]
            weak = f"{tracks.UNLIKE[0]}{round(ratios[best] * 100)}{tracks.UNLIKE[1]}{said.strip()[:40]}"
            free += best + 1
            out.append((start, end, told[free - 1], "script", ratios[best], "" if ratios[best] >= good_enough else weak))
        else:
            out.append((start, end, said, "transcript", max(ratios), tracks.NO_LINE + (tracks.HERE + told[free].strip()[:40] if free < len(told) else "")))
    at = segments[-1][3] if segments else 0
    return out + [(at, at, line, "script", 0.0, tracks.NO_SOUND) for line in told[free:]]


@pytest.mark.parametrize("size", [4, 256])
def test_alignment_in_blocks_equals_the_walk(spark, monkeypatch, size):
    monkeypatch.setattr(tracks, "SEGMENTS", size)
    rng = random.Random(size)
    words = ["go", "on", "then", "no", "yes", "가자", "x1", "river", "mill", "bridge", "day", "home"]
    segments, script = [], []
    for f in range(6):
        told = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(rng.choice([0, 1, 30, 60]))]
        said = []
        for line in told:
            for _ in range(rng.choice([0, 1, 1, 1, 2])):
                said.append(" ".join(w for w in line.split() if rng.random() < 0.8))
            if rng.random() < 0.15:
                said.append("nothing like it at all")
        said = said if f != 3 else []
        segments += [(f, i, i * 1000, i * 1000 + 700, t) for i, t in enumerate(said, 1)]
        script += [(f, i, t) for i, t in enumerate(told, 1)]
    got = defaultdict(list)
    aligned = tracks.align_transcript(spark.createDataFrame(segments, CUES), spark.createDataFrame(script, "file_id long, pos int, text string"))
    for r in aligned.orderBy("file_id", "pos").collect():
        got[r.file_id].append((r.start_ms, r.end_ms, r.text, r.source, r.similarity, r.note))
    for f in range(6):
        assert got[f] == walked([s for s in segments if s[0] == f], [t for g, _, t in script if g == f])
