"""Registered queries of the timing operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sottovoce.operators import timing
from sottovoce.plans.profiles import FULL
from sottovoce.sources.fixtures import CUES_SQL, SHOTS_SQL, SIGNAL_SQL, SPEECH_SQL, cues, shots, signal, speech

EDGE = "file_id long, idx int"


def _edits(c: DataFrame) -> DataFrame:
    """Every seventh cue, with a time in it by rule."""
    at = F.col("start_ms") + F.floor((F.col("end_ms") - F.col("start_ms")) * (F.col("idx") % 10) / 10)
    return c.filter("idx % 7 = 3").select("file_id", "idx", at.cast("long").alias("at_ms"), (F.col("idx") % 2 == 0).alias("as_dialogue"), F.when(F.col("idx") % 2 == 0, "start_ms").otherwise("end_ms").alias("field"))


def merge_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.merge_fragments(cues(spark, sf_dir), 9000, 250)


def converge_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.converge(cues(spark, sf_dir), timing.limits_of(FULL))


def converge_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many limits each cue still misses after the rounds."""
    left = timing.converge(cues(spark, sf_dir), timing.limits_of(FULL)).filter("kind = 'unresolved'")
    return left.groupBy("file_id", "idx").agg(F.count("*").alias("n"))


def spotting_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cues(spark, sf_dir)
    return timing.spotting_suggestions(c, speech(c))


def apply_spotting(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cues(spark, sf_dir)
    return timing.apply_spotting(c, timing.spotting_suggestions(c, speech(c), detector="vad"))


def shot_change_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cues(spark, sf_dir)
    return timing.shot_change_suggestions(c, shots(c))


def resplit_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cues(spark, sf_dir)
    return timing.resplit_cues(c, {"limits": {"chars_per_line": 16, "max_lines": 1, "char_weights": {"cjk": 1.0, "other": 0.5}}}, speech(c))


def carry_to_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = cues(spark, sf_dir).select("file_id", F.col("idx").alias("origin_idx"), F.explode(F.sequence(F.lit(1), 1 + F.col("idx") % 2)).alias("k"))
    split = split.select("file_id", "origin_idx", (F.col("origin_idx") * 10 + F.col("k")).alias("idx"))
    notes = cues(spark, sf_dir).filter("idx % 3 = 0").select("file_id", "idx", F.explode(F.sequence(F.lit(1), 1 + F.col("idx") % 4)).alias("seq")).withColumn("note", F.concat(F.lit("n"), "seq"))
    return timing.carry_notes(split, notes)


def split_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cues(spark, sf_dir)
    return timing.split_at(c, _edits(c))


def merge_with_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cues(spark, sf_dir)
    return timing.merge_with_next(c, _edits(c))


def set_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cues(spark, sf_dir)
    return timing.set_points(c, _edits(c))


def line_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cues(spark, sf_dir).select("file_id", "idx", timing.toggle_dash(F.col("text")).alias("dashed"), timing.remove_line_breaks(F.col("text")).alias("joined"))


def off_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.off_recommendation(cues(spark, sf_dir), 1500, 6000)


def activity_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.activity_spans(signal(spark, sf_dir))


def complement_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signal(spark, sf_dir)
    totals = s.groupBy("media_id").agg((F.max("t_ms") + 32).alias("total_ms"))
    return timing.complement_spans(timing.activity_spans(s).withColumnRenamed("media_id", "media_id"), totals)


def outlier_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.outlier_spans(signal(spark, sf_dir), factor=1.0)


def waveform_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.waveform_peaks(signal(spark, sf_dir))


QUERIES = {f.__name__: f for f in (merge_fragments, converge_timing, converge_unresolved, spotting_suggestions, apply_spotting, shot_change_suggestions, resplit_cues, carry_to_split, split_at, merge_with_next, set_points, line_edits, off_recommendation, activity_spans, complement_spans, outlier_spans, waveform_peaks)}

_FRAME = "(1000.0::double / 23.976)"
_EDITS = "ed as (select file_id, idx, start_ms + ((end_ms - start_ms) * (idx % 10)) // 10 as at_ms, idx % 2 = 0 as as_dialogue, case when idx % 2 = 0 then 'start_ms' else 'end_ms' end as field from cues where idx % 7 = 3)"
_ACT = """act0 as (select media_id, i, lag(i) over (partition by media_id order by i) as was from signal where p >= 0.5),
act1 as (select *, sum(case when was is null or (i - was - 1) * 32 >= 250 then 1 else 0 end) over (partition by media_id order by i) as g from act0),
act as (select media_id, min(i) * 32 as start_ms, (max(i) + 1) * 32 as end_ms from act1 group by media_id, g having (max(i) + 1 - min(i)) * 32 >= 120)"""

#: Ends of sentences and clauses, as in the operator.
_RANK = r"case when regexp_matches(w, '[.?!。？！]$') then 0 when regexp_matches(w, '([,;、]|고|며|는데|지만|면서|다가|거나)$') then 1 else 2 end"


def _wc(x: str) -> str:
    from sottovoce.plans.check_queries import wc

    return wc(x)


def _resplit(capacity: int = 16, tolerance_ms: int = 400) -> str:
    head = "list_sum(list_transform(w[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(b[1:i - 1], lambda x: length(x))), 0)"
    return rf"""with recursive {CUES_SQL}, {SPEECH_SQL},
cut(file_id, origin_idx, k, rest, piece) as (select file_id, idx, 0, regexp_replace(text, '^\s+|\s+$', '', 'g'), null::varchar from cues where {_wc('text')} > {capacity} union all
  select file_id, origin_idx, k + 1, regexp_replace(substr(rest, spot::bigint + 1), '^\s+', ''), coalesce(left(rest, spot::bigint), rest) from
    (select *, list_sort(list_transform(list_filter(places, lambda c: {_wc('left(rest, c.p::bigint)')} <= {capacity}), lambda c: {{'r': c.r, 'off': abs(2 * c.p - length(rest)), 'p': c.p}}))[1].p as spot from
      (select *, case when {_wc('rest')} > {capacity} then list_transform(range(1, len(b) + 1), lambda i: {{'p': {head}, 'r': {_RANK.replace('(w,', '(w[i],')}}}) end as places from
        (select *, regexp_extract_all(rest, '\S+') as w, regexp_extract_all(rest, '\s+') as b from cut where rest is not null)))),
pc as (select file_id, origin_idx, k, piece, count(*) over c as n, greatest({_wc('piece')}, 0.5) as size, sum(greatest({_wc('piece')}, 0.5)) over c as total from cut where k > 0 window c as (partition by file_id, origin_idx)),
pt as (select p.*, c.start_ms, c.end_ms from pc p join cues c on p.file_id = c.file_id and p.origin_idx = c.idx where n > 1),
bd(file_id, origin_idx, k, bound) as (select file_id, origin_idx, 0, start_ms from pt where k = 1 union all
  select p.file_id, p.origin_idx, p.k, case when p.k = n then p.end_ms else round_even(bound + (p.end_ms - p.start_ms) * size / total, 0)::bigint end from bd join pt p on p.file_id = bd.file_id and p.origin_idx = bd.origin_idx and p.k = bd.k + 1),
q as (select file_id, a, floor((a + b) / 2.0)::bigint as middle from (select file_id, end_ms as a, lead(start_ms) over (partition by file_id order by start_ms, end_ms) as b from speech) where b is not null),
near as (select bd.file_id, origin_idx, k, min({{'d': abs(middle - bound), 'a': a, 'm': middle}}).m as silence from bd join q on bd.file_id = q.file_id and middle between bound - {tolerance_ms} and bound + {tolerance_ms} group by all),
bn as (select bd.*, silence, lead(bound) over (partition by bd.file_id, bd.origin_idx order by k) as following from bd left join near using (file_id, origin_idx, k)),
mv(file_id, origin_idx, k, moved) as (select file_id, origin_idx, 0, bound from bn where k = 0 union all
  select b.file_id, b.origin_idx, b.k, case when silence > moved and silence < following then silence else bound end from mv join bn b on b.file_id = mv.file_id and b.origin_idx = mv.origin_idx and b.k = mv.k + 1),
parts as (select p.file_id, p.origin_idx, p.k, x.moved as start_ms, y.moved as end_ms, piece as text from pt p join mv x on x.file_id = p.file_id and x.origin_idx = p.origin_idx and x.k = p.k - 1 join mv y on y.file_id = p.file_id and y.origin_idx = p.origin_idx and y.k = p.k
  union all select file_id, idx, 1, start_ms, end_ms, text from cues c where not exists (select 1 from pt where pt.file_id = c.file_id and pt.origin_idx = c.idx))
select file_id, (row_number() over (partition by file_id order by origin_idx, k))::int as idx, origin_idx, start_ms, end_ms, text from parts"""


ORACLE = {
    "resplit_cues": _resplit(),
    "merge_fragments": f"""with recursive {CUES_SQL}, o as (select *, row_number() over (partition by file_id order by idx) as rn from cues),
        m(file_id, rn, g, s, e) as (select file_id, rn, 1, start_ms, end_ms from o where rn = 1 union all
          select o.file_id, o.rn, case when j then g else g + 1 end, case when j then m.s else o.start_ms end, o.end_ms from (select m.*, o2.start_ms as ns, o2.end_ms as ne, (o2.start_ms - m.e between 0 and 250 and o2.end_ms - m.s <= 9000) as j from m join o o2 on o2.file_id = m.file_id and o2.rn = m.rn + 1) m join o on o.file_id = m.file_id and o.rn = m.rn + 1)
        select m.file_id, m.g::int as idx, min(o.start_ms) as start_ms, arg_max(o.end_ms, o.rn) as end_ms, trim(string_agg(o.text, ' ' order by o.rn)) as text from m join o on o.file_id = m.file_id and o.rn = m.rn group by m.file_id, m.g""",
    "spotting_suggestions": f"""with {CUES_SQL}, {SPEECH_SQL}, c as (select *, lead(start_ms) over (partition by file_id order by start_ms, idx) as nx from cues),
        v as (select c.file_id, c.idx, c.start_ms, c.end_ms, nx, min(s.start_ms) as voice, max(s.end_ms) as q0 from c left join speech s on s.file_id = c.file_id and s.end_ms > c.start_ms and s.start_ms < c.end_ms group by 1, 2, 3, 4, 5),
        w as (select *, voice - 3 * {_FRAME} as wi, least(least(q0, coalesce(nx, q0)) + 12 * {_FRAME}, coalesce(nx::double, 1e18)) as wo from v)
        select file_id, idx, 'start_ms' as field, start_ms as current, start_ms as suggested from w where voice is null
        union all select file_id, idx, 'start_ms', start_ms, round_even(wi, 0)::bigint from w where abs(start_ms - wi) > 4 * {_FRAME}
        union all select file_id, idx, 'end_ms', end_ms, round_even(wo, 0)::bigint from w where voice is not null and abs(end_ms - wo) > 4 * {_FRAME}""",
    "shot_change_suggestions": f"""with {CUES_SQL}, {SHOTS_SQL},
        a as (select c.file_id, c.idx, start_ms as current, s.pos, abs(start_ms - shot_ms) <= {_FRAME} as quiet, shot_ms as target, 'start_ms' as field from cues c join shots s on c.file_id = s.file_id and abs(start_ms - shot_ms) < 500
          union all select file_id, idx, end_ms, pos, abs(end_ms - t) <= {_FRAME}, t, 'end_ms' from (select c.file_id, c.idx, end_ms, pos, shot_ms, round_even(shot_ms - 2 * {_FRAME}, 0)::bigint as t from cues c join shots s on c.file_id = s.file_id) where abs(end_ms - shot_ms) < 500 or abs(end_ms - t) <= {_FRAME}),
        r as (select *, row_number() over (partition by field, file_id, idx order by pos) as rn from a) select file_id, idx, field, current, target as suggested from r where rn = 1 and not quiet""",
    "carry_to_split": f"with {CUES_SQL} select file_id, (idx * 10 + k)::int as idx, array_to_string(list_transform(range(1, idx % 4 + 2), lambda i: 'n' || i), ' / ') as note from (select file_id, idx, unnest(range(1, idx % 2 + 2)) as k from cues where idx % 3 = 0)",
    "split_at": f"""with {CUES_SQL}, {_EDITS}, j as (select c.*, at_ms, at_ms >= start_ms + 100 and at_ms <= end_ms - 100 as cut, greatest(1, least(length(text) - 1, round_even(length(text) * ((at_ms - start_ms) / greatest(end_ms - start_ms, 1)::double), 0)::int)) as mark from cues c left join ed on ed.file_id = c.file_id and ed.idx = c.idx),
        k as (select *, case when contains(substr(text, 1, mark + 1), ' ') and mark + 1 - position(' ' in reverse(substr(text, 1, mark + 1))) > 0 then mark + 1 - position(' ' in reverse(substr(text, 1, mark + 1))) else mark end as cutat from j),
        u as (select file_id, idx, 0 as pos, start_ms, case when cut then at_ms else end_ms end as end_ms, case when cut then regexp_replace(substr(text, 1, cutat), '^\\s+|\\s+$', '', 'g') else text end as text from k union all select file_id, idx, 1, at_ms, end_ms, regexp_replace(substr(text, cutat + 1), '^\\s+|\\s+$', '', 'g') from k where cut)
        select file_id, row_number() over (partition by file_id order by idx, pos)::int as idx, start_ms, end_ms, text from u""",
    "merge_with_next": f"""with {CUES_SQL}, {_EDITS}, j as (select c.*, as_dialogue, ed.idx is not null as joins from cues c left join ed on ed.file_id = c.file_id and ed.idx = c.idx),
        n as (select *, lead(end_ms) over w as ne, lead(text) over w as nt, coalesce(lag(joins) over w, false) as taken from j window w as (partition by file_id order by idx)),
        d as (select file_id, idx, start_ms, case when joins and nt is not null then ne else end_ms end as end_ms, case when joins and nt is not null then case when as_dialogue and not starts_with(text, '-') then '- ' else '' end || text || chr(10) || case when as_dialogue and not starts_with(nt, '-') then '- ' else '' end || nt else text end as text from n where not taken)
        select file_id, row_number() over (partition by file_id order by idx)::int as idx, start_ms, end_ms, text from d""",
    "set_points": f"""with {CUES_SQL}, {_EDITS}, n as (select *, lag(end_ms) over w as pe, lead(start_ms) over w as ns from cues window w as (partition by file_id order by idx)), j as (select n.*, at_ms, field from n left join ed on ed.file_id = n.file_id and ed.idx = n.idx)
        select file_id, idx, case when field = 'start_ms' and at_ms >= coalesce(pe, 0) and at_ms < end_ms - 100 then at_ms else start_ms end as start_ms, case when field = 'end_ms' and at_ms <= coalesce(ns, at_ms) and at_ms > start_ms + 100 then at_ms else end_ms end as end_ms from j""",
    "line_edits": f"""with {CUES_SQL}, l as (select *, string_split(text, chr(10)) as ls from cues) select file_id, idx, array_to_string(case when len(list_filter(ls, lambda x: trim(x) <> '' and ltrim(x) not like '-%')) = 0 then list_transform(ls, lambda x: ltrim(ltrim(ltrim(x), '-'))) else list_transform(ls, lambda x: case when trim(x) = '' then x else '- ' || ltrim(x) end) end, chr(10)) as dashed,
        array_to_string(list_filter(list_transform(ls, lambda x: trim(x)), lambda x: x <> ''), ' ') as joined from l""",
    "off_recommendation": f"with {CUES_SQL} select file_id, idx, end_ms - start_ms as duration_ms from cues where end_ms - start_ms < 1500 or end_ms - start_ms > 6000",
    "activity_spans": f"with {SIGNAL_SQL}, {_ACT} select * from act",
    "complement_spans": f"""with {SIGNAL_SQL}, {_ACT}, tot as (select media_id, max(t_ms) + 32 as total from signal group by 1), e as (select media_id, start_ms, end_ms from act union all select media_id, total, null from tot),
        l as (select e.media_id, coalesce(lag(coalesce(end_ms, total)) over (partition by e.media_id order by start_ms), 0) as a, least(start_ms, total) as b from e join tot on e.media_id = tot.media_id) select media_id, a as start_ms, b as end_ms from l where b > a""",
    "outlier_spans": f"""with {SIGNAL_SQL}, m as (select media_id, list_sort(list(p))[len(list(p)) // 2 + 1] as mid from signal group by 1 having count(*) >= 4), d as (select s.media_id, any_value(mid) as mid, list_sort(list(abs(p - mid)))[len(list(p)) // 2 + 1] as mad from signal s join m on s.media_id = m.media_id group by 1),
        h as (select s.media_id, i, i - row_number() over (partition by s.media_id order by i) as g from signal s join d on s.media_id = d.media_id where p > mid + 1.0 * case when mad = 0 then 1.0 else mad end) select media_id, (min(i) * 32)::bigint as start_ms, ((max(i) + 1) * 32)::bigint as end_ms from h group by media_id, g""",
    "waveform_peaks": f"with {SIGNAL_SQL} select media_id, (i // 128)::bigint as block, min(p)::double as low, max(p)::double as high from signal group by media_id, i // 128 having count(*) = 128",
}


def _converged() -> str:
    """Rounds of the limits of the sample profile (833 to 7,000 ms, 83 ms apart, 14 characters a second), cue by cue where one is squeezed."""
    steps = [f"r0 as (select file_id, (row_number() over (partition by file_id order by start_ms, idx))::int as pos, idx, start_ms as s, end_ms as e, {_wc('text')}::double as n from cues)"]
    for i in (1, 2, 3):
        want = "least(s1 + n * 1000 / 14.0::double, (s1 + 7000)::double, coalesce(edge::double, 1e18::double))"

        def one(source: str) -> str:
            pull = f"select *, case when squeezed and edge - greatest(coalesce(p + 83, 0), cut - 833) >= 833 then greatest(coalesce(p + 83, 0), cut - 833) end as pull from ({source})"
            first = f"select *, coalesce(pull, s) as s1, case when pull is not null then edge else held end as e1 from ({pull})"
            apart = f"select *, case when e1 > edge and e1 <= edge + 83 and edge - s1 >= 833 then edge else e1 end as e2 from ({first})"
            capped = f"select *, least(e2, s1 + 7000) as e3 from ({apart})"
            return f"select file_id, pos, idx, n, s, e, next_idx, cut, s1, e1, e2, e3, case when (e3 <= s1 or n / ((e3 - s1) / 1000.0::double) > 14) and {want} > e3 then round_even({want}, 0)::bigint else e3 end as e4 from ({capped})"

        steps += [
            f"w{i} as (select *, lead(s) over f - 83 as edge, lead(idx) over f as next_idx from r{i - 1} window f as (partition by file_id order by pos))",
            f"c{i} as (select *, case when e > edge + 83 then edge else e end as cut from w{i})",
            f"h{i} as (select *, coalesce(cut - s < 833 and s + 833 > edge, false) as squeezed, case when cut - s < 833 and not coalesce(s + 833 > edge, false) then s + 833 else cut end as held from c{i})",
            f"g{i} as ({one(f'select *, null::bigint as p from h{i} where not squeezed or pos = 1')} union all {one(f'select h{i}.*, g{i}.e4 as p from g{i} join h{i} on h{i}.file_id = g{i}.file_id and h{i}.pos = g{i}.pos + 1 and h{i}.squeezed')})",
            f"r{i} as (select file_id, pos, idx, s1 as s, e4 as e, n from g{i})",
        ]
    return f"with recursive {CUES_SQL}, {', '.join(steps)}, last as (select *, lead(s) over f as next_s, lead(idx) over f as next_idx, e - s as d, case when e > s then n / ((e - s) / 1000.0::double) else 'inf'::double end as v from r3 window f as (partition by file_id order by pos))"


def _changes() -> str:
    moves = [("end_ms", "e", "cut", "'다음 자막(#' || next_idx || ')과 겹쳐 아웃점을 당김'"), ("start_ms", "s", "s1", "'최소 표시 시간 확보(인점 당김)'"), ("end_ms", "cut", "e1", "'최소 표시 시간 확보'"), ("end_ms", "e1", "e2", "'자막 간 간격 83ms 확보'"), ("end_ms", "e2", "e3", "'최대 표시 시간 초과'"), ("end_ms", "e3", "e4", "'읽기 속도 확보'")]
    return " union all ".join(f"select file_id, 'change', idx, null, null, '{field}', {was}, {now}, {why} from g{i} where {was} <> {now}" for i in (1, 2, 3) for field, was, now, why in moves)


_LEFT = """select file_id, 'unresolved', idx, null, null, null, null, null, '최소 표시 시간 833ms를 확보하지 못했습니다(현재 ' || d || 'ms) — 앞뒤 자막과 병합을 검토하세요' from last where d < 833
        union all select file_id, 'unresolved', idx, null, null, null, null, null, '다음 자막(#' || next_idx || ')과 여전히 겹칩니다' from last where e > next_s
        union all select file_id, 'unresolved', idx, null, null, null, null, null, '읽기 속도 ' || printf('%.1f', v) || ' CPS — 시간으로는 더 못 줄입니다. 글자를 줄이거나 자막을 나누세요' from last where v > 14"""
ORACLE["converge_timing"] = f"{_converged()} select file_id, 'cue' as kind, idx, s as start_ms, e as end_ms, null::varchar as field, null::bigint as before, null::bigint as after, null::varchar as reason from last union all {_changes()} union all {_LEFT}"
ORACLE["converge_unresolved"] = f"{_converged()}, u as (select file_id, idx, (case when d < 833 then 1 else 0 end) + (case when e > next_s then 1 else 0 end) + (case when v > 14 then 1 else 0 end) as n from last) select file_id, idx, n::bigint as n from u where n > 0"
