"""Registered queries of the language operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sottovoce.functions.text import TAGS
from sottovoce.operators import language
from sottovoce.sources.fixtures import CUES_SQL, cues, dialogue, table

GLOSSARY = [("the", "그"), ("not", "아니"), ("and", "그리고")]
TARGETS = ["[사라] 가요", "안 가요", "다섯 개 있어", "그리고 갔어", "모르겠어"]
COMMON = ["the", "and", "of", "to", "in", "it", "is", "on", "by", "as", "be", "or", "that", "this", "for", "are", "was", "with"]


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, i = F.col("text"), F.col("idx")
    source = F.concat(F.when(i % 3 == 0, "not ").when(i % 3 == 1, "5 ").otherwise("Dr. "), t)
    words = F.split(source, " ")
    back = F.array_join(F.filter(words, lambda w, k: k % 4 != 3), " ")
    c = cues(spark, sf_dir)
    return c.select("file_id", "idx", source.alias("source"), F.element_at(F.array(*map(F.lit, TARGETS)), i % 5 + 1).alias("target"), back.alias("back"))


_PAIRS = f"""with {CUES_SQL}, p0 as (select file_id, idx, case idx % 3 when 0 then 'not ' when 1 then '5 ' else 'Dr. ' end || text as source, [{', '.join(f"'{t}'" for t in TARGETS)}][idx % 5 + 1] as target from cues),
p as (select *, array_to_string(list_filter(string_split(source, ' '), lambda w, k: (k - 1) % 4 <> 3), ' ') as back from p0)"""


def translation_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.translation_flags(_pairs(spark, sf_dir))


def glossary_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.glossary_misses(_pairs(spark, sf_dir), spark.createDataFrame(GLOSSARY, "term string, korean string")).withColumn("missed", F.array_join("missed", ", "))


def _benchmark_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of the benchmark as terms."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("term")).filter("term <> ''").distinct()
    return words.select("term", F.when(F.length("term") % 2 == 0, "그").otherwise(F.concat(F.lit("말"), "term")).alias("korean"))


def glossary_misses_of_many_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.glossary_misses(_pairs(spark, sf_dir), _benchmark_terms(spark, sf_dir)).withColumn("missed", F.array_join("missed", ", "))


def glossary_misses_of_many_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.glossary_misses(_pairs(spark, sf_dir), _benchmark_terms(spark, sf_dir), whole_words=True).withColumn("missed", F.array_join("missed", ", "))


def translation_flags_with_glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.translation_flags(_pairs(spark, sf_dir), spark.createDataFrame(GLOSSARY, "term string, korean string"), ("glossary",))


def back_translation_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.back_translation_overlap(_pairs(spark, sf_dir))


def back_translation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.back_translation_summary(back_translation_overlap(spark, sf_dir))


def worst_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.worst_n(back_translation_overlap(spark, sf_dir), 3).select("file_id", "idx", "score", "rank")


def revision_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir).select("file_id", "idx", F.col("source").alias("first"), F.col("back").alias("before"), F.when(F.col("idx") % 4 == 1, F.concat("back", F.lit(" "), "back")).otherwise(F.col("back")).alias("after"))
    return language.revision_drift(p)


def stage_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cues(spark, sf_dir)
    return language.stage_diff(c, c.withColumn("text", F.regexp_replace("text", "  +", " ")))


def timecode_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cues(spark, sf_dir)
    return language.timecode_lock(c, c.withColumn("end_ms", F.col("end_ms") + F.when(F.col("idx") % 50 == 7, 1).otherwise(0)))


def protect_and_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = cues(spark, sf_dir).select("file_id", "idx", language.protect_markup(F.col("text")).alias("p"))
    return p.select("file_id", "idx", "p.head", "p.body", "p.tail", language.restore_markup(F.lower("p.body"), F.col("p")).alias("restored"))


def prompt_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.prompt_batches(cues(spark, sf_dir))


def parse_numbered_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cues(spark, sf_dir).withColumn("batch", F.col("file_id"))
    reply = c.groupBy("batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: F.concat(x["idx"].cast("string"), F.lit(". "), x["text"])), "\n").alias("reply"))
    return language.parse_numbered_reply(reply, c.select("batch", "idx"))


def translate_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches through a completion function that answers with upper case, read back by number."""
    b = language.prompt_batches(cues(spark, sf_dir)).select("file_id", F.concat_ws(":", "file_id", "batch").alias("batch"), "first_idx", "last_idx", "lines")
    asked = language.complete(b, str.upper)
    expected = b.select("batch", F.explode(F.sequence("first_idx", "last_idx")).alias("idx"))
    return language.parse_numbered_reply(asked, expected)


def platform_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.platform_guess(cues(spark, sf_dir)).withColumn("evidence", F.array_join("evidence", "; "))


def kind_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.kind_guess(cues(spark, sf_dir))


def profile_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.profile_mismatch(cues(spark, sf_dir), "netflix", "sdh")


def cast_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.cast_extract(dialogue(spark, sf_dir))


def cast_cross_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.when(F.col("idx") % 3 == 0, F.concat("text", F.lit(" assistant 님 user 씨"))).otherwise(F.col("text"))
    return language.cast_cross_reference(dialogue(spark, sf_dir).withColumn("text", F.replace(named, F.lit("\n"), F.lit(" "))))


def acronyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.acronyms(cues(spark, sf_dir))


def proper_nouns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.proper_nouns(cues(spark, sf_dir), COMMON)


def bookmark_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes by rule on the cues, classified and counted by file."""
    notes = F.element_at(F.array(*map(F.lit, ["인점 2프레임", "<표기> 의미", "띄어쓰기", "번역이 어색", "좋아요"])), F.col("idx") % 5 + 1)
    return cues(spark, sf_dir).select("file_id", language.bookmark_kind(notes).alias("kind")).groupBy("file_id", "kind").agg(F.count("*").alias("n"))


def term_research(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = proper_nouns(spark, sf_dir).select("term").distinct()
    g = spark.createDataFrame([("Outi", "아우티")], "term string, korean string")
    low = terms.select(F.lower("term").alias("source"), F.concat(F.lit("사전 "), "term").alias("korean"), F.length("term").alias("pos")).filter("pos % 3 = 0")
    links = terms.select(F.col("term").alias("title"), F.concat("term", F.when(F.length("term") % 2 == 0, " (영화)").otherwise("")).alias("target"))
    return language.term_research(terms, g, low, links)


def term_research_of_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of the benchmark, looked up in a glossary, a dictionary with two spellings, and links of which some are ambiguous."""
    terms = _benchmark_terms(spark, sf_dir).select("term")
    glossary = spark.createDataFrame(GLOSSARY, "term string, korean string")
    third, even = F.length("term") % 3 == 0, F.length("term") % 2 == 0
    upper = terms.filter(third).select(F.upper("term").alias("source"), F.concat(F.lit("대문자 "), "term").alias("korean"), F.lit(1).alias("pos"))
    dictionary = upper.unionByName(terms.filter(third & even).select(F.col("term").alias("source"), F.concat(F.lit("사전 "), "term").alias("korean"), F.lit(2).alias("pos")))
    links = terms.select(F.col("term").alias("title"), F.concat("term", F.when(even, " (영화)").otherwise("")).alias("target"))
    return language.term_research(terms, glossary, dictionary, links)


QUERIES = {f.__name__: f for f in (term_research_of_words, translation_flags, translation_flags_with_glossary, glossary_misses, glossary_misses_of_many_terms, glossary_misses_of_many_words, back_translation_overlap, back_translation_summary, worst_n, revision_drift, stage_diff, timecode_lock, protect_and_restore, prompt_batches, parse_numbered_reply, translate_round_trip, platform_guess, kind_guess, profile_mismatch, cast_extract, cast_cross_reference, acronyms, proper_nouns, bookmark_kinds, term_research)}

_STOP = "[" + ", ".join(f"'{w}'" for w in language.STOPWORDS) + "]"


def _content(c: str) -> str:
    body = rf"lower(regexp_replace(regexp_replace({c}, '{TAGS}', '', 'g'), '[\[(][^)\]]*[\])]', ' ', 'g'))"
    for a, b in language.CONTRACTIONS.items():
        body = "replace({}, '{}', '{}')".format(body, a.replace("'", "''"), b)
    return f"list_filter(regexp_extract_all({body}, '[a-z0-9'']+'), lambda w: not list_contains({_STOP}, w))"


_BT = f"{_PAIRS}, w as (select file_id, idx, {_content('source')} as want, {_content('back')} as got from p), b as (select file_id, idx, list_filter(want, lambda x: not list_contains(got, x)) as miss, want from w), bt as (select file_id, idx, case when len(want) > 0 then 1.0::double - len(miss) / len(want)::double end as score, array_to_string(miss, ',') as missing from b)"
_N, _M = (rf"len(regexp_extract_all({c}, '[\[(]([^)\]]+)[\])]'))" for c in ("source", "target"))
_TB = rf"regexp_replace(target, '[\[(]([^)\]]+)[\])]', ' ', 'g')"
_KN = "(" + " or ".join(f"contains({_TB}, '{w}')" for w in language.KO_NEGATION) + ")"
_EN = language.EN_NEGATION.replace("'", "''")
_DG = r"regexp_extract_all(source, '(\d+(?:[.,]\d+)*)')"
_MISS = "array_to_string(list_sort(list_filter([" + ", ".join(f"case when {{}} and not contains(target, '{k}') then '{t} -> {k}' end" for t, k in GLOSSARY) + "], lambda x: x is not null)), ', ')"
_TERMS = "g as (select distinct term, case when length(term) % 2 = 0 then '그' else '말' || term end as korean from (select unnest(regexp_extract_all(lower(text), '[a-z]+')) as term from benchmark))"
ORACLE = {
    "translation_flags": f"""{_PAIRS} select file_id, idx, 'speaker' as kind, '화자 표시·효과음이 ' || {_N} || '개에서 ' || {_M} || case when {_M} < {_N} then '개로 줄었습니다' else '개로 늘었습니다' end as reason, true as certain from p where {_N} <> {_M}
        union all select file_id, idx, 'negation', '원문에 부정이 있는데 번역에서 보이지 않습니다', false from p where regexp_matches(regexp_replace(source, '[À-ɏ]', 'x', 'g'), '{_EN}') and not {_KN}
        union all select file_id, idx, 'number', '원문의 숫자(' || array_to_string({_DG}[1:3], ', ') || ')가 번역에서 보이지 않습니다', false from p where len({_DG}) > 0 and not regexp_matches({_TB}, '{language.KO_NUMBER}')""",
    "glossary_misses_of_many_terms": f"{_PAIRS}, {_TERMS} select file_id, idx, array_to_string(list_sort(list(distinct term || ' -> ' || korean)), ', ') as missed from p join g on contains(lower(source), term) and not contains(target, korean) group by 1, 2",
    "glossary_misses_of_many_words": f"{_PAIRS}, {_TERMS}, w as (select distinct file_id, idx, target, unnest(regexp_extract_all(lower(source), '[\\p{{L}}\\p{{N}}_]+')) as term from p) select file_id, idx, array_to_string(list_sort(list(distinct term || ' -> ' || korean)), ', ') as missed from w join g using (term) where not contains(target, korean) group by 1, 2",
    "glossary_misses": f"{_PAIRS}, g as (select file_id, idx, {_MISS.format(*[f'''contains(lower(source), '{t}')''' for t, _ in GLOSSARY])} as missed from p) select * from g where missed <> ''",
    "translation_flags_with_glossary": f"{_PAIRS}, g as (select file_id, idx, {_MISS.format(*[rf'''regexp_matches(source, '(?i)\b{t}\b')''' for t, _ in GLOSSARY])} as missed from p) select file_id, idx, 'glossary' as kind, '통일표 표기를 쓰지 않았습니다: ' || missed as reason, true as certain from g where missed <> ''",
    "back_translation_overlap": f"{_BT} select * from bt",
    "back_translation_summary": f"{_BT} select file_id, count(*) as total, avg(score) as mean, list_sort(list(score))[count(*) // 2 + 1] as median, min(score) as least, count(*) filter (score < 0.5) as below_half from bt where score is not null group by 1",
    "worst_n": f"{_BT}, r as (select file_id, idx, score, row_number() over (partition by file_id order by score, idx)::int as rank from bt where score is not null) select * from r where rank <= 3",
    "revision_drift": f"""{_PAIRS}, q as (select file_id, idx, source as first, back as before, case when idx % 4 = 1 then back || ' ' || back else back end as after from p),
        o as (select *, (trim(before) <> '' and (length(after) / greatest(length(before), 1)::double > 1.5 or length(after) / greatest(length(before), 1)::double < 1 / 1.5::double)) or (trim(first) <> '' and (length(after) / greatest(length(first), 1)::double > 1.5 or length(after) / greatest(length(first), 1)::double < 1 / 1.5::double)) as rejected from q) select file_id, idx, case when rejected then before else after end as text, rejected from o""",
    "stage_diff": f"with {CUES_SQL} select file_id, idx, text as was, regexp_replace(text, '  +', ' ', 'g') as text from cues where text <> regexp_replace(text, '  +', ' ', 'g')",
    "timecode_lock": f"with {CUES_SQL} select file_id, idx, start_ms, end_ms, 'before' as side from cues where idx % 50 = 7 union all select file_id, idx, start_ms, end_ms + 1, 'after' from cues where idx % 50 = 7",
    "prompt_batches": f"""with {CUES_SQL}, r as (select *, row_number() over w - 1 as rn, array_to_string(coalesce(list(text) over (partition by file_id order by idx rows between 3 preceding and 1 preceding), []), ' | ') as before from cues window w as (partition by file_id order by idx))
        select file_id, (rn // 12)::bigint as batch, min(idx) as first_idx, max(idx) as last_idx, arg_min(before, rn) as context, string_agg(idx || '. ' || replace(text, chr(10), ' '), chr(10) order by rn) as lines from r group by file_id, rn // 12""",
    "kind_guess": rf"""with {CUES_SQL}, s as (select file_id, string_split(regexp_replace(text, '{TAGS}', '', 'g'), chr(10)) as ls, text from cues), g as (select file_id, count(*) as n, sum(len(list_filter(ls, lambda x: regexp_full_match(trim(ltrim(trim(x), '-')), '[\[(]([^\])]+)[\])]'))) + case when regexp_matches(ls[1], '^\s*-?\s*([\[(])([^\])]+)([\])])\s*(\S.*)$') then 1 else 0 end + case when contains(text, '♪') then 1 else 0 end)::bigint as marks from s group by 1)
        select file_id, marks, case when marks >= 3 then 'sdh' when marks = 0 and n >= 30 then 'translation' end as kind from g""",
    "cast_extract": "with d as (select conv_id as file_id, (turn + 1)::int as idx, role as label, text from conversations) select file_id, label, count(*) as lines, min(idx) as first_idx from d where trim(string_split(substr(text, 1, 40), chr(10))[1]) <> '' group by 1, 2",
    "acronyms": rf"with {CUES_SQL}, a as (select file_id, idx, unnest(list_filter(regexp_split_to_array(text, '[^\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z]{{2,6}}'))) as term from cues) select file_id, term, count(*) as n, min(idx) as first_idx from a where term not in ('I', 'A', 'OK') group by 1, 2",
    "bookmark_kinds": f"with {CUES_SQL} select file_id, ['timecode', 'notation', 'notation', 'translation', 'other'][idx % 5 + 1] as kind, count(*) as n from cues group by 1, 2",
}

_MARK = r"(?:\{\\[^}]*\}|</?[a-zA-Z][^>]*>|♪+)"
_HEAD = r"^\s*-?\s*([\[(])([^\])]+)([\])])\s*(\S.*)$"
#: What speaks for which platform: (condition, ((platform, points), ...), reason).
_SIGNS = [
    ("contains(s, '음 소거')", (("disney", 2), ("coupang", 2)), "[음 소거 효과음]"), ("regexp_matches(s, 'O[가-힣]|[가-힣]O')", (("disney", 2),), "대문자 O 삐 처리"), (r"regexp_matches(s, '\*[가-힣]|[가-힣]\*')", (("netflix", 1), ("coupang", 1)), "별표 삐 처리"),
    ("contains(s, '…')", (("netflix", 1), ("disney", 1)), "전각 말줄임표"), ("contains(s, '...')", (("coupang", 1), ("disney", 1)), "점 셋 말줄임표"),
]


def _given(platform: str, points: int, why: str, source: str) -> str:
    return f"select file_id, '{platform}' as platform, {points} as points, {why} as why from {source}"


_EVIDENCE = " union all ".join([
    _given("coupang", 3, "'소괄호 화자명 (' || inside || ')'", "hl where opener = '('"), _given("netflix", 3, "'슬래시로 나눈 화자명 [' || inside || ']'", "hl where opener = '[' and contains(inside, '/')"),
    _given("disney", 3, "'서술형 화자명 [' || inside || ']'", r"hl where opener = '[' and not contains(inside, '/') and regexp_matches(inside, '(이|가)\s+\S+(로|게)$')"),
    _given("disney", 3, "'음악 효과음 안의 음표 [' || x || ']'", "mu where contains(x, '♪')"), *[_given(p, 1, "'음표 없는 음악 효과음 [' || x || ']'", "mu where not contains(x, '♪')") for p in ("netflix", "coupang")],
    *[_given(p, n, f"'{why}'", f"st where {when}") for when, given, why in _SIGNS for p, n in given],
])
_GUESS = rf"""with {CUES_SQL}, st as (select file_id, regexp_replace(text, '{TAGS}', '', 'g') as s from cues),
    hl as (select file_id, regexp_extract(x, '{_HEAD}', 1) as opener, regexp_extract(x, '{_HEAD}', 2) as inside from (select file_id, unnest(string_split(s, chr(10))) as x from st) where regexp_matches(x, '{_HEAD}')),
    mu as (select * from (select file_id, unnest(regexp_extract_all(s, '\[([^\]]*)\]', 1)) as x from st) where regexp_matches(x, '음악|곡|연주')), ev as ({_EVIDENCE})
    select file_id, platform, sum(points)::bigint as score, array_to_string(list_sort(list(distinct why)), '; ') as evidence from ev group by 1, 2"""
ORACLE |= {
    "platform_guess": _GUESS,
    "profile_mismatch": f"""with kg as ({ORACLE["kind_guess"]}), pg as ({_GUESS}), sc as (select file_id, max({{'score': score, 'top': platform}}) as b, coalesce(max(score) filter (platform = 'netflix'), 0) as own from pg group by 1),
        w as (select kg.file_id, case when kind is not null and kind <> 'sdh' then 'kind: ' || kind when b.top <> 'netflix' and b.score - own >= 4 then 'platform: ' || b.top end as warning from kg left join sc on kg.file_id = sc.file_id) select * from w where warning is not null""",
    "term_research_of_words": f"with {_TERMS} select term, case when term = 'the' then '그' when term = 'not' then '아니' when term = 'and' then '그리고' when length(term) % 3 = 0 then case when length(term) % 2 = 0 then '사전 ' else '대문자 ' end || term when length(term) % 2 = 1 then term end as korean, case when term in ('the', 'not', 'and') then 'glossary' when length(term) % 3 = 0 then 'dictionary' when length(term) % 2 = 1 then 'link' end as origin from g",
    "protect_and_restore": rf"""with {CUES_SQL}, h as (select file_id, idx, text, regexp_extract(text, '^((?:\s*{_MARK}\s*)*)', 1) as h from cues), r as (select *, substr(text, length(h) + 1) as rest from h), t as (select *, regexp_extract(rest, '((?:\s*{_MARK}\s*)*)$', 1) as t from r),
        b as (select file_id, idx, regexp_replace(h, '\s+', '', 'g') as head, regexp_replace(regexp_replace(regexp_replace(left(rest, length(rest) - length(t)), '{_MARK}', ' ', 'g'), '\s+', ' ', 'g'), '^ | $', '', 'g') as body, regexp_replace(t, '\s+', '', 'g') as tail from t)
        select *, head || case when ends_with(head, '♪') then ' ' else '' end || lower(body) || case when starts_with(tail, '♪') then ' ' else '' end || tail as restored from b""",
    "parse_numbered_reply": rf"""with {CUES_SQL}, rp as (select file_id as batch, string_split(string_agg(idx || '. ' || text, chr(10) order by idx), chr(10)) as ls from cues group by 1), l0 as (select batch, unnest(ls) as line, unnest(range(len(ls))) as pos from rp),
        l1 as (select *, case when regexp_matches(line, '^\s*\d+\s*[.):]') then try_cast(regexp_extract(line, '^\s*(\d+)', 1) as int) end as n from l0), l2 as (select l1.*, c.idx as known from l1 left join cues c on c.file_id = batch and c.idx = n),
        l3 as (select batch, pos, last_value(known ignore nulls) over w as idx, last_value(case when known is not null then pos end ignore nulls) over w as since, regexp_replace(case when known is not null then regexp_replace(line, '^\s*\d+\s*[.):]\s*', '') else line end, '^\s+|\s+$', '', 'g') as said from l2 window w as (partition by batch order by pos rows unbounded preceding)),
        l4 as (select *, max(since) over (partition by batch, idx) as latest from l3 where idx is not null and said <> '') select batch, idx, string_agg(said, chr(10) order by pos) as text from l4 where since = latest group by 1, 2""",
}
