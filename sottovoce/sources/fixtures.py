"""Cue tables derived by rule from the driver's tables, with integer arithmetic only.

A line too long for a cue is cut into successive cues, so every character of every text is in one, and defects are put
before or after a text, not in its place; turns are whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Longest cue, in code points, before defects are planted.
LONGEST = 60
#: What defects put before and after a text, by number: none, 15 by the cue's place, the label's other form, and the rarer ones.
FREQUENT = [
    ("[김 경위] ", ""), ("[문이 쾅 닫히는 소리] ", ""), ("♪", " ♪"), ("", "..."), ("-", ""), ("3천 불을 ", ""), ("아홉 시에 ", ""), ("열다섯 명 ", ""), ("<i>", "</i>"), ("민수: ", ""), ("(철수) [작게] ", ""),
    ("", ""), ("그러나, ", " ~"), ("J.F.K. ", "?!"), ('"', '"'),
]
RARE = [
    ("", ""), ("— ", ""), ("[", ""), ("♪ la la ♪\n", ""), ("[잔잔한 음악] ", ""), ("5㎏ ", ""), ("", " [탁 소리]"), ("[쾅\n소리] ", ""), ("[철수와 영희] ", ""), ("[철수]\n", ""), ("자막: 홍길동 ", ""), ("…", ""),
    ("아주 길고 긴 윗줄이 여기에 있습니다\n짧은 줄 ", ""), ("민수 씨, 10 ~ 20분 ", ""), ("할\n수 있다 ", ""), ("이런 O같은 일이 ", ""), ("", " ** **"), ("여러\n번 보고 ", ""),
]
DEFECTS = [("", ""), *FREQUENT, ("[경위] ", ""), *RARE[1:]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _timed(lines: DataFrame) -> DataFrame:
    """(file_id, idx, start_ms, end_ms, text) from (file_id, idx, t, s): durations and leads follow ids and lengths."""
    dur = F.lit(300) + (F.length("t") * 37 + F.col("idx") * 101) % 8200
    lead = (F.col("idx") * 7919 + F.col("file_id") * 104729) % 1500 - 300
    # Of the plain text only the length is needed; it is taken before rows are shuffled, so that one text goes with them.
    lines = lines.select("file_id", "idx", (lead + dur).alias("step"), dur.alias("dur"), "s")
    end = F.sum("step").over(Window.partitionBy("file_id").orderBy("idx")) + 1000
    return lines.select("file_id", "idx", (end - F.col("dur")).cast("long").alias("start_ms"), end.cast("long").alias("end_ms"), F.col("s").alias("text"))


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of ``documents`` in cues of at most ``LONGEST`` code points, with planted defects by number."""
    docs = table(spark, sf_dir, "documents")
    parts = F.transform(F.split("text", "\n", -1), lambda x: F.regexp_extract_all(F.trim(x), F.lit(f"(?s).{{1,{LONGEST}}}"), F.lit(0)))
    said = F.filter(F.transform(F.flatten(parts), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    lines = docs.select(F.col("doc_id").alias("file_id"), F.posexplode(said).alias("pos", "t"))
    lines = lines.select("file_id", (F.col("pos") + 1).cast("int").alias("idx"), "t")
    t, idx = F.col("t"), F.col("idx")
    # Every sixteenth cue is plain or has a rarer defect, dealt by file; a label is written in two ways.
    rare = (F.floor(idx / 16) + F.col("file_id")) % len(RARE)
    kind = F.when(idx % 16 != 0, idx % 16 + F.when((idx % 16 == 1) & (idx % 5 >= 2), 15).otherwise(0)).otherwise(F.when(rare > 0, rare + 16).otherwise(0))
    lines = lines.withColumn("kind", kind.cast("int"))
    before, after = (F.get(F.array(*[F.lit(d[i]) for d in DEFECTS]), F.col("kind")) for i in (0, 1))
    said = F.when(F.col("kind") == 12, F.replace(t, F.lit(" "), F.lit("  "))).otherwise(t)
    lines = lines.withColumn("s0", F.concat(before, said, after))
    broken = F.when((idx % 3 == 0) & (idx % 16 != 0) & (F.length("s0") > 24), F.concat(F.substring("s0", 1, 12), F.lit("\n"), F.expr("substring(s0, 13)"))).otherwise(F.col("s0"))
    return _timed(lines.withColumn("s", broken))


def _sql_list(i: int) -> str:
    return "[" + ", ".join("'" + d[i].replace("\n", "' || chr(10) || '") + "'" for d in DEFECTS) + "]"


CUES_SQL = f"""lines0 as (select doc_id as file_id, list_filter(list_transform(flatten(list_transform(string_split(text, chr(10)), lambda x: regexp_extract_all(trim(x), '(?s).{{1,60}}'))), lambda p: trim(p)), lambda p: length(p) > 0) as ps from documents),
lines1 as (select file_id, unnest(ps) as t, unnest(range(1, len(ps) + 1))::int as idx from lines0),
lines2 as (select *, case when idx % 16 <> 0 then idx % 16 + case when idx % 16 = 1 and idx % 5 >= 2 then 15 else 0 end when (idx // 16 + file_id) % {len(RARE)} > 0 then 16 + (idx // 16 + file_id) % {len(RARE)} else 0 end as kind,
  300 + (length(t) * 37 + idx * 101) % 8200 as dur, (idx * 7919 + file_id * 104729) % 1500 - 300 as lead from lines1),
lines3 as (select * exclude (t), ({_sql_list(0)})[kind + 1] || case when kind = 12 then replace(t, ' ', '  ') else t end || ({_sql_list(1)})[kind + 1] as s from lines2),
cues as (select file_id, idx, (sum(lead + dur) over (partition by file_id order by idx) + 1000 - dur)::bigint as start_ms,
  (sum(lead + dur) over (partition by file_id order by idx) + 1000)::bigint as end_ms,
  case when idx % 3 = 0 and idx % 16 <> 0 and length(s) > 24 then substr(s, 1, 12) || chr(10) || substr(s, 13) else s end as text from lines3)"""


def second_track(cues: DataFrame) -> DataFrame:
    """A coarser track over the same files: pairs of cues as one, shifted by rule."""
    g = cues.filter(F.col("idx") % 11 != 0).groupBy("file_id", (F.floor((F.col("idx") - 1) / 2) + 1).cast("int").alias("g"))
    b = g.agg(F.min("start_ms").alias("s"), F.max("end_ms").alias("e"), F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.min("text").alias("text"))
    start = F.col("s") + (F.col("file_id") * 13 + F.col("lo") * 31) % 200 - 100
    end = F.col("e") + (F.col("hi") * 17) % 300 - 150
    return b.select("file_id", F.col("g").alias("idx"), start.cast("long").alias("start_ms"), end.cast("long").alias("end_ms"), "text").filter("end_ms > start_ms")


CUES_B_SQL = """cues_b as (select * from (select file_id, ((idx - 1) // 2 + 1)::int as idx, (min(start_ms) + (file_id * 13 + min(idx) * 31) % 200 - 100)::bigint as start_ms,
  (max(end_ms) + (max(idx) * 17) % 300 - 150)::bigint as end_ms, min(text) as text from cues where idx % 11 <> 0 group by file_id, (idx - 1) // 2 + 1) where end_ms > start_ms)"""


def dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues with a speaker label from ``conversations``."""
    talk = table(spark, sf_dir, "conversations")
    s = F.concat(F.lit("["), "role", F.lit("] "), F.col("text"))
    return _timed(talk.select(F.col("conv_id").alias("file_id"), (F.col("turn") + 1).cast("int").alias("idx"), F.col("text").alias("t"), s.alias("s")))


DIALOGUE_SQL = """dia as (select conv_id as file_id, (turn + 1)::int as idx, '[' || role || '] ' || text as text from conversations)"""


def numbered(rows: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """(key, i): rows numbered from 0 by key in order of time and tie. Each hour of a key is numbered by itself and
    starts at the total of the hours before, so that only hourly totals come together by key."""
    hour = F.coalesce(F.floor(F.unix_micros(F.col(time).cast("timestamp")) / 3600000000), F.lit(-(1 << 62))).cast("long")
    rows = rows.select(key, time, tie, hour.alias("hour"))
    before = F.sum("n").over(Window.partitionBy(key).orderBy("hour").rowsBetween(Window.unboundedPreceding, -1))
    first = rows.groupBy(key, "hour").agg(F.count("*").alias("n")).select(key, "hour", F.coalesce(before, F.lit(0)).alias("first"))
    within = rows.select(key, "hour", (F.row_number().over(Window.partitionBy(key, "hour").orderBy(time, tie)) - 1).alias("within"))
    return within.join(first, [key, "hour"]).select(key, (F.col("first") + F.col("within")).cast("long").alias("i"))


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A probability series per media id from ``events``, 32 ms apart."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("media_id"), "ts", "event_id")
    s = numbered(e, "media_id", "ts", "event_id")
    p = ((F.floor(F.col("i") / (5 + F.col("media_id") % 7)) * 7919 + F.col("media_id")) % 10) / 10.0
    return s.select("media_id", "i", (F.col("i") * 32).alias("t_ms"), p.alias("p"))


SIGNAL_SQL = """sig0 as (select user_id % 20 as media_id, row_number() over (partition by user_id % 20 order by ts, event_id) - 1 as i from events),
signal as (select media_id, i::bigint as i, (i * 32)::bigint as t_ms, ((i // (5 + media_id % 7)) * 7919 + media_id) % 10 / 10.0 as p from sig0)"""


def speech(cues: DataFrame) -> DataFrame:
    s = cues.filter(F.col("idx") % 4 != 0).select("file_id", (F.col("start_ms") + (F.col("idx") * 53) % 400 - 150).alias("start_ms"), (F.col("end_ms") + (F.col("idx") * 29) % 300 - 200).alias("end_ms"))
    return s.filter("end_ms > start_ms")


SPEECH_SQL = """speech as (select * from (select file_id, start_ms + (idx * 53) % 400 - 150 as start_ms, end_ms + (idx * 29) % 300 - 200 as end_ms from cues where idx % 4 <> 0) where end_ms > start_ms)"""


def shots(cues: DataFrame) -> DataFrame:
    return cues.filter(F.col("idx") % 5 == 0).select("file_id", (F.col("start_ms") + (F.col("idx") * 37) % 900 - 450).alias("shot_ms"), F.col("idx").alias("pos"))


SHOTS_SQL = """shots as (select file_id, start_ms + (idx * 37) % 900 - 450 as shot_ms, idx as pos from cues where idx % 5 = 0)"""
