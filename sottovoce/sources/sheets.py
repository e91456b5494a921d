"""Cast sheets as people fill them in, cast documents, and evaluations of a title."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sottovoce.functions.text import trimmed

#: The headers of a cast sheet, cells that stand for nothing, spellings of the levels of politeness.
HEADERS = {"speaker": "이름", "tone": "말투 지정", "gender": "성별", "age": "나이", "job": "직업", "career": "경력", "traits": "성격", "photo": "사진", "photo_licence": "사진 라이선스", "origin": "근거"}
RELATIONS, LINES, UNKNOWN = "관계", "대사 수", "확인 필요"
PLACEHOLDERS = ["확인 필요", "정해 주세요", "-", "—", ""]
TONES = {"합니다체": ["합니다체", "하십시오체", "격식체", "격식"], "해요체": ["해요체", "비격식", "두루높임"], "반말": ["반말", "해체", "낮춤", "해라체", "평어"]}
SHOWN = {"gender": "성별", "age": "나이", "job": "직업", "career": "경력", "family": "가족"}


def tone_of(word: Column) -> Column:
    """The level that a word names; empty for unknown words."""
    bare = F.replace(trimmed(word), F.lit(" "), F.lit(""))
    out = F.lit("")
    for level, spellings in TONES.items():
        out = F.when(bare.isin(spellings), level).otherwise(out)
    return out


def parse_cast_sheets(files: DataFrame) -> DataFrame:
    """One row for each named person of (path, value), tab-separated texts whose columns are found by their headers, in
    any order: (path, row, speaker, tone, gender, age, job, career, traits, photo, photo_licence, origin, relations, lines).

    Empty cells and placeholders are empty; of two columns of one header the later one counts.
    """
    body = F.regexp_replace(F.regexp_replace("value", "^\\ufeff", ""), "\r\n?", "\n")
    rows = F.filter(F.split(body, "\n", -1), lambda x: trimmed(x) != "")
    cells = files.select("path", F.transform(F.split(F.get(rows, F.lit(0)), "\t", -1), trimmed).alias("head"), F.posexplode(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))).alias("row", "line"))
    cells = cells.withColumn("cells", F.split("line", "\t", -1))

    def cell(name: str) -> Column:
        back = F.array_position(F.reverse("head"), name)
        value = trimmed(F.get("cells", (F.size("head") - back).cast("int")))
        return F.when((back == 0) | value.isNull() | value.isin(PLACEHOLDERS), "").otherwise(value)

    pair = lambda x: F.struct(trimmed(F.substring_index(x, ":", 1)).alias("key"), trimmed(F.when(F.contains(x, F.lit(":")), F.regexp_replace(x, "^[^:]*:", "")).otherwise("")).alias("value"))
    pairs = F.filter(F.transform(F.split(cell(RELATIONS), ";", -1), pair), lambda p: (p["key"] != "") & (p["value"] != ""))
    # The last of equal keys counts.
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    values = [(tone_of(cell(h)) if c == "tone" else cell(h)).alias(c) for c, h in HEADERS.items()]
    return cells.select("path", "row", *values, F.map_from_entries(last).alias("relations"), F.coalesce(cell(LINES).try_cast("int"), F.lit(0)).alias("lines")).filter("speaker <> ''")


def read_cast_sheets(spark: SparkSession, folder: str) -> DataFrame:
    """People of all ``.tsv`` files of a folder."""
    files = spark.read.option("pathGlobFilter", "*.tsv").text(folder, wholetext=True)
    return parse_cast_sheets(files.select(F.col("_metadata.file_path").alias("path"), "value"))


def cast_markdown(people: DataFrame, relations: DataFrame, untagged: DataFrame, sheet: DataFrame | None = None) -> DataFrame:
    """(file_id, markdown): one document a file from ``cast_profile``, ``cross_reference``, ``untagged_dialogue`` and, where
    there is one, a filled-in sheet (file_id, speaker, the columns of HEADERS, family, relations)."""
    given = ["gender", "age", "job", "career", "family", "traits", "photo", "photo_licence", "origin"]
    known = people.withColumnRenamed("label", "speaker")
    if sheet is None:
        known = known.select("*", *[F.lit("").alias(c) for c in given], F.create_map().cast("map<string,string>").alias("relations"))
    else:
        there = [F.coalesce(F.col(c), F.lit("")).alias(c) if c in sheet.columns else F.lit("").alias(c) for c in given]
        extra = sheet.select("file_id", "speaker", *there, "relations")
        known = known.join(extra, ["file_id", "speaker"], "left").fillna("", given)
    order = Window.partitionBy("file_id", "speaker").orderBy(F.col("mentions").desc(), "other")
    met = relations.withColumn("nth", F.row_number().over(order)).groupBy("file_id", "speaker").agg(F.array_sort(F.collect_list(F.struct("nth", "other", "mentions", "calls"))).alias("met"))
    known = known.join(met, ["file_id", "speaker"], "left")

    def line(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"- {label}: "), value)

    def or_unknown(c: str) -> Column:
        return F.when(F.col(c) == "", UNKNOWN).otherwise(F.col(c))

    decided = F.col("formal") + F.col("polite")
    tone = F.concat(F.when(F.col("formal") >= F.col("polite"), "합니다체").otherwise("해요체"), F.lit(" (합니다체 "), "formal", F.lit(" / 해요체 "), "polite", F.lit(", 합니다체 "), F.rint(F.col("formal") / decided * 100).cast("int"), F.lit("%, 유보 "), "undecided", F.lit(")"))
    calls = F.filter("met", lambda m: F.size(m["calls"]) > 0)
    related = F.array_join(F.transform(F.map_entries("relations"), lambda r: F.concat(r["key"], F.lit(": "), r["value"])), "; ")
    empty = F.filter(F.array(*[F.when(F.col(c) == "", h) for c, h in (("gender", "성별"), ("age", "나이"), ("job", "직업"), ("career", "경력"), ("traits", "성격"))]), lambda x: x.isNotNull())
    lines = [
        F.concat(F.lit("## "), "speaker"), F.lit(""),
        F.when(F.col("photo") != "", F.concat(F.lit("!["), "speaker", F.lit("]("), "photo", F.lit(")\n\n사진 출처: "), "photo", F.lit(" · 라이선스: "), or_unknown("photo_licence"), F.lit("\n"))),
        F.concat(F.lit("- 대사 "), "lines", F.lit("개 · 처음 나온 자막 #"), "first_idx"), line("말투", F.when(decided > 0, tone).otherwise("확정된 종결어미가 없어 말투를 재지 못했습니다")),
        F.when(F.size(calls) > 0, line("부르는 호칭", F.array_join(F.transform(calls, lambda m: F.concat(m["other"], F.lit("에게 '"), F.array_join(m["calls"], "/"), F.lit("'"))), ", "))),
        F.when(F.size("met") > 0, line("함께 나오는 인물", F.array_join(F.transform(F.slice("met", 1, 5), lambda m: F.concat(m["other"], F.lit("("), m["mentions"].cast("string"), F.lit(")"))), ", "))),
        line("관계", F.when(F.coalesce(related, F.lit("")) == "", UNKNOWN).otherwise(related)), *[F.when(F.col(c) != "", line(h, F.col(c))) for c, h in SHOWN.items()],
        line("성격", or_unknown("traits")), F.when(F.size(empty) > 0, line("아직 빈 항목", F.array_join(empty, ", "))), line("근거", or_unknown("origin")), F.lit(""),
    ]
    person = F.concat_ws("\n", *lines)
    parts = known.groupBy("file_id").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("first_idx", "speaker", person.alias("text")))), lambda x: x["text"]).alias("people"))
    head = F.concat(F.lit("# 캐릭터 분석\n\n인물 "), "n", F.lit("명 · 화자 표시가 붙은 자막 "), "tagged", F.lit("개"), F.when(F.col("untagged") > 0, F.concat(F.lit("\n화자를 모르는 자막 "), "untagged", F.lit("개는 집계에서 뺐습니다"))).otherwise(""), F.lit("\n"))
    return parts.join(untagged, "file_id").select("file_id", F.concat_ws("\n", head, F.array_join("people", "\n"), F.lit("---\n\n성격 칸은 위키 소개 문단을 그대로 옮긴 것입니다. 요약이므로 읽고 고쳐 쓰십시오.")).alias("markdown"))


#: Title files in a folder, and bytes of texts that are read together.
FOLDER_FILES, READ_BYTES = 1000, 4 << 20


def _open_folder(path: str) -> str | None:
    """The path of a folder that tasks can open by themselves, as on a disk that all share; None for other stores."""
    scheme, _, rest = path.partition(":") if ":/" in path else ("file", "", path)
    return re.sub("^/+", "/", rest) if scheme == "file" else None


def write_titles(texts: DataFrame, path: str, text: str) -> None:
    """One file for each title of (file_id, text); all of them appear when the write is done, or none.

    On a shared disk tasks write files in folders of a thousand beside ``path``, which get its name at the end: a writer, a
    checksum and a commit for each title cost far more than its text. Other stores get a folder for each title from Spark.
    """
    texts = texts.select("file_id", F.col(text).alias("value"))
    folder = _open_folder(path)
    if folder is None:
        texts.repartition("file_id").write.partitionBy("file_id").text(path)
        return
    if os.path.exists(folder):
        raise FileExistsError(folder)
    unfinished = f"{folder.rstrip('/')}-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            for file_id, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = f"{unfinished}/{part:06d}-{n // FOLDER_FILES:06d}"
                if n % FOLDER_FILES == 0:
                    os.makedirs(at, exist_ok=True)
                # A task that is run again writes the same files; a file appears whole.
                name = f"{at}/{'null' if file_id is None else file_id}.txt"
                with open(f"{name}.{os.getpid()}", "w", encoding="utf-8", newline="") as out:
                    out.write(value or "")
                os.replace(out.name, name)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    os.makedirs(unfinished)
    texts.mapInArrow(write, "n long").agg(F.sum("n")).collect()
    os.rename(unfinished, folder)


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, value) of what ``write_titles`` wrote."""
    folder = _open_folder(path)
    if folder is None:
        return spark.read.text(path, wholetext=True).select(F.col("file_id").cast("long").alias("file_id"), F.regexp_replace("value", r"\n\z", "").alias("value"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.column(0).to_pylist():
                ids, values, size = [], [], 0
                for entry in os.scandir(f"{folder}/{at}"):
                    stem, _, ending = entry.name.rpartition(".")
                    if ending != "txt":  # left by a task that was lost
                        continue
                    with open(entry.path, encoding="utf-8", newline="") as text:
                        values.append(text.read())
                    ids.append(None if stem == "null" else int(stem))
                    size += len(values[-1])
                    if size >= READ_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(values, pa.string())], ["file_id", "value"])
                        ids, values, size = [], [], 0
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(values, pa.string())], ["file_id", "value"])

    folders = sorted(os.listdir(folder))  # one name for a thousand titles
    names = spark.createDataFrame([(f,) for f in folders], "folder string").repartition(max(1, len(folders)))
    return names.mapInArrow(read, "file_id long, value string")
