"""Jobs: compositions of operators over whole catalogues, without an action in between."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sottovoce.functions.text import weighted_chars
from sottovoce.operators import checks, files, fixes, language, names, proofread, reference_data, timing, tracks
from sottovoce.sources.scratch import scratch


def _of_files(cues: DataFrame, profile: Mapping[str, Any], cast: DataFrame | None = None, job: Mapping[str, Any] | None = None) -> dict[str, DataFrame]:
    """Findings of the checks that look at a whole file, by name."""
    rules = files.job_rules(profile, job)
    by_file = {"gap_too_short": files.gap_too_short(cues, profile), "speaker_id_inconsistent": files.speaker_id_inconsistent(cues), "position_collides_with_forced_narrative": files.position_collides_with_forced_narrative(cues, rules)}
    if (profile.get("text") or {}).get("ellipsis_consistency_required"):
        by_file["ellipsis_style_inconsistent"] = files.ellipsis_style_inconsistent(cues)
    if (profile.get("delivery") or {}).get("first_cue_not_at_zero"):
        by_file["first_event_at_zero"] = files.first_event_at_zero(cues)
    if (tone := files.formality_inconsistent(cues, cast)) is not None:
        by_file["formality_inconsistent"] = tone
    return by_file


def lint_job(cues: DataFrame, profile: Mapping[str, Any], cast: DataFrame | None = None, job: Mapping[str, Any] | None = None) -> DataFrame:
    """Findings of all checks, of single cues and of whole files, as (file_id, idx, check, line_no, detail)."""
    out = checks.findings(cues, profile)
    for name, found in _of_files(cues, profile, cast, job).items():
        out = out.unionByName(found.withColumn("check", F.lit(name)).select(*out.columns))
    return out


def lint_counts(cues: DataFrame, profile: Mapping[str, Any], cast: DataFrame | None = None, job: Mapping[str, Any] | None = None) -> DataFrame:
    """(file_id, cues, findings): how many cues a file has, and how many findings ``lint_job`` gives; files without any included."""
    rows = checks.counted(cues, profile).select("file_id", F.lit(1).alias("cue"), "n")
    for found in _of_files(cues, profile, cast, job).values():
        rows = rows.unionByName(found.select("file_id", F.lit(0).alias("cue"), F.lit(1).alias("n")))
    return rows.groupBy("file_id").agg(F.sum("cue").alias("cues"), F.sum("n").alias("findings"))


def correct_and_check(cues: DataFrame, profile: Mapping[str, Any], proofread: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Proofread, fix, check, in this order: the findings describe the final text.

    Positions are settled before texts, and the fixed cues are made once: each check looks at them.
    """
    cues = proofread(cues) if proofread else cues
    if fixes.moves_positions(profile):
        cues = scratch(cues, "unplaced", "zstd")  # looked at for what collides, and to move it
        cues = files.apply_positions(cues, files.position_suggestions(cues, files.job_rules(profile)))
    fixed = scratch(fixes.fix_text(cues, profile).drop("applied"), "fixed", "zstd")
    return fixed, lint_job(fixed, profile)


def proofread_job(cues: DataFrame, correct: proofread.Corrector) -> tuple[DataFrame, DataFrame]:
    """(cues with the corrected dialogue, findings K01 and K02) of a caller's corrector."""
    answered = proofread.corrected(cues, correct)
    return proofread.rebuild(cues, answered.filter("before <> after")), proofread.proofread_findings(answered)


def corpus_job(all_tracks: DataFrame, source_lang: str, target_lang: str, limits: Mapping[str, Any] | None = None) -> dict[str, DataFrame]:
    """Pairs, statistics, flags and evidence from (file_id, track, lang, kind, idx, start_ms, end_ms, text); of one language's tracks a plain one goes before a descriptive one."""
    rank = F.dense_rank().over(Window.partitionBy("file_id", "lang").orderBy((F.col("kind") == "sdh").cast("int"), "track"))
    chosen = all_tracks.withColumn("r", rank).filter("r = 1").drop("r")
    source, target = (chosen.filter(F.col("lang") == lang) for lang in (source_lang, target_lang))
    pairs = tracks.pair_tracks(source, target)
    return {"pairs": pairs, "summary": tracks.pair_summary(pairs), "stats": tracks.track_stats(target), "flags": tracks.track_flags(target, limits), "evidence": tracks.profile_evidence(target)}


def draft_job(segments: DataFrame, profile: Mapping[str, Any], script: DataFrame | None = None, speech: DataFrame | None = None, fps: float = 23.976) -> DataFrame:
    """Transcript segments to timed cues: align or merge, re-split, spot, converge."""
    if script is None:
        cues = timing.merge_fragments(segments)
    else:
        cues = tracks.align_transcript(segments, script).select("file_id", F.col("pos").alias("idx"), "start_ms", "end_ms", "text")
    cues = timing.resplit_cues(cues, profile, speech).drop("origin_idx")
    # A text goes along with its cue, so that it is not looked up again after each step.
    if speech is not None:
        cues = timing.spotted(cues, speech, fps, detector="vad", kept=("text",))
    return timing.converge(cues, timing.limits_of(profile, fps), kept=("text",)).filter("kind = 'cue'").select("file_id", "idx", "start_ms", "end_ms", "text")


def evaluate_job(ours: DataFrame, truth: DataFrame) -> DataFrame:
    """Error statistics by file of the matched pairs, with the counts of missing and extra cues."""
    match = _with_differences(tracks.matched_tracks(ours, truth)).drop("our_text", "truth_text")
    return tracks.timing_error_stats(match, matched=_paired(), also={n: c for n, c in _counts().items() if n in ("missing", "extra")})


def _paired() -> Column:
    return F.col("our_idx").isNotNull() & F.col("truth_idx").isNotNull()


def _with_differences(match: DataFrame) -> DataFrame:
    return match.select("*", F.col("truth_idx").alias("idx"), (F.col("our_s") - F.col("truth_s")).alias("start_diff"), (F.col("our_e") - F.col("truth_e")).alias("end_diff"))


def _counts() -> dict[str, Column]:
    return {"ours": F.count("our_idx"), "truth": F.count("truth_idx"), "missing": F.count_if(F.col("our_idx").isNull()), "extra": F.count_if(F.col("truth_idx").isNull())}


def evaluation(ours: DataFrame, truth: DataFrame, fps: float = 23.976, note: str = "") -> dict[str, DataFrame]:
    """What an evaluation leaves: ``pairs`` with texts and similarities to 3 decimals, a ``summary`` by file, and both as one JSON text a file.

    Each is one aggregation, at most, over the matched tracks.
    """
    both = _with_differences(tracks.matched_tracks(ours, truth))
    pair = [F.col("truth_idx"), F.col("our_idx").alias("ours_idx"), F.col("start_diff"), F.col("end_diff"), F.col("truth_text"), F.col("our_text").alias("ours_text"), F.bround(F.coalesce("score", F.lit(0.0)), 3).alias("similarity")]
    half = lambda c, digits: F.bround(F.percentile(F.when(_paired(), c), 0.5), digits)
    middle = {f"{n}_duration": half(F.col(f"{n}_e") - F.col(f"{n}_s"), 0).cast("long") for n in ("our", "truth")} | {f"{n}_chars": half(weighted_chars(F.col(f"{n}_text")), 1) for n in ("our", "truth")} | {"similarity": half(F.col("score"), 2)}
    place = [F.coalesce("truth_s", "our_s").alias("at"), F.coalesce("truth_idx", F.lit(0)).alias("t"), F.coalesce("our_idx", F.lit(0)).alias("o")]
    listed = F.transform(F.array_sort(F.collect_list(F.struct(*place, F.struct(*pair).alias("p")))), lambda x: x["p"])

    def summed(also: Mapping[str, Column]) -> DataFrame:
        stats = tracks.timing_error_stats(both, fps, _paired(), {**_counts(), **middle, **also})
        first = [*_counts(), *[c for c in stats.columns if c not in ("file_id", *_counts(), *middle, *also)], *middle]
        return stats.fillna(0, ["matched"]).select("file_id", *first, *also)

    summary = summed({})
    text = F.to_json(F.struct(F.lit(note).alias("note"), F.lit(fps).alias("fps"), F.struct(*[c for c in summary.columns if c != "file_id"]).alias("summary"), "pairs"), {"ignoreNullFields": "false"})
    return {"pairs": both.select("file_id", *pair), "summary": summary, "files": summed({"pairs": listed}).select("file_id", text.alias("json"))}


def translate_job(cues: DataFrame, ask: Callable[[str], str], glossary: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(translated cues, flags): batches through the caller's completion function; a cue without a reply keeps its source text."""
    # A batch keeps its cues, so that replies meet them in their row and a text is shuffled once, by file.
    batches = language.completed(language.prompt_batches(cues, whole=True), ask)
    joined = batches.select("file_id", F.explode(F.transform("cues", lambda c: F.struct(c.alias("c"), F.element_at("said", c["idx"]).alias("target")))).alias("x")).select("file_id", "x.c.*", "x.target")
    translated = joined.select("file_id", "idx", "start_ms", "end_ms", F.coalesce("target", "text").alias("text"), F.col("target").isNull().alias("kept_source"))
    return translated, language.translation_flags(joined.filter("target is not null").select("file_id", "idx", F.col("text").alias("source"), "target"), glossary)


def revision_rounds(cues: DataFrame, revise: Callable[[DataFrame], DataFrame], settle_at: int = 0, least: int = 1, most: int = 3) -> tuple[DataFrame, list[int], str]:
    """Rounds of a caller's revision under the drift guard, until few cues change or the cap is reached.

    A revision depends on its cue alone, so a cue that a round leaves as it is would stay so: only cues that changed
    go to the next round. A round is one table and one count.
    """
    open_, done, changed, end = cues.withColumn("first", F.col("text")), [], [], "cap"
    for n in range(1, most + 1):
        proposed = revise(open_.drop("first")).select("file_id", "idx", F.col("text").alias("after"))
        # One join: what is open goes to its proposals once, and a cue without a proposal stays.
        pairs = open_.join(proposed, ["file_id", "idx"], "left").withColumn("before", F.col("text"))
        text = F.coalesce(F.when(language.drifts(), F.col("before")).otherwise(F.col("after")), "before")
        revised = pairs.withColumn("text", text).withColumn("changed", ~F.col("before").eqNullSafe(F.col("text")))
        after = scratch(revised.drop("before", "after"), "revised")
        changed.append(after.filter("changed").count())
        done.append(after.filter("not changed"))
        open_ = after.filter("changed").drop("changed")
        if n >= least and changed[-1] <= settle_at:
            end = "settled"
            break
        if not changed[-1]:
            changed += [0] * (least - n)
            end = "settled"
            break
    # What is still open has changed in the last round.
    parts = [d.select(*cues.columns) for d in [*done, open_]]
    return reduce(DataFrame.unionByName, parts), changed, end


def preferred_speech(spans: DataFrame) -> DataFrame:
    """Speech spans of a model where a file has them, else those of loudness."""
    best = Window.partitionBy("file_id")
    return spans.withColumn("best", F.min(F.when(F.col("method") == "vad", 0).otherwise(1)).over(best)).filter((F.col("best") == 1) | (F.col("method") == "vad")).drop("best")


def spot_job(cues: DataFrame, spans: DataFrame, shots: DataFrame | None = None, fps: float = 23.976, apply: bool = False) -> tuple[DataFrame, DataFrame]:
    """(cues, suggestions): speech of the better detector, spotting and shot changes, and what of it is safe, taken if asked for.

    ``spans`` has a column ``method``, vad or loudness; each detector has its own leads. Shots are given where the
    profile asks for them.
    """
    chosen = preferred_speech(spans)
    heard = {m: chosen.filter(F.col("method") == m).drop("method") for m in ("vad", "loudness")}
    of = {m: cues.join(heard["vad"], "file_id", how) for m, how in (("vad", "left_semi"), ("loudness", "left_anti"))}
    parts = [timing.spotting_suggestions(of[m], heard[m], fps, detector=m) for m in heard]
    found = parts[0].unionByName(parts[1]).withColumn("by", F.lit("speech"))
    if shots is not None:
        found = found.unionByName(timing.shot_change_suggestions(cues, shots, fps).withColumn("by", F.lit("shot")))
    if not apply:
        return cues, found
    moved = timing.apply_spotting(cues, found.filter("by = 'speech'"))
    return cues.drop("start_ms", "end_ms").join(moved, ["file_id", "idx"]), found


def terms_job(cues: DataFrame, glossary: DataFrame, dictionary: DataFrame, links: DataFrame, min_count: int = 1) -> DataFrame:
    """Terms of all files with their spelling and where it comes from, ready for ``write_tsv``."""
    terms = scratch(names.term_extract(cues, min_count), "terms")  # looked up, and joined with what is found
    known = language.term_research(terms.select("term").distinct(), glossary, dictionary, links)
    return terms.join(known, "term")


def cast_job(cues: DataFrame, pages: DataFrame | None = None) -> dict[str, DataFrame]:
    """Speakers with their levels, who names whom, and dialogue without a speaker; descriptions where pages are given."""
    people = names.cast_profile(cues)
    out = {"people": people, "relations": names.cross_reference(cues), "untagged": names.untagged_dialogue(cues)}
    if pages is not None:
        out["described"] = reference_data.cast_research(people.select(F.col("label").alias("name"), F.lit(None).cast("string").alias("description")).distinct(), pages)
    return out
