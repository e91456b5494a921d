"""Rule files: YAML profiles as tables, their chains of ``extends``, and what a profile is after inheritance.

A file becomes rows: one for its head, one for each key and each entry of a mapping (values as JSON), one for each rule
and each disabled rule. Chains are followed in rounds, one join each, for all files at once; values and rules of a chain
are settled by aggregations over the depth they come from. Files that break the contract have an error, not a profile.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator
from functools import reduce
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sottovoce.plans.profiles import CHECKING, KINDS, SDH_ONLY, ProfileError
from sottovoce.sources.scratch import scratch

ROWS = "file string, part string, key string, sub string, pos int, is_map boolean, value string, refs array<string>"
#: What is wrong with a file, the first that holds.
NOT_A_MAPPING, BAD_KIND, MIXED, BAD_VERSION, NO_PARENT, CIRCLE, OTHER_KIND = "not a mapping", "unknown kind", "keys of sound description in a translation profile", "unknown schema version", "no such file to extend", "extends runs in a circle", "extends a profile of another kind"


def _rows(file: str, text: str, roots: list[str]) -> list[tuple[Any, ...]]:
    import yaml

    try:
        data = yaml.safe_load(text)
    except yaml.YAMLError:
        data = None
    if not isinstance(data, dict):
        return [(file, "head", None, None, None, None, None, [])]
    said = lambda v: json.dumps(v, ensure_ascii=False, sort_keys=True, default=str)
    ref = data.get("extends")
    refs = [posixpath.normpath(posixpath.join(at, str(ref))) for at in (posixpath.dirname(file), *roots)] if ref else []
    out = [(file, "head", None, None, None, None, said({"kind": data.get("kind"), "version": data.get("schema_version"), "mixed": any(k in data for k in SDH_ONLY)}), refs)]
    for key, value in data.items():
        if key == "rules":
            out += [(file, "rule", r["id"], None, i, None, said(r), None) for i, r in enumerate(value or [])]
        elif key == "disable_rules":
            out += [(file, "off", r, None, i, None, None, None) for i, r in enumerate(value or [])]
        elif isinstance(value, dict):
            out.append((file, "value", str(key), None, None, True, None, None))
            out += [(file, "value", str(key), str(sub), None, True, said(v), None) for sub, v in value.items()]
        elif key != "extends":
            out.append((file, "value", str(key), None, None, False, said(value), None))
    return out


def parse_rule_files(files: DataFrame, roots: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Rows of (path, value); ``extends`` is looked up beside a file first, then in each root."""
    bases = [posixpath.normpath(r) for r in roots]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for path, text in zip(batch["path"], batch["value"], strict=True) for r in _rows(posixpath.normpath(path), text, bases)]
            out = pd.DataFrame(rows, columns=["file", "part", "key", "sub", "pos", "is_map", "value", "refs"])
            yield out.astype({"pos": "Int32", "is_map": "boolean"})

    return files.select("path", "value").mapInPandas(run, ROWS)


def read_rule_files(spark: SparkSession, *folders: str) -> DataFrame:
    """Rows of all ``.yaml`` files below the folders, which are also the roots of ``extends``, the first one first."""
    read = lambda f: spark.read.option("pathGlobFilter", "*.yaml").option("recursiveFileLookup", True).text(f, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    # Paths are compared as the reader spells them: a local one as file:///a/b.
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    files = reduce(DataFrame.unionByName, [read(f) for f in folders])
    return parse_rule_files(files.select(plain(F.col("path")).alias("path"), "value").distinct(), [f.removeprefix("file://") for f in folders])


class Profiles(NamedTuple):
    values: DataFrame  # (file, key, sub, is_map, value): sub is null for a key that is no mapping, and for the mapping itself
    rules: DataFrame  # (file, depth, pos, rule_id, value): inherited ones have a greater depth and come first
    errors: DataFrame  # (file, error)


def resolve_files(rows: DataFrame) -> Profiles:
    rows = scratch(rows, "rule-files")
    head = F.from_json("value", "kind string, version string, mixed boolean")
    heads = rows.filter("part = 'head'").select("file", "refs", head.alias("h"))
    wrong = (
        F.when(F.col("h").isNull(), NOT_A_MAPPING).when(~F.coalesce(F.col("h.kind").isin(*KINDS), F.lit(False)), BAD_KIND)
        .when((F.col("h.kind") == "translation") & F.col("h.mixed"), MIXED).when(~F.col("h.version").eqNullSafe("1"), BAD_VERSION)
    )
    heads = heads.select("file", "refs", F.col("h.kind").alias("kind"), wrong.alias("error"))
    wanted = heads.select("file", F.posexplode("refs").alias("nth", "parent"))
    there = heads.select(F.col("file").alias("parent"), F.col("kind").alias("parent_kind"), F.col("error").alias("parent_error"))
    parents = wanted.join(there, "parent").groupBy("file").agg(F.min_by(F.struct("parent", "parent_kind", "parent_error"), "nth").alias("p"))
    steps = heads.join(parents, "file", "left").select("file", "error", (F.size("refs") > 0).alias("extends"), "kind", "p.*")
    # Every file's own step: where it leads, and what is wrong with it.
    broken = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("extends") & F.col("parent").isNull(), NO_PARENT).when(F.col("parent_error").isNotNull(), F.col("parent_error"))
    broken = broken.when(F.col("parent").isNotNull() & ~F.col("parent_kind").isin("common") & (F.col("parent_kind") != F.col("kind")), OTHER_KIND)
    steps = scratch(steps.select("file", "parent", broken.alias("error")), "rule-steps")
    to = steps.select(F.col("file").alias("at"), F.col("parent").alias("next"), F.col("error").alias("its"))
    front = scratch(steps.select("file", F.col("file").alias("at"), F.lit(0).alias("depth"), F.array("file").alias("seen"), F.lit(None).cast("string").alias("failed")), "rule-front")
    chain = [front]
    while True:
        on = front.filter("failed is null").join(to, "at").filter("next is not null or its is not null")
        failed = F.coalesce(F.when(F.array_contains("seen", F.col("next")), CIRCLE), F.col("its"))
        on = on.select("file", F.coalesce("next", "at").alias("at"), (F.col("depth") + 1).alias("depth"), F.concat("seen", F.array("next")).alias("seen"), failed.alias("failed"))
        front = scratch(on, "rule-front")
        if front.isEmpty():
            break
        chain.append(front)
    levels = reduce(DataFrame.unionByName, chain).select("file", "at", "depth", "failed")
    errors = levels.filter("failed is not null").groupBy("file").agg(F.min_by("failed", "depth").alias("error"))
    good = scratch(levels.join(errors, "file", "left_anti").select("file", "at", "depth"), "rule-levels")
    each = good.join(rows.withColumnRenamed("file", "at"), "at")

    v = each.filter("part = 'value'")
    plain = v.groupBy("file", "key").agg(F.min("depth").alias("nearest"), F.min(F.when(~F.col("is_map"), F.col("depth"))).alias("no_map"))
    v = v.join(plain, ["file", "key"]).filter("no_map is null or depth < no_map or depth = nearest")
    values = v.groupBy("file", "key", "sub").agg(F.min_by(F.struct("is_map", "value"), "depth").alias("v")).select("file", "key", "sub", "v.*")

    r = each.filter("part in ('rule', 'off')")
    firsts = r.groupBy("file", "key").agg(F.min(F.when(F.col("part") == "rule", F.col("depth"))).alias("made"), F.min(F.when(F.col("part") == "off", F.col("depth"))).alias("gone"))
    r = r.filter("part = 'rule'").join(firsts, ["file", "key"]).filter("depth = made and (gone is null or gone > depth)")
    return Profiles(values, r.select("file", "depth", "pos", F.col("key").alias("rule_id"), "value"), errors)


def load_profile(profiles: Profiles, file: str) -> dict[str, Any]:
    """One file's profile as a mapping, fit for checking cues; no more than that file's rows are fetched."""
    file = posixpath.normpath(file.removeprefix("file://"))
    for row in profiles.errors.filter(F.col("file") == file).collect():
        raise ProfileError(f"{file}: {row.error}")
    out: dict[str, Any] = {}
    for row in profiles.values.filter(F.col("file") == file).orderBy("key", F.col("sub").asc_nulls_first()).collect():
        if not row.is_map:
            out[row.key] = json.loads(row.value)
        elif row.sub is None:
            out.setdefault(row.key, {})
        else:
            out.setdefault(row.key, {})[row.sub] = json.loads(row.value)
    if not out:
        raise ProfileError(f"no profile {file}")
    out["rules"] = [json.loads(r.value) for r in profiles.rules.filter(F.col("file") == file).orderBy(F.col("depth").desc(), "pos").collect()]
    source = out.get("source") or {}
    if out.get("kind") not in CHECKING or out.get("status") != "complete" or not (source.get("official") or source.get("client")):
        raise ProfileError(f"{file}: not complete, without a source, or of a kind that checks no cues")
    return out


def rules_of(profiles: Profiles) -> DataFrame:
    """(profile, pos, rule_id, clause, check, auto, message) of every file, one row for each check that a rule names."""
    rule = F.from_json("value", "clause string, check string, auto boolean, message string")
    checks = F.coalesce(F.from_json(F.col("r.check"), "array<string>"), F.array("r.check"))
    each = profiles.rules.select("file", "depth", "pos", "rule_id", rule.alias("r")).select("*", F.posexplode(checks).alias("nth", "check"))
    order = F.row_number().over(Window.partitionBy("file").orderBy(F.col("depth").desc(), "pos", "nth"))
    return each.select(F.col("file").alias("profile"), (order - 1).alias("pos"), "rule_id", F.coalesce("r.clause", F.lit("")).alias("clause"), "check", F.coalesce("r.auto", F.lit(False)).alias("auto"), F.coalesce("r.message", F.lit("")).alias("message"))

