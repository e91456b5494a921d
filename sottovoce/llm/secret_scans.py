"""Incremental secret scan over content-addressed blobs, in built-in column functions only.

Every version of every text is addressed by its SHA-256. A ledger holds, for each blob, the rules (with
version) that have seen it and the spans they found. An increment scans only blob and rule-version pairs the
ledger lacks, each distinct blob once, appends to the ledger, and joins the findings back to all paths.

A match is found leftmost and non-overlapping per rule; one that is too short is then dropped. Spans count
code points and are half-open.

Edge cases: a null text is the empty blob and has no findings; equal texts share one scan; duplicate rows
each get their findings; a null path is an ordinary path; very long texts are scanned whole; columns other
than the key columns and the text are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table


class Rule(NamedTuple):
    kind: str
    version: int
    pattern: str
    group: int  # whose length is held against least
    least: int
    hints: tuple[str, ...]  # one of these stands in any lower-cased text that matches

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: Fixed values, in the order in which spans at one place are listed; the first three are the base rules.
RULES = (
    Rule("assign", 1, r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, ("akia",)),
    Rule("hex", 1, r"[0-9a-f]+", 0, 24, ()),
    Rule("private_key", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, ("-----begin ",)),
    Rule("vcs_token", 1, r"gh[opsur]_[A-Za-z0-9]+", 0, 30, ("gho_", "ghp_", "ghs_", "ghu_", "ghr_")),
    Rule("chat_token", 1, r"xox[abprs]-[A-Za-z0-9-]+", 0, 20, ("xox",)),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30, (".eyj",)),
)
BASE = ("assign", "access", "hex")
SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"
LEDGER = f"blob binary, scanned array<string>, spans {SPAN}"


def with_blob(history: DataFrame, text_col: str = "text") -> DataFrame:
    """``history`` with the content address ``blob`` of each text."""
    return history.withColumn("blob", F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)))


def rule_spans(text: Column, low: Column, rule: Rule, rank: int) -> Column:
    """Array of the rule's spans. The parts between the matches and the matches themselves alternate, so their lengths sum to positions."""
    pattern = F.lit(rule.pattern)
    # Dropping short runs of one character class afterwards or not matching them at all is the same.
    if rule.kind == "hex":
        pattern = F.lit(f"[0-9a-f]{{{rule.least},}}")
    gaps = F.split(text, rule.pattern if rule.kind != "hex" else f"[0-9a-f]{{{rule.least},}}", -1)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    checked = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    lengths = F.transform(F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), checked.alias("held")), lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"), F.length(x["held"]).alias("held")))
    none = F.lit(None).cast(SPAN)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + x["gap"]
        span = F.array(F.struct(at.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), (at + x["hit"]).alias("end"))).cast(SPAN)
        return F.struct((at + x["hit"]).alias("at"), F.when(x["held"] >= rule.least, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(F.filter(lengths, lambda x: x["hit"].isNotNull()), start, step)["out"]
    hinted = text.rlike(f"[0-9a-f]{{{rule.least}}}") if rule.kind == "hex" else F.lit(False)
    for hint in rule.hints:
        hinted = hinted | F.contains(low, F.lit(hint))
    return F.when(hinted, found).otherwise(F.coalesce(none, F.array().cast(SPAN)))


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows for (blob, text, pending): only the pending rules look at the text."""
    out = blobs.select("blob", "pending", "text", F.lower("text").alias("low"))
    parts = [F.when(F.array_contains("pending", rule.key), rule_spans(F.col("text"), F.col("low"), rule, i)).otherwise(F.array().cast(SPAN)) for i, rule in enumerate(rules)]
    return out.select("blob", F.col("pending").alias("scanned"), F.sort_array(F.concat(*parts)).alias("spans"))


def increment(history: DataFrame, ledger: DataFrame | None = None, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows for the blobs of ``history`` that ``ledger`` has not seen under all of ``rules``.

    Distinct blobs are picked before the shuffle on each task and once more after it, so that a text with
    many copies travels a few times at most and is scanned once.
    """
    wanted = F.array(*[F.lit(r.key) for r in rules])
    texts = with_blob(history.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    if ledger is None:
        pending = texts.groupBy("blob").agg(F.first("text").alias("text")).withColumn("pending", wanted)
    else:
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("seen"))
        unseen = texts.select("blob").distinct().join(seen, "blob", "left").select("blob", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))).alias("pending")).filter(F.size("pending") > 0)
        # Seen texts go before the rest is grouped.
        pending = texts.join(scratch(unseen, "unseen-blobs"), "blob").groupBy("blob").agg(F.first("text").alias("text"), F.first("pending").alias("pending"))
    return scan_blobs(pending, rules)


def findings(history: DataFrame, keys: list[str], ledger: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Each path of ``history`` with its blob and the spans the ledger holds for it under the given rules."""
    # A ledger row holds spans of the rule versions it was scanned under.
    key_of = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.key)])
    live = F.filter("spans", lambda s: F.array_contains("scanned", F.coalesce(key_of[s["kind"]], F.lit(""))))
    # Written, so that the join knows its size and can split the paths of a blob with many copies.
    whole = scratch(ledger.groupBy("blob").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list(live)))).alias("spans")), "secret-spans")
    paths = with_blob(history.select(*keys, F.col(text_col))).drop(text_col)
    return paths.join(whole, "blob", "left")


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two increments over the table, as if the documents of odd ids had come later; the second scans only blobs that
    the first's ledger lacks, and the findings are joined back to all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    odd = F.coalesce(F.col("doc_id") % 2 != 0, F.lit(True))
    ledger = scratch(increment(docs.filter(~odd)), "secret-ledger")
    ledger = ledger.unionByName(scratch(increment(docs.filter(odd), ledger), "secret-ledger"))
    found = findings(docs, ["doc_id"], ledger)
    text_of = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(text_of(F.filter("spans", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"), text_of(F.col("spans")).alias("spans"))


def _sql() -> str:
    ctes, lists = [], []
    for i, r in enumerate(RULES):
        pattern = r.pattern.replace("((?i)", "((?i:").replace("api_?key)", "api_?key))").replace("'", "''") if r.kind == "assign" else r.pattern
        ctes.append(f"""{r.kind} as (select blob, string_split_regex(text, '{pattern}') g, regexp_extract_all(text, '{pattern}', 0) h, regexp_extract_all(text, '{pattern}', {r.group}) v from blobs),
        {r.kind}_s as (select blob, list_filter(list_transform(range(1, len(h) + 1), lambda i: {{'start': (coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0))::int, 'rank': {i}, 'kind': '{r.kind}', 'len': length(h[i])::int, 'held': length(v[i])::int}}), lambda s: s.held >= {r.least}) s from {r.kind})""")
        lists.append(f"{r.kind}_s.s")
    joins = " ".join(f"join {r.kind}_s using (blob)" for r in RULES)
    said = "array_to_string(list_transform({}, lambda s: s.kind || ':' || s.start || ':' || (s.start + s.len)), ',')"
    return f"""with blobs as (select sha256(coalesce(text, '')) blob, any_value(coalesce(text, '')) as text from documents group by 1), {', '.join(ctes)},
    found as (select blob, list_sort({' || '.join(lists)}) as spans from blobs {joins})
    select doc_id, {', '.join(f"len(list_filter(spans, lambda s: s.kind = '{k}'))::bigint as n_{k}" for k in BASE)}, sha256({said.format(f"list_filter(spans, lambda s: s.rank < {len(BASE)})")}) as base_sha256, {said.format('spans')} as spans
    from documents join found on blob = sha256(coalesce(text, ''))"""


QUERIES = {"op5_secret_scans": op5_secret_scans}
ORACLE = {"op5_secret_scans": _sql()}
