"""Temperature mixing of sources to target weights, in built-in column functions only.

The token share of each source is raised to an exponent between 0 (all sources alike) and 1 (as they are).
The exponent is found by bisection: the flattest mix in which no source is repeated more than
``max_repeats`` times (in ``cover`` mode, where the largest source is taken once), or the least flat mix whose
entropy reaches ``target_entropy`` bits (where none reaches it, the flattest). Normalised weights times the budget give each source its tokens. They
are realised as whole passes over the source plus a partial one: blocks of documents in permuted order, and
documents in permuted order within a block, while the tokens of the partial pass last. All permutations come
from seeded hashes, so every run and every retry makes the same choice.

A given budget is met whatever it is: ``max_repeats`` then bounds how often a source is repeated in comparison with
the largest one, and a budget above all tokens repeats that one too. Every pass has a permutation of its own.

Tokens are words. Exponents are rounded to 6 decimals and repeats to 6 decimals, so that engines agree.

Edge cases: a null source is a source of its own; a source without a token is taken once in cover mode and
otherwise left out; documents without tokens go with their block; duplicate rows are separate documents with
one order key; a very long text is one document of its block; an empty table gives an empty result; clashing column names do not matter, since other columns travel in one struct.

Scale: sources are a small table (one row each, gathered into one array row for the bisection: 24 bytes per
source). Documents are dealt by (source, block); blocks hold about ``block_docs`` documents, so a hot source spreads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_words, scratch, table

ROUNDS = 48


def _exponent(shares: Column, max_repeats: float | None, target_entropy: float | None) -> Column:
    """Bisected exponent over the array of positive shares."""
    if (max_repeats is None) == (target_entropy is None):
        raise ValueError("give either max_repeats or target_entropy")
    least, most = F.array_min(shares), F.array_max(shares)

    def flat_enough(x: Column) -> Column:  # true: the exponent may fall (repeats) or has to (entropy)
        if max_repeats is not None:
            return F.pow(least / most, x - 1) <= max_repeats
        total = F.aggregate(shares, F.lit(0.0), lambda a, p: a + F.pow(p, x))
        bits = F.aggregate(shares, F.lit(0.0), lambda a, p: a - F.pow(p, x) / total * F.log2(F.pow(p, x) / total))
        return bits < target_entropy

    # Both conditions hold for large exponents if at all; low and high close in on the point where they begin to.
    def half(acc: Column, _: Column) -> Column:
        mid = (acc["low"] + acc["high"]) / 2
        down = flat_enough(mid)
        return F.struct(F.when(down, acc["low"]).otherwise(mid).alias("low"), F.when(down, mid).otherwise(acc["high"]).alias("high"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high")), half)
    # At 0 the repeats are within the limit, or even the flattest mix is below the target: 0 is all that can be done.
    return F.round(F.when(flat_enough(F.lit(0.0)), 0.0).otherwise(found["high" if max_repeats is not None else "low"]), 6)


def source_plan(totals: DataFrame, max_repeats: float | None = 2.0, target_entropy: float | None = None, budget: int | None = None) -> DataFrame:
    """(source, n_docs, n_tokens, exponent, repeats, passes, rest) from (source, n_docs, n_tokens).

    ``budget`` None is cover mode: the smallest budget at which every source is seen once.
    """
    row = totals.agg(F.filter(F.collect_list(F.col("n_tokens").cast("double")), lambda n: n > 0).alias("ns"))
    row = row.select("ns", F.aggregate("ns", F.lit(0.0), lambda a, n: a + n).alias("all"))
    row = row.select("all", F.array_sort(F.transform("ns", lambda n: n / F.col("all"))).alias("shares"))
    row = row.select("all", "shares", _exponent(F.col("shares"), max_repeats, target_entropy).alias("exponent"))
    row = row.select("all", "exponent", F.array_max("shares").alias("most"), F.aggregate("shares", F.lit(0.0), lambda a, p: a + F.pow(p, F.col("exponent"))).alias("norm"))
    share = F.col("n_tokens") / F.col("all")
    times = F.pow(share / F.col("most"), F.col("exponent") - 1) if budget is None else F.pow(share, F.col("exponent") - 1) / F.col("norm") * F.lit(float(budget)) / F.col("all")
    planned = totals.crossJoin(row).select("source", "n_docs", "n_tokens", "exponent", F.when(F.col("n_tokens") > 0, F.round(times, 6)).otherwise(1.0 if budget is None else 0.0).alias("repeats"))
    micro = F.round(F.col("repeats") * 1000000).cast("decimal(38,0)")
    tokens = F.floor(F.col("n_tokens").cast("decimal(20,0)") * micro / F.lit(1000000).cast("decimal(10,0)")).cast("long")
    passes = F.floor("repeats").cast("long")
    return planned.select("*", passes.alias("passes"), (tokens - passes * F.col("n_tokens")).alias("rest"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, block_docs: int = 1024, max_repeats: float | None = 2.0, target_entropy: float | None = None, budget: int | None = None) -> DataFrame:
    """One row per document and pass that it is in: (row, source, n_tokens, pass, block, block_key, order_key).

    In each pass of a source, blocks are ordered by block_key, and documents of a block by order_key.

    ``row`` is a struct of the columns of ``docs`` except the text; ``text`` is carried beside it only if it is
    among those the caller selects from the result.
    """
    said = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    rest = [c for c in docs.columns if c != text_col]
    sized = docs.select(F.struct(*rest).alias("row"), F.col(text_col).alias("text"), F.col(source_col).alias("source"), said.alias("said"), n_words(F.col(text_col)).alias("n_tokens"))
    return _realise(sized, seed, block_docs, max_repeats, target_entropy, budget)


def _realise(sized: DataFrame, seed: int, block_docs: int, max_repeats: float | None, target_entropy: float | None, budget: int | None) -> DataFrame:
    plan = scratch(source_plan(sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")), max_repeats, target_entropy, budget), "mix-plan")
    plan = plan.withColumnRenamed("n_tokens", "all_tokens").withColumnRenamed("source", "of")
    placed = sized.join(plan, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:block:"), F.col("said"))), 1, 8), 16, 10).cast("long")
    placed = placed.withColumn("block", F.pmod(bits, F.ceil(F.col("n_docs") / block_docs).cast("long")))
    small = placed.drop("row", "text").filter("rest > 0")
    blocks = small.groupBy("source", "block").agg(F.sum("n_tokens").alias("n"), F.max("rest").alias("rest"), (F.max("passes") + 1).alias("pass"))
    blocks = scratch(blocks.withColumn("block_key", _key(seed, "turn", F.coalesce("source", F.lit("null")), F.col("block"))), "mix-blocks")
    # A source's blocks in turn: by the first two digits of their keys, then within those, so that no task has them all.
    cell = F.substring("block_key", 1, 2)
    cells = blocks.groupBy("source", cell.alias("cell")).agg(F.sum("n").alias("m"))
    cells = cells.select(F.col("source").alias("of"), F.col("cell").alias("c"), (F.sum("m").over(Window.partitionBy("source").orderBy("cell")) - F.col("m")).alias("ahead"))
    before = F.sum("n").over(Window.partitionBy("source", cell).orderBy("block_key", "block")) - F.col("n")
    starts = blocks.withColumn("within", before).join(cells, F.col("source").eqNullSafe(F.col("of")) & (cell == F.col("c")))
    # The block in which the partial pass ends is in as far as it goes; those before it are in, those after it out.
    starts = starts.select(F.col("source").alias("of"), F.col("block").alias("b"), (F.col("ahead") + F.col("within")).alias("before"), "rest").filter("before < rest").drop("rest")
    part = placed.filter("rest > 0").join(starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("b"))).drop("of", "b").withColumn("pass", F.col("passes") + 1)
    part = part.withColumn("order_key", _key(seed, "doc", F.col("said")))
    upto = F.col("before") + F.sum("n_tokens").over(Window.partitionBy("source", "block").orderBy("order_key", "said").rowsBetween(Window.unboundedPreceding, 0))
    part = part.withColumn("upto", upto).filter("upto <= rest")
    full = placed.filter("passes > 0").withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("passes")))).withColumn("order_key", _key(seed, "doc", F.col("said")))
    columns = [c for c in ("row", "text") if c in sized.columns] + ["source", "n_tokens", "pass", "block", "order_key"]
    out = full.select(*columns).unionByName(part.select(*columns))
    return out.withColumn("block_key", _key(seed, "turn", F.coalesce("source", F.lit("null")), F.col("block")))


def _key(seed: int, what: str, *said: Column) -> Column:
    """The place of a block among those of a source's pass, or of a document in its block's."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.lit(what), F.col("pass"), *said))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row as often as its source's weight asks for."""
    text = options.get("text_col", "text")
    out = mix(docs, **options)
    return out.select(*[(F.col("text") if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), max_repeats=2.0)
    return out.select(F.col("row.doc_id").alias("doc_id"), "source", "n_tokens", F.col("pass").alias("copy"), "block", "block_key", "order_key")


def op8_mixing_to_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the corpus's words, from its sources so far evened out that they reach 2.5 bits."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    budget = (docs.agg(F.sum(n_words(F.col("text")))).first()[0] or 0) // 2
    out = mix(docs, max_repeats=None, target_entropy=2.5, budget=budget)
    return out.select(F.col("row.doc_id").alias("doc_id"), "source", "n_tokens", F.col("pass").alias("copy"), "block", "block_key", "order_key")


#: Repeats of each source in cover mode with a limit of 2.
_COVER = r"""r as (select min(all_tokens) / max(all_tokens)::double as q, max(all_tokens) as most from t),
b(i, low, high) as (select 0, 0.0::double, 1.0::double union all
  select i + 1, case when pow(q, (low + high) / 2 - 1) <= 2.0 then low else (low + high) / 2 end, case when pow(q, (low + high) / 2 - 1) <= 2.0 then (low + high) / 2 else high end from b, r where i < 48),
e as (select round(case when pow(q, -1.0) <= 2.0 then 0.0 else (select high from b where i = 48) end, 6) as x, most from r),
p as (select source, n_docs, all_tokens, round(pow(all_tokens / most::double, x - 1), 6) as repeats from t, e),"""
#: Repeats of each source for an entropy of 2.5 bits and half of all words.
_BUDGET = r"""a as (select sum(all_tokens)::double as total, sum(all_tokens)::bigint // 2 as budget from t),
l as (select list_sort(list(all_tokens / total)) as ps from t, a where all_tokens > 0),
b(i, low, high, ps) as (select 0, 0.0::double, 1.0::double, ps from l union all
  select i + 1, case when flat then low else mid end, case when flat then mid else high end, ps from (select *, -list_sum(list_transform(qs, lambda q: q / list_sum(qs) * log2(q / list_sum(qs)))) < 2.5 as flat from
    (select *, list_transform(ps, lambda p: pow(p, mid)) as qs from (select *, (low + high) / 2 as mid from b where i < 48)))),
e as (select case when log2(len(ps)) < 2.5 then 0.0 else round(low, 6) end as x, ps from b where i = 48),
p as (select source, n_docs, all_tokens, case when all_tokens > 0 then round(pow(all_tokens / total, x - 1) / list_sum(list_transform(ps, lambda p: pow(p, x))) * budget / total, 6) else 0.0 end as repeats from t, e, a),"""


def _sql(plan: str) -> str:
    return rf"""with recursive d as (select doc_id, source, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::bigint as n_tokens,
  ('0x' || substr(md5('17:block:' || doc_id), 1, 8))::bigint as bits from documents),
t as (select source, count(*) as n_docs, sum(n_tokens)::bigint as all_tokens from d group by 1),
{plan}
p2 as (select *, floor(repeats)::bigint as passes, (all_tokens::hugeint * round(repeats * 1000000)::hugeint // 1000000)::bigint - floor(repeats)::bigint * all_tokens as rest from p),
k as (select d.*, bits % ceil(n_docs / 1024.0)::bigint as block, passes, rest from d join p2 using (source)),
g as (select source, block, sum(n_tokens) as n, max(rest) as rest, max(passes) + 1 as copy from k where rest > 0 group by 1, 2),
s as (select source, block, sum(n) over (partition by source order by md5('17:turn:' || copy || ':' || source || ':' || block), block) - n as before from g),
u as (select k.*, before + sum(n_tokens) over (partition by source, block order by md5('17:doc:' || (passes + 1) || ':' || doc_id), doc_id::varchar rows unbounded preceding) as upto from k join s using (source, block) where before < rest),
o as (select doc_id, source, n_tokens, unnest(range(1, passes + 1))::bigint as copy, block from k where passes > 0
union all select doc_id, source, n_tokens, passes + 1, block from u where upto <= rest)
select *, md5('17:turn:' || copy || ':' || source || ':' || block) as block_key, md5('17:doc:' || copy || ':' || doc_id) as order_key from o"""


QUERIES = {"op8_mixing": op8_mixing, "op8_mixing_to_budget": op8_mixing_to_budget}
ORACLE = {"op8_mixing": _sql(_COVER), "op8_mixing_to_budget": _sql(_BUDGET)}
