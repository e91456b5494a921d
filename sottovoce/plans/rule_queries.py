"""Registered queries of the rule files, with their SQL: regions, nations and suppliers each have a file by rule, written as text
and read as any file of that layout. A nation's profile extends its region's, a supplier's its nation's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sottovoce.sources import rule_files
from sottovoce.sources.fixtures import table

REGION = """schema_version: 1
platform: p%d
kind: common
status: complete
source: {official: true}
limits: {max_lines: 2, duration_ms: {min: 833, max: %d}}
rules:
  - {id: C01, clause: "1.1", check: duration_out_of_range, auto: false, message: duration}
  - {id: C02, clause: "1.2", check: [too_many_lines, double_space], auto: true, message: lines}
"""
NATION = """schema_version: 1
kind: sdh
extends: common.yaml
language: ko
limits: {chars_per_line: %d}
text: %s
rules:
  - {id: N01, check: tilde_used}
  - {id: %s, check: three_dot_ellipsis, message: own}
"""
SUPPLIER = """schema_version: 1
kind: %s
extends: %s
source: {client: c%d}
limits: {max_lines: %d}
disable_rules: [%s]
"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, value) of all rule files. Some suppliers extend a profile of another kind, themselves, or a file that is not there."""
    regions = table(spark, sf_dir, "region").select(F.format_string("/rules/r%d/common.yaml", "r_regionkey").alias("path"), F.format_string(REGION, "r_regionkey", F.col("r_regionkey") + 7000).alias("value"))
    n = F.col("n_nationkey")
    text = F.when(n % 2 == 0, "{tilde: forbidden}").otherwise("plain")
    nation = table(spark, sf_dir, "nation")
    nations = nation.select(F.format_string("/rules/r%d/n%d.yaml", "n_regionkey", n).alias("path"), F.format_string(NATION, n % 5 + 16, text, F.when(n % 3 == 0, "C02").otherwise("N02")).alias("value"))
    s = F.col("s_suppkey")
    parent = F.when(s % 10 == 3, F.format_string("s%d.yaml", s)).when(s % 10 == 4, "none.yaml").otherwise(F.format_string("../r%d/n%d.yaml", "n_regionkey", "s_nationkey"))
    own = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == n)
    clients = own.select(F.format_string("/rules/clients/s%d.yaml", s).alias("path"), F.format_string(SUPPLIER, F.when(s % 10 == 7, "translation").otherwise("sdh"), parent, s, s % 3 + 1, F.when(s % 4 == 1, "C01").otherwise("")).alias("value"))
    return regions.unionByName(nations).unionByName(clients)


def _resolved(spark: SparkSession, sf_dir: str) -> rule_files.Profiles:
    return rule_files.resolve_files(rule_files.parse_rule_files(files(spark, sf_dir), ["/rules"]))


def rule_file_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).values.filter("value is not null").select("file", "key", "sub", "value")


def rule_file_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_files.rules_of(_resolved(spark, sf_dir))


def rule_file_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).errors


QUERIES = {f.__name__: f for f in (rule_file_values, rule_file_rules, rule_file_errors)}

_BASE = """with reg as (select r_regionkey as r, '/rules/r' || r_regionkey || '/common.yaml' as file from region),
nat as (select n_nationkey as n, n_regionkey as r, '/rules/r' || n_regionkey || '/n' || n_nationkey || '.yaml' as file from nation),
sup as (select s_suppkey as s, n, r, '/rules/clients/s' || s_suppkey || '.yaml' as file from supplier join nat on s_nationkey = n where s_suppkey % 10 not in (3, 4, 7)),
lv as (select file, r, null::int as n, null::bigint as s from reg union all select file, r, n, null from nat union all select file, r, n, s from sup)"""
ORACLE = {
    "rule_file_values": f"""{_BASE}, v as (select file, unnest([
        {{'key': 'schema_version', 'sub': null, 'value': '1'}}, {{'key': 'platform', 'sub': null, 'value': '"p' || r || '"'}}, {{'key': 'kind', 'sub': null, 'value': case when n is null then '"common"' else '"sdh"' end}}, {{'key': 'status', 'sub': null, 'value': '"complete"'}},
        {{'key': 'source', 'sub': 'official', 'value': 'true'}}, {{'key': 'source', 'sub': 'client', 'value': '"c' || s || '"'}}, {{'key': 'limits', 'sub': 'max_lines', 'value': coalesce(s % 3 + 1, 2)::varchar}}, {{'key': 'limits', 'sub': 'duration_ms', 'value': '{{"max": ' || (7000 + r) || ', "min": 833}}'}},
        {{'key': 'limits', 'sub': 'chars_per_line', 'value': (16 + n % 5)::varchar}}, {{'key': 'language', 'sub': null, 'value': case when n is not null then '"ko"' end}}, {{'key': 'text', 'sub': case when n % 2 = 0 then 'tilde' end, 'value': case n % 2 when 0 then '"forbidden"' when 1 then '"plain"' end}}]) as e from lv)
        select file, e.key as key, e.sub as sub, e.value as value from v where e.value is not null""",
    "rule_file_rules": f"""{_BASE}, q as (select file, list_filter([
        {{'id': 'C01', 'clause': '1.1', 'check': 'duration_out_of_range', 'auto': false, 'message': 'duration', 'on': coalesce(s % 4 <> 1, true)}}, {{'id': 'C02', 'clause': '1.2', 'check': 'too_many_lines', 'auto': true, 'message': 'lines', 'on': coalesce(n % 3 <> 0, true)}}, {{'id': 'C02', 'clause': '1.2', 'check': 'double_space', 'auto': true, 'message': 'lines', 'on': coalesce(n % 3 <> 0, true)}},
        {{'id': 'N01', 'clause': '', 'check': 'tilde_used', 'auto': false, 'message': '', 'on': n is not null}}, {{'id': case when n % 3 = 0 then 'C02' else 'N02' end, 'clause': '', 'check': 'three_dot_ellipsis', 'auto': false, 'message': 'own', 'on': n is not null}}], lambda x: x.on) as es from lv),
        p as (select file, unnest(es) as e, unnest(range(len(es))) as pos from q)
        select file as profile, pos::int as pos, e.id as rule_id, e.clause as clause, e.check as check, e.auto as auto, e.message as message from p""",
    "rule_file_errors": "select '/rules/clients/s' || s_suppkey || '.yaml' as file, case s_suppkey % 10 when 3 then 'extends runs in a circle' when 4 then 'no such file to extend' else 'extends a profile of another kind' end as error from supplier where s_suppkey % 10 in (3, 4, 7)",
}
