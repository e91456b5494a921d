"""Rule files of the layout ``platform/language-kind.yaml`` and clients' files that extend them."""

import pytest
from sottovoce.plans import profiles
from sottovoce.sources import rule_files

FILES = {
    "rules/net/common.yaml": """
schema_version: 1
platform: net
kind: common
status: complete
source: {official: true}
limits: {duration_ms: {min: 833, max: 7000}, max_lines: 2}
rules:
  - {id: C01, clause: "1", check: duration_out_of_range}
""",
    "rules/net/ko-sdh.yaml": """
schema_version: 1
kind: sdh
extends: common.yaml
language: ko
limits: {chars_per_line: 16, reading_speed_cps: {adult: 14, children: 11}}   # not those of translations
sound_effect: {discouraged_endings: [소리, 소음]}
text: plain
rules:
  - {id: T06, check: three_dot_ellipsis, auto: true, message: 점 세 개}
  - {id: T07, check: [tilde_used, double_space]}
""",
    "clients/agency.yaml": """
schema_version: 1
kind: sdh
extends: net/ko-sdh.yaml
source: {official: false, client: agency}
limits: {chars_per_line: 14, reading_speed_cps: {adult: 12}}
text: {tilde: forbidden}
disable_rules: [T06, A02]
rules:
  - {id: A01, check: line_end_period_or_comma, auto: true}
  - {id: A02, check: tilde_used}
  - {id: C01, check: gap_too_short}
""",
    "clients/circle.yaml": "{schema_version: 1, kind: sdh, extends: other.yaml}",
    "clients/other.yaml": "{schema_version: 1, kind: sdh, extends: circle.yaml}",
    "clients/into-circle.yaml": "{schema_version: 1, kind: sdh, extends: circle.yaml}",
    "clients/mixed.yaml": "{schema_version: 1, kind: translation, speaker_id: {}}",
    "clients/below-mixed.yaml": "{schema_version: 1, kind: translation, extends: mixed.yaml}",
    "clients/music.yaml": "{schema_version: 1, kind: translation, status: complete, source: {client: x}, music: {music_note: '♪'}, empty: {}}",
    "clients/kindless.yaml": "{schema_version: 1}",
    "clients/version.yaml": "{schema_version: 2, kind: sdh}",
    "clients/list.yaml": "- a",
    "clients/broken.yaml": "a: [",
    "clients/orphan.yaml": "{schema_version: 1, kind: sdh, extends: nowhere.yaml}",
    "clients/crossed.yaml": "{schema_version: 1, kind: translation, extends: net/ko-sdh.yaml}",
    "clients/draft.yaml": "{schema_version: 1, kind: sdh, status: draft, source: {client: x}}",
}


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("profiles")
    for name, text in FILES.items():
        (at / name).parent.mkdir(parents=True, exist_ok=True)
        (at / name).write_text(text, encoding="utf-8")
    return at, rule_files.resolve_files(rule_files.read_rule_files(spark, f"{at}/clients", f"{at}/rules"))


def test_a_chain_is_merged_over_folders(found):
    at, profiles_ = found
    out = rule_files.load_profile(profiles_, f"{at}/clients/agency.yaml")
    assert out["platform"] == "net" and out["source"] == {"official": False, "client": "agency"}
    assert out["limits"] == {"duration_ms": {"min": 833, "max": 7000}, "max_lines": 2, "chars_per_line": 14, "reading_speed_cps": {"adult": 12}}
    assert out["text"] == {"tilde": "forbidden"} and out["sound_effect"] == {"discouraged_endings": ["소리", "소음"]}
    assert [(r["id"], r["check"]) for r in out["rules"]] == [("T07", ["tilde_used", "double_space"]), ("A01", "line_end_period_or_comma"), ("C01", "gap_too_short")]
    profiles.validated(out)


def test_files_equal_the_mappings_merged_one_by_one(found):
    yaml = pytest.importorskip("yaml")
    at, profiles_ = found
    library = {n: yaml.safe_load(t) for n, t in FILES.items() if n.startswith("rules") or "agency" in n}
    library["rules/net/ko-sdh.yaml"]["extends"] = "rules/net/common.yaml"
    library["clients/agency.yaml"]["extends"] = "rules/net/ko-sdh.yaml"
    for name in ("clients/agency.yaml", "rules/net/ko-sdh.yaml"):
        want = {k: v for k, v in profiles.resolve(name, library).items() if k not in ("extends", "disable_rules")}
        assert rule_files.load_profile(profiles_, f"{at}/{name}") == want


def test_rules_become_one_row_for_each_check(found):
    at, profiles_ = found
    got = [tuple(r)[1:5] for r in rule_files.rules_of(profiles_).filter("profile like '%agency%'").orderBy("pos").collect()]
    assert got == [(0, "T07", "", "tilde_used"), (1, "T07", "", "double_space"), (2, "A01", "", "line_end_period_or_comma"), (3, "C01", "", "gap_too_short")]


def test_broken_files_are_refused_and_the_others_stay(found):
    at, profiles_ = found
    got = {r.file.rsplit("/", 1)[1].split(".")[0]: r.error for r in profiles_.errors.collect()}
    assert got == {
        "circle": rule_files.CIRCLE, "other": rule_files.CIRCLE, "into-circle": rule_files.CIRCLE, "mixed": rule_files.MIXED, "below-mixed": rule_files.MIXED, "kindless": rule_files.BAD_KIND,
        "version": rule_files.BAD_VERSION, "list": rule_files.NOT_A_MAPPING, "broken": rule_files.NOT_A_MAPPING, "orphan": rule_files.NO_PARENT, "crossed": rule_files.OTHER_KIND,
    }
    assert rule_files.load_profile(profiles_, f"{at}/clients/music.yaml")["empty"] == {}
    for name in ("clients/circle.yaml", "clients/draft.yaml", "clients/nobody.yaml", "rules/net/common.yaml"):
        with pytest.raises(profiles.ProfileError):
            rule_files.load_profile(profiles_, f"{at}/{name}")
