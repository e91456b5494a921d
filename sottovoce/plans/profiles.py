"""Client rule sets: what a profile holds, how profiles inherit, and the sets used by the registered queries.

A profile is a small mapping that is known before a plan is built, so checks that it does not ask for never
enter the plan. Rules are kept by position, since one id may be declared twice.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from sottovoce.operators.fixes import BY_FILE, FIXES

KINDS = ("sdh", "translation", "common")
CHECKING = ("sdh", "translation")
HEADER = ("platform", "kind", "status", "source")
#: Keys that belong to sound description alone.
SDH_ONLY = ("sound_effect", "speaker_id")


class ProfileError(ValueError):
    pass


def merge(parent: Mapping[str, Any], child: Mapping[str, Any]) -> dict[str, Any]:
    """Child over parent: one level of nesting is merged, lists are replaced. A rule id of the child replaces all
    rules of that id in the parent; the child's rules come last; ids that it disables go, its own too."""
    out = dict(parent)
    for key, value in child.items():
        if key in ("rules", "disable_rules"):
            continue
        out[key] = {**out[key], **value} if isinstance(value, Mapping) and isinstance(out.get(key), Mapping) else value
    off = set(child.get("disable_rules") or [])
    mine = [r for r in child.get("rules") or [] if r["id"] not in off]
    gone = {r["id"] for r in mine} | off
    out["rules"] = [r for r in parent.get("rules") or [] if r["id"] not in gone] + mine
    return out


def resolve(name: str, library: Mapping[str, Mapping[str, Any]], seen: tuple[str, ...] = ()) -> dict[str, Any]:
    """Follow ``extends`` to the root; cycles, unknown names and a parent of another kind are refused."""
    if name in seen:
        raise ProfileError(f"extends runs in a circle: {' -> '.join([*seen, name])}")
    if name not in library:
        raise ProfileError(f"no profile {name}")
    own = library[name]
    if not own.get("extends"):
        return dict(own)
    parent = resolve(own["extends"], library, (*seen, name))
    if parent.get("kind") not in ("common", own.get("kind")):
        raise ProfileError(f"{name} extends a profile of another kind")
    return merge(parent, own)


def validated(profile: Mapping[str, Any]) -> Mapping[str, Any]:
    for key in HEADER:
        if not profile.get(key):
            raise ProfileError(f"{key} is missing")
    if profile.get("schema_version") != 1:
        raise ProfileError("unknown schema version")
    if profile["kind"] not in KINDS:
        raise ProfileError(f"unknown kind {profile['kind']}")
    if profile["kind"] not in CHECKING:
        raise ProfileError(f"cues are not checked by a profile of kind {profile['kind']}")
    if not (isinstance(profile["source"], Mapping) and (profile["source"].get("official") or profile["source"].get("client"))):
        raise ProfileError("the source is neither an official document nor a client")
    if profile["status"] != "complete":
        raise ProfileError("the profile is not complete")
    if profile["kind"] == "translation" and (bad := [k for k in SDH_ONLY if k in profile]):
        raise ProfileError(f"a translation profile has {', '.join(bad)}")
    return profile


def with_genre(profile: Mapping[str, Any], name: str | None, genres: Mapping[str, Mapping[str, Any]]) -> dict[str, Any]:
    """The profile with a genre's part over it. The genre's source stands beside the profile's, not in its place."""
    if not name:
        return dict(profile)
    if name not in genres:
        raise ProfileError(f"no genre {name}; there are {', '.join(sorted(genres))}")
    part = {k: v for k, v in genres[name].items() if k not in ("source", "schema_version", "label")}
    source = genres[name].get("source")
    return {**merge(profile, part), "genre": part.get("genre", name), **({"genre_source": source} if source else {})}


def recommended_ms(profile: Mapping[str, Any]) -> tuple[int | None, int | None]:
    """Shortest and longest recommended duration of a profile's genre."""
    low, high = (profile.get("spotting") or {}).get("recommended_ms") or (None, None)
    return low, high


#: Recommended durations of the genres, and whether they forbid the plain form of address.
GENRES: dict[str, Any] = {
    "documentary": {"genre": "documentary", "source": {"client": "practice"}, "spotting": {"recommended_ms": [3000, 5000]}, "address": {"forbid_ssi": True}},
    "drama": {"genre": "drama", "source": {"client": "practice"}, "spotting": {"recommended_ms": [2000, 3000]}, "address": {"forbid_ssi": False}},
    "variety": {"genre": "variety", "source": {"client": "practice"}, "spotting": {"recommended_ms": [None, 2000]}, "address": {"forbid_ssi": True}},
}


def rules_table(spark: SparkSession, profiles: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """(profile, pos, rule_id, clause, check, auto, message): one row for each check that a rule names."""
    rows = []
    for name, profile in profiles.items():
        for rule in profile.get("rules") or []:
            checks = rule["check"] if isinstance(rule["check"], list) else [rule["check"]]
            rows += [(name, len(rows) + i, rule["id"], rule.get("clause", ""), c, bool(rule.get("auto")), rule.get("message", "")) for i, c in enumerate(checks)]
    return spark.createDataFrame(rows, "profile string, pos int, rule_id string, clause string, check string, auto boolean, message string")


#: A profile that turns every check and every fixer on, for the registered queries: values are those of common client sets.
FULL: dict[str, Any] = {
    "schema_version": 1, "platform": "sample", "kind": "sdh", "status": "complete", "source": {"client": "sample"}, "language": "ko",
    "limits": {"duration_ms": {"min": 833, "max": 7000}, "max_lines": 1, "chars_per_line": 16, "char_weights": {"cjk": 1.0, "other": 0.5}, "reading_speed_cps": {"adult": 14, "children": 11}, "optimal_cps": 10, "words_per_minute": 160, "merge_shorter_than_ms": 1200, "min_gap_ms": 0, "min_gap_frames": 2},
    "dual_speaker": {"marker": "- "},
    "foreign_dialogue": {"forbidden_markers": ["[외국어]", "and "]},
    "sound_effect": {"discouraged_endings": ["소리", "소음"], "discouraged_labels": ["말을 더듬으며", "er "], "discouraged_expressions": ["[정적]", "the "], "enclosure": "[]"},
    "music": {"music_note": "♪", "space_between_note_and_text": True, "capitalize_line_start": True, "note_inside_bracket": True},
    "address": {"forbid_ssi": True},
    "text": {"forbidden_punctuation": [":", ";", "!"], "ellipsis_char": "…", "ellipsis_consistency_required": True, "double_punctuation": "forbidden", "tilde": "forbidden", "no_comma_after_conjunctive_adverb": True},
    "speaker_id": {"enclosure": "()"}, "tone": {"enclosure": "[]"},
    "censorship": {"bleeped_word": "*", "full_sentence_bleep": "[음 소거 효과음]"},
    "songs": {"forbidden_punctuation": [",", "."], "lyrics_with_dialogue_in_one_event": "forbidden"},
    "credit": {"translator_credit": "forbidden"}, "delivery": {"first_cue_not_at_zero": True}, "numbers": {"range_notation_strict": True},
    "forced_narrative": {"marker": "double_quote"}, "collision": {"policy": "move_dialogue", "move_to": "top_center"},
    "rules": [{"id": f"A{i:02d}", "check": name, "auto": True} for i, name in enumerate([*BY_FILE, *FIXES], 1)],
}
