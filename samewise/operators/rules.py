"""Checks of a rule set before anything runs: what is wrong, and where."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from samewise.functions.text import STEPS

OPERATORS = {"equals", "not_equals", "in", "not_in", "is_null", "not_null", "starts_with", "starts_with_token", "ends_with_token", "contains_token", "matches"}
VETOES = {"differs", "not_equal_or_missing", "abs_diff_gt", "abs_diff_gte", "similarity_lt", "both_in_and_differ", "no_overlap"}


def validate(ruleset: Mapping, columns: Sequence[str]) -> list[tuple[str, str]]:
    """(path, message) of every fault; an empty list is a sound rule set.

    ruleset: tracks, default_track, track_rules, derived, cleaning {track:
    steps}, match_keys, vetoes. Steps may read input columns and what earlier
    steps of their track write; keys and vetoes see what all steps wrote.
    """
    faults: list[tuple[str, str]] = []
    say = lambda path, text: faults.append((path, text))
    tracks = set(ruleset.get("tracks", []))
    if not tracks:
        say("tracks", "no tracks")
    if ruleset.get("default_track") not in tracks:
        say("default_track", "not one of the tracks")
    known = set(columns)

    def conditions(path: str, specs, seen: set[str]) -> None:
        for i, c in enumerate(specs):
            at = f"{path}[{i}]"
            if c.get("op") not in OPERATORS:
                say(f"{at}.op", f"unknown condition {c.get('op')!r}")
            if c.get("column") not in seen:
                say(f"{at}.column", f"no column {c.get('column')!r}")
            if c.get("op") == "matches":
                pattern(f"{at}.value", c.get("value"))

    def pattern(path: str, text) -> None:
        try:
            re.compile(str(text))
        except re.error as e:
            say(path, f"not a pattern: {e}")

    for i, r in enumerate(ruleset.get("track_rules", [])):
        if r.get("track") not in tracks:
            say(f"track_rules[{i}].track", f"unknown track {r.get('track')!r}")
        conditions(f"track_rules[{i}].when", r.get("when", []), known)
    for i, dcol in enumerate(ruleset.get("derived", [])):
        if not dcol.get("target"):
            say(f"derived[{i}].target", "no target")
        if dcol.get("source") not in known:
            say(f"derived[{i}].source", f"no column {dcol.get('source')!r}")
        for j, r in enumerate(dcol.get("rules", [])):
            conditions(f"derived[{i}].rules[{j}].when", r.get("when", []), known)
        known.add(dcol.get("target"))
    written = set(known)
    for track, steps in ruleset.get("cleaning", {}).items():
        seen = set(known)
        if track not in tracks:
            say(f"cleaning.{track}", "unknown track")
        for i, s in enumerate(steps):
            at = f"cleaning.{track}[{i}]"
            if s.get("op") not in STEPS:
                say(f"{at}.op", f"unknown step {s.get('op')!r}")
            if s.get("source") not in seen:
                say(f"{at}.source", f"no column {s.get('source')!r}")
            if not s.get("target"):
                say(f"{at}.target", "no target")
            if s.get("op") == "regex_replace":
                pattern(f"{at}.args.pattern", s.get("args", {}).get("pattern", ""))
            seen.add(s.get("target"))
        written |= seen
    ids: set[str] = set()
    for i, k in enumerate(ruleset.get("match_keys", [])):
        at = f"match_keys[{i}]"
        if not k.get("id") or k["id"] in ids:
            say(f"{at}.id", "missing or used before")
        ids.add(k.get("id"))
        if not k.get("columns"):
            say(f"{at}.columns", "no columns")
        for c in k.get("columns", []):
            if c not in written:
                say(f"{at}.columns", f"no column {c!r}")
        conditions(f"{at}.when", k.get("when", []), written)
    for i, v in enumerate(ruleset.get("vetoes", [])):
        at = f"vetoes[{i}]"
        if v.get("action") not in ("review", "reject"):
            say(f"{at}.action", "review or reject")
        for j, c in enumerate(v.get("when", [])):
            if c.get("op") not in VETOES:
                say(f"{at}.when[{j}].op", f"unknown test {c.get('op')!r}")
            if c.get("column") not in written and c.get("op") != "not_equal_or_missing":
                say(f"{at}.when[{j}].column", f"no column {c.get('column')!r}")
    return faults
