"""Rules on what an action touches, from a file: checked on the driver entry by entry, as they decide how plans are built."""

from __future__ import annotations

import json
import logging
import re
from pathlib import Path

from tessera.operators.commands import SEGMENT_FIELDS
from tessera.rules.impact import TIERS, ImpactRules

log = logging.getLogger(__name__)
#: Fields of conditions by section, and those whose values are patterns; other values are lists of globs.
FIELDS = {"commands": SEGMENT_FIELDS, "sql": {"statement", "object_kind", "object", "predicate", "raw"}, "urls": {"scheme", "host", "address"}}
PATTERNS = {"commands": {"args", "target", "raw"}}


def _condition(section: str, cond: dict) -> dict:
    """A condition whose fields are known, whose patterns compile, and that asks for something; else an error."""
    if not isinstance(cond, dict) or not cond:
        raise ValueError("a condition is an object with fields")
    for key, value in cond.items():
        if key in ("any", "all"):
            if not value:
                raise ValueError(f"{key} is empty")
            for c in value:
                _condition(section, c)
        elif key == "not":
            _condition(section, value)
        elif key not in FIELDS[section]:
            raise ValueError(f"unknown field {key!r}")
        elif key in PATTERNS.get(section, ()):
            re.compile(value)
        elif key not in ("most_args", "expands") and not (isinstance(value, list) and value and all(isinstance(v, str) for v in value)):
            raise ValueError(f"{key} is a list of names")
    return cond


def _tier(entry: dict) -> str:
    if entry["tier"] not in TIERS:
        raise ValueError(f"unknown tier {entry['tier']!r}")
    return entry["tier"]


def _score(entry: dict) -> float | None:
    score = entry.get("score")
    return None if score is None else float(score)


def _ruled(section: str):
    return lambda e: (str(e["id"]), str(e["class"]), _tier(e), _condition(section, e["when"]), _score(e))


def _tool(e: dict) -> tuple:
    return ([str(g) for g in e["match"]], str(e["class"]), _tier(e), *([[str(g) for g in e["servers"]]] if "servers" in e else []))


def _combination(e: dict) -> tuple:
    return (str(e["id"]), str(e["class"]), _tier(e), _score(e), _condition("commands", e["first"]), _condition("commands", e["second"]))


def _escalation(e: dict) -> tuple:
    if e.get("value") is not None:
        re.compile(e["value"])
    return ([str(k) for k in e["keys"]], e.get("value"), _tier(e))


SECTIONS = {"tools": _tool, "commands": _ruled("commands"), "combinations": _combination, "sql": _ruled("sql"), "urls": _ruled("urls"), "escalations": _escalation}


def load_impact_rules(path: str | Path) -> ImpactRules:
    """Rules of a JSON object with sections: tools ({match, class, tier[, servers]}), commands, sql and urls ({id, class,
    tier, when[, score]}), combinations ({id, class, tier, score, first, second}), escalations ({keys, value, tier}).

    when, first and second are conditions: fields that all hold, any and all of further ones, and not. An entry that is
    not right is left out with a warning, and the others stay. A section that is not there keeps the rules of this
    library; so do all where the file is missing or no JSON object.
    """
    out = ImpactRules()
    try:
        raw = json.loads(Path(path).read_text())
        if not isinstance(raw, dict):
            raise ValueError("no JSON object")
    except (OSError, ValueError) as e:
        log.warning("%s: %s; the library's rules stay", path, e)
        return out
    for section, read in SECTIONS.items():
        if section not in raw:
            continue
        rules = []
        for k, entry in enumerate(raw[section]):
            try:
                rules.append(read(entry))
            except (KeyError, TypeError, ValueError, re.error) as e:
                log.warning("%s, %s %s: left out: %s", path, section, k, e)
        setattr(out, section, rules)
    return out
