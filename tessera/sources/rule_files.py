"""Rules and policies from files, checked on the driver: they are small and decide how plans are built."""

from __future__ import annotations

import difflib
import json
import re
from pathlib import Path

from tessera.operators.policy import Policy, PolicyError, parse_policy

# Categories that a rule may have.
CATEGORIES = {
    "prompt_injection", "jailbreak", "system_prompt_leak", "data_exfiltration", "encoding_evasion", "code_execution", "credential_access", "excessive_agency", "dos_attempt", "forged_trust",
    "pii_detected", "social_engineering", "supply_chain", "agentic_abuse", "tool_misuse", "role_confusion", "toxic_content", "out",
}
DETECTORS = {"phrase_repeat"}


class RuleError(ValueError):
    """A rule file that names something unknown."""


def load_rules(path: str | Path) -> tuple[list[tuple], list[tuple]]:
    """(pattern rules, repetition rules) of a JSON list of {id, category, score, severity, pattern | detector, ...}.

    An unknown category or detector raises; a pattern that does not compile is left out; a file that is missing or no
    JSON gives no rules. Rules of detectors come apart, as they run first.
    """
    try:
        raw = json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return [], []
    patterns, detectors = [], []
    for r in raw:
        if r["category"] not in CATEGORIES:
            near = difflib.get_close_matches(r["category"], sorted(CATEGORIES), n=1)
            raise RuleError(f"{r['id']}: unknown category {r['category']!r}" + (f", perhaps {near[0]!r}" if near else ""))
        if "detector" in r:
            if r["detector"] not in DETECTORS:
                raise RuleError(f"{r['id']}: unknown detector {r['detector']!r}")
            p = r.get("detector_params", {})
            detectors.append((r["id"], r["category"], float(r["score"]), p.get("min_unit", 5), p.get("max_unit", 50), p.get("min_repeats", 21)))
            continue
        try:
            re.compile(r["pattern"])
        except re.error:
            continue
        patterns.append((r["id"], r["category"], float(r["score"]), r.get("severity", "medium"), r["pattern"]))
    return patterns, detectors


def load_policy(path: str | Path | None = None, default: str = "policy.json") -> Policy | None:
    """A policy from a path, or from the default name where that exists; None where there is none or it is not valid,
    so that scans only detect. YAML is read where its library is installed."""
    target = Path(path) if path else Path(default)
    try:
        text = target.read_text()
    except OSError:
        return None
    try:
        if target.suffix in (".yaml", ".yml"):
            import yaml

            return parse_policy(yaml.safe_load(text))
        return parse_policy(text)
    except (ImportError, ValueError, PolicyError):
        return None
