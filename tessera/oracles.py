"""SQL for DuckDB that says what queries must return, made from the same rule tables."""

from __future__ import annotations

from tessera.functions.text import LEET, LOOK_ALIKES
from tessera.probes import RECORDS_SQL, SQLS, TOKENS, URLS, quoted, values
from tessera.rules import fixed

RESERVED = r"(?i)(@|\.)example\.(com|net|org)$|\.(test|example|invalid|localhost)$"


def _match(pattern: str, options: str = "i") -> str:
    return f"regexp_matches(t, {quoted(pattern)}, {quoted(options)})" if options else f"regexp_matches(t, {quoted(pattern)})"


def _live_addresses(pattern: str) -> str:
    return f"len(list_filter(regexp_extract_all(t, {quoted(pattern)}, 0, 'i'), lambda x: NOT regexp_matches(x, {quoted(RESERVED)})))"


def _union(cases: list[tuple[str, str, str, str]]) -> str:
    """Findings: (rule, category, score, condition) as rows."""
    return "\n  UNION ALL ".join(f"SELECT conv_id, turn, {k} AS ord, {quoted(rule)} AS rule, {quoted(category)} AS category, CAST({score} AS DOUBLE) AS score FROM records WHERE {cond}" for k, (rule, category, score, cond) in enumerate(cases))


OUTPUT = _union([(r, c, s, f"{_live_addresses(p)} > 0" if r in fixed.RESERVED_FILTERED else _match(p)) for r, c, s, _, p in fixed.OUTPUT_RULES])
INTENT = _union(
    [("L2_self_reference", "system_prompt_leak", fixed.SELF_REFERENCE_SCORE, _match(fixed.SELF_REFERENCE, "is"))]
    + [(n, c, f"CASE WHEN {_match(m)} THEN {up} ELSE {base} END", f"{_match(a)} AND {_match(t)}") for n, c, base, up, a, t, m in fixed.INTENTS]
)
_digits = "list_transform(string_split(regexp_replace(regexp_extract(t, {p}, 0), '[^0-9]', '', 'g'), ''), lambda d: CAST(d AS INTEGER))"


def _luhn(pattern: str) -> str:
    d = _digits.format(p=quoted(pattern))
    total = f"list_sum(list_transform(list_zip({d}, range(1, len({d}) + 1)), lambda z: CASE WHEN (len({d}) - z[2]) % 2 = 1 THEN CASE WHEN z[1] * 2 > 9 THEN z[1] * 2 - 9 ELSE z[1] * 2 END ELSE z[1] END))"
    return f"{_match(pattern, '')} AND len({d}) BETWEEN 13 AND 19 AND {total} % 10 = 0"


LOSS = _union([(r, c, s, _luhn(p) if mode == "luhn" else f"{_live_addresses(p)} >= 3" if mode == "count" else _match(p, "i" if ci else "")) for r, c, s, ci, mode, p in fixed.DATA_LOSS])
_has = {k: _match(p) for k, p in fixed.CONCEPTS.items() if k != "imperative"}
_order = f"len(list_filter(regexp_split_to_array(t, '[.!?]'), lambda s: regexp_matches(trim(s), {quoted(fixed.CONCEPTS['imperative'])}, 'i'))) > 0"
CONCEPTS = "concepts AS (SELECT conv_id, turn, t, " + ", ".join(f"{v} AS {k}_" for k, v in _has.items()) + f", {_order} AS order_ FROM records)"
FACTS = """facts AS (SELECT *, protected_ OR secret_ AS p, negation_ OR unsafe_ AS loose,
  CASE WHEN contains(lower(t), 'system') AND other_system_ THEN ai_ ELSE ai_ OR system_ai_ OR (order_ AND (protected_ OR secret_)) END AS ai FROM concepts)"""
_RELATIONS = [
    ("role_negated_safety", "role_override", 0.65, "role_ AND loose AND p"), ("role_negated_implied", "role_override", 0.45, "role_ AND loose AND NOT p"),
    ("ai_negated_safety", "safety_negation", 0.65, "ai AND negation_ AND p AND NOT role_"), ("authority_override", "authority", 0.65, "authority_ AND authority_verb_ AND (override_ OR p)"),
    ("authorization_override", "authority", 0.45, "authority_verb_ AND ai AND (override_ OR p)"), ("behavior_modification", "behavior_change", 0.45, "behavior_ AND (ai OR order_) AND loose"),
    ("direct_override_safety", "override", 0.65, "override_ AND ai AND p"), ("imperative_override_safety", "override", 0.30, "override_ AND p AND order_ AND NOT ai"),
    ("named_persona", "persona", 0.45, "role_ AND persona_"), ("behavior_override_safety", "behavior_change", 0.45, "behavior_ AND override_ AND p"),
    ("exfiltrate_secret", "exfiltration", 0.65, "exfiltration_ AND secret_"), ("exfiltrate_protected", "exfiltration", 0.45, "exfiltration_ AND NOT secret_ AND ai AND p"),
]
RELATED = "\n  UNION ALL ".join(f"SELECT conv_id, turn, {k} AS ord, '{r}' AS rule, '{c}' AS category, CASE WHEN NOT ai AND NOT p AND NOT order_ THEN least({s}, 0.04) ELSE {s} END::DOUBLE AS score FROM facts WHERE {cond}" for k, (r, c, s, cond) in enumerate(_RELATIONS))
_with_composites = "\n  UNION ALL ".join(
    f"SELECT conv_id, turn, {100 + k} AS ord, '{n}' AS rule, '{c}' AS category, CAST({s} AS DOUBLE) AS score FROM cats WHERE " + " AND ".join("list_has_any(cs, [" + ", ".join(map(quoted, g)) + "])" for g in groups)
    for k, (n, c, s, groups) in enumerate(fixed.COMPOSITES)
    if groups
)
ALL = f"""WITH {RECORDS_SQL},
l1 AS ({OUTPUT}),
intents AS ({INTENT}),
cats AS (SELECT conv_id, turn, list(DISTINCT category) AS cs FROM (SELECT * FROM l1 UNION ALL SELECT * FROM intents) GROUP BY ALL),
l2 AS (SELECT * FROM intents UNION ALL {_with_composites}),
dlp AS ({LOSS}),
{CONCEPTS},
{FACTS},
related AS ({RELATED}),
scores AS (
  SELECT r.conv_id, r.turn, r.role, r.text,
    coalesce((SELECT CASE WHEN count(DISTINCT category) >= 2 THEN least(1.0, max(score) * 1.3) ELSE max(score) END FROM l1 x WHERE x.conv_id = r.conv_id AND x.turn = r.turn), 0) AS a,
    coalesce((SELECT max(score) FROM l2 x WHERE x.conv_id = r.conv_id AND x.turn = r.turn), 0) AS b,
    coalesce((SELECT max(score) FROM dlp x WHERE x.conv_id = r.conv_id AND x.turn = r.turn), 0) AS c,
    coalesce((SELECT max(score) FROM related x WHERE x.conv_id = r.conv_id AND x.turn = r.turn), 0) AS d
  FROM records r),
fused AS (
  SELECT *, (a > 0)::INT + (b > 0)::INT + (c > 0)::INT AS n, greatest(a, b, c) AS top FROM scores),
exact AS (
  SELECT *, greatest(CASE WHEN n >= 3 THEN least(1.0, least(1.0, top * 1.2) * 1.1) WHEN n = 2 THEN least(1.0, top * 1.2) ELSE top END, d) AS score FROM fused),
verdicts AS (
  SELECT conv_id, turn, role, text, score, CASE WHEN score >= 0.60 THEN 'blocked' WHEN score >= 0.20 THEN 'flagged' ELSE 'allowed' END AS true_action FROM exact),
fired AS (
  SELECT conv_id, turn, rule FROM l1 UNION ALL SELECT conv_id, turn, rule FROM l2 UNION ALL SELECT conv_id, turn, rule FROM dlp UNION ALL SELECT conv_id, turn, rule FROM related)
"""
