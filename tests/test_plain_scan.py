"""The normalised scan of outputs against a plain version of it, record by record, over a whole table and the probes."""

import re

import pytest

from tessera import catalog, probes
from tessera.functions.checks import RESERVED_DOMAIN
from tessera.functions.text import normalised_text
from tessera.operators.findings import BOOST, MANY
from tessera.rules import fixed

SF = "/root/testdata/sf0.001"


def find(p, text, flags=re.I):
    # To Java's word boundaries, characters beyond ASCII are letters.
    return re.search(p, re.sub(r"[^\x00-\x7F]", "x", text), flags | re.A)


def live(p, text):
    return [m[0] for m in re.finditer(p, text, re.I) if not re.search(RESERVED_DOMAIN, m[0])]


def card(number):
    d = [int(c) for c in re.sub("[^0-9]", "", number)]
    return 13 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if k % 2 else x for k, x in enumerate(reversed(d))) % 10 == 0


def rules(text):
    return [(r, c, s) for r, c, s, _, p in fixed.OUTPUT_RULES if find(p, text) and (r not in fixed.RESERVED_FILTERED or live(p, text))]


def behaviours(text, found):
    out = [("L2_self_reference", "system_prompt_leak", fixed.SELF_REFERENCE_SCORE)] if find(fixed.SELF_REFERENCE, text, re.I | re.S) else []
    out += [(n, c, up if find(m, text) else base) for n, c, base, up, a, t, m in fixed.INTENTS if find(a, text) and find(t, text)]
    categories = {c for _, c, _ in found} | {c for _, c, _ in out}
    return out + [(n, c, s) for n, c, s, groups in fixed.COMPOSITES if groups and all(categories & set(g) for g in groups)]


def losses(text):
    out = []
    for r, c, s, ignore, mode, p in fixed.DATA_LOSS:
        m = find(p, text, re.I if ignore else 0)
        if m and (card(m[0]) if mode == "luhn" else len(live(p, text)) >= MANY if mode == "count" else True):
            out.append((r, c, s))
    return out


def relations(text):
    has = {k: bool(find(p, text)) for k, p in fixed.CONCEPTS.items()}
    order = any(find(fixed.CONCEPTS["imperative"], s.strip(" ")) for s in re.split("[.!?]", text))
    guarded = has["protected"] or has["secret"]
    ai = has["ai"] or has["system_ai"] or order and guarded
    if "system" in text.lower() and has["other_system"]:
        ai = has["ai"]
    loose, role, override, told = has["negation"] or has["unsafe"], has["role"], has["override"], has["exfiltration"]
    table = [
        ("role_override", 0.65, role and loose and guarded), ("role_override", 0.45, role and loose and not guarded), ("safety_negation", 0.65, ai and has["negation"] and guarded and not role),
        ("authority", 0.65, has["authority"] and has["authority_verb"] and (override or guarded)), ("authority", 0.45, has["authority_verb"] and ai and (override or guarded)),
        ("behavior_change", 0.45, has["behavior"] and (ai or order) and loose), ("override", 0.65, override and ai and guarded), ("override", 0.30, override and guarded and order and not ai),
        ("persona", 0.45, role and has["persona"]), ("behavior_change", 0.45, has["behavior"] and override and guarded), ("exfiltration", 0.65, told and has["secret"]), ("exfiltration", 0.45, told and not has["secret"] and ai and guarded),
    ]
    return [("", c, s if ai or guarded or order else min(s, 0.04)) for c, s, fires in table if fires]


def top(found):
    return max((s for *_, s in found), default=0.0)


def verdict(raw):
    if raw is None:
        return 0.0, "input_not_scannable", "allowed"
    view = normalised_text(raw)
    l1 = rules(view)
    l1 += [f for f in rules(raw) if f[0] not in {r for r, *_ in l1}]
    l2, dlp, rel = behaviours(view, l1), losses(view), relations(view)
    a = min(1.0, top(l1) * BOOST) if len({c for _, c, _ in l1}) > 1 else top(l1)
    layers = [x for x in (a, top(l2), top(dlp)) if x > 0]
    fused = max(layers, default=0.0)
    fused = min(1.0, fused * 1.2) if len(layers) > 1 else fused
    fused = min(1.0, fused * 1.1) if len(layers) > 2 else fused
    score = max(fused, top(rel))
    first = next((f for f in l1 + l2 + dlp if f[2] == top(l1 + l2 + dlp)), None)
    lead = next((f for f in rel if f[2] == top(rel)), None)
    category = lead[1] if lead and lead[2] >= (first[2] if first else 0) else first[1] if first else None
    return score, category, "blocked" if score >= 0.6 else "flagged" if score >= 0.2 else "allowed"


def test_normalised_output_verdicts(spark):
    got = {(r.conv_id, r.turn): r for r in catalog.output_verdicts_normalised(spark, SF).collect()}
    rows = probes.records(spark, SF).collect()
    assert len(got) == len(rows)
    for r in rows:
        score, category, action = verdict(r.text)
        g = got[r.conv_id, r.turn]
        assert (g.score, g.category, g.true_action) == (pytest.approx(score, abs=6e-4), category, action), r
