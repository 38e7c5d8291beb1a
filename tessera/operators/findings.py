"""Detection: rules on a text as one array column of findings, and what follows from findings.

A finding is struct<rule, category, score, matched>. Rules are literals, so each pattern is compiled once and a scan is
one projection without a join; findings keep the order of the rules. Texts are named: a column, or a lambda's variable in
the functions that give SQL. Where low names the text in lower case, a pattern is tried only if that holds a literal
that it needs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.checks import RESERVED_DOMAIN
from tessera.functions.gates import Sieved, gated, holds_none, may_match, quoted
from tessera.rules import fixed

FINDING = "array<struct<rule:string,category:string,score:double,matched:string>>"
#: Of a match, so many characters are kept.
SHOWN = 100
#: Score of findings in several categories; matches of an address that make a list of addresses.
BOOST, MANY = 1.3, 3


def pattern(text: str, ignore_case: bool = True, dot_all: bool = False) -> str:
    flags = "i" * ignore_case + "s" * dot_all
    return f"(?{flags}){text}" if flags else text


def _struct(rule: str, category: str, score: str, matched: str = "cast(null as string)") -> str:
    return f"named_struct('rule', {quoted(rule)}, 'category', {quoted(category)}, 'score', cast({score} as double), 'matched', {matched})"


def _list(cases: list[tuple[str, str]]) -> str:
    """SQL for the findings of those cases (condition, finding) that hold."""
    return f"cast(filter(array({', '.join(f'case when {fires} then {found} end' for fires, found in cases)}), f -> f is not null) as {FINDING})"


def _gated_list(cases: list[tuple[str, str, str]], low: str | None) -> str:
    """As _list, of cases with the pattern that each needs. Where the text holds no literal of any of them, only those
    that need none are tried."""
    every = _list([c[:2] for c in cases])
    known = [c[2] for c in cases if isinstance(low, Sieved) and low.knows(c[2])]
    if not known:
        return every
    others = [c[:2] for c in cases if c[2] not in known]
    return f"case when {holds_none(low, known)} then {_list(others) if others else f'cast(array() as {FINDING})'} else {every} end"


def _live(text: str, p: str) -> str:
    """SQL for the matches of a pattern of addresses outside the reserved domains."""
    return f"filter(regexp_extract_all({text}, {quoted(f'({p})')}, 0), x -> not rlike(x, {quoted(RESERVED_DOMAIN)}))"


def scanned_sql(text: str, rules: list[tuple], reserved: set[str] = frozenset(), low: str | None = None) -> str:
    """A finding of each rule (id, category, score, severity, pattern) that matches anywhere.

    reserved: rules that count only with an address outside the reserved domains.
    """
    out = []
    for rule, category, score, _, bare in rules:
        p = pattern(bare)
        fires = gated(text, bare, p, low)
        if rule in reserved:
            fires = f"({fires} and size({_live(text, p)}) > 0)"
        out.append((fires, _struct(rule, category, str(score), f"substring(regexp_extract({text}, {quoted(p)}, 0), 1, {SHOWN})"), bare))
    return _gated_list(out, low)


def scanned(text: str, rules: list[tuple], reserved: set[str] = frozenset(), low: str | None = None) -> Column:
    return F.expr(scanned_sql(text, rules, reserved, low))


def united(first: Column, second: Column) -> Column:
    """First findings, then those of second whose rule is not among them."""
    rules = F.transform(first, lambda x: x["rule"])
    return F.concat(first, F.filter(second, lambda x: ~F.array_contains(rules, x["rule"])))


def top_score(findings: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(findings, lambda x: x["score"])), F.lit(0.0))


def categories(findings: Column) -> Column:
    return F.array_distinct(F.transform(findings, lambda x: x["category"]))


def rule_score(findings: Column) -> Column:
    """The largest score, raised where findings lie in several categories."""
    top = top_score(findings)
    return F.when(F.size(categories(findings)) >= 2, F.least(F.lit(1.0), top * BOOST)).otherwise(top)


def outputs_sql(text: str, low: str | None = None) -> str:
    """Findings of the rules on model outputs."""
    return scanned_sql(text, fixed.OUTPUT_RULES, fixed.RESERVED_FILTERED, low)


def outputs(text: str, low: str | None = None) -> Column:
    return F.expr(outputs_sql(text, low))


def intents_sql(text: str, low: str | None = None) -> str:
    """A question about the model itself, then intents: an action and a target anywhere; a modifier raises the score."""
    match = lambda p: gated(text, p, pattern(p), low)
    out = [(gated(text, fixed.SELF_REFERENCE, pattern(fixed.SELF_REFERENCE, dot_all=True), low), _struct("L2_self_reference", "system_prompt_leak", str(fixed.SELF_REFERENCE_SCORE)), fixed.SELF_REFERENCE)]
    for name, category, base, raised, actions, targets, modifiers in fixed.INTENTS:
        out.append((f"({match(targets)} and {match(actions)})", _struct(name, category, f"case when {match(modifiers)} then {raised} else {base} end"), targets))
    return _gated_list(out, low)


def intents(text: str, low: str | None = None) -> Column:
    return F.expr(intents_sql(text, low))


def _composites_sql(found: str) -> str:
    """Composites over an array of categories: each group has a category among them. Those without groups never fire."""
    fires = lambda groups: " and ".join(f"arrays_overlap({found}, array({', '.join(map(quoted, g))}))" for g in groups)
    return _list([(fires(groups), _struct(name, category, str(score))) for name, category, score, groups in fixed.COMPOSITES if groups])


def behaviours_sql(first: str, found: str) -> str:
    """Intents (first) and then composites over their categories and those of what was found before."""
    both = ", ".join(f"array_distinct(transform({x}, f -> f.category))" for x in (found, first))
    return f"concat({first}, transform(array(array_union({both})), c -> {_composites_sql('c')})[0])"


def behaviours(first: str, found: str) -> Column:
    return F.expr(behaviours_sql(first, found))


def data_loss_sql(text: str, only: set[str] | None = None, low: str | None = None) -> str:
    """Personal data and secrets. A card number counts if the first candidate has 13 to 19 digits and a right check
    digit; addresses, if there are MANY outside the reserved domains. only: categories to look for."""
    out = []
    for rule, category, score, ignore_case, mode, bare in fixed.DATA_LOSS:
        if only is not None and category not in only:
            continue
        p = pattern(bare, ignore_case)
        fires, first = gated(text, bare, p, low), f"regexp_extract({text}, {quoted(p)}, 0)"
        if mode == "luhn":
            number = f"regexp_replace({first}, '[^0-9]', '')"
            fires = f"({fires} and length({number}) between 13 and 19 and luhn_check({number}))"
        elif mode == "count":
            fires = f"({fires} and size({_live(text, p)}) >= {MANY})"
        out.append((fires, _struct(rule, category, str(score), f"substring({first}, 1, 50)"), bare))
    return _gated_list(out, low)


def data_loss(text: str, only: set[str] | None = None, low: str | None = None) -> Column:
    return F.expr(data_loss_sql(text, only, low))


#: Secrets that are blocked in the arguments of tools; an inline password is not sure enough.
SURE_SECRETS = {"secret_api_key", "secret_github_token", "secret_aws_key", "secret_private_key", "secret_connection_string", "secret_jwt"}
AGENT_TRAFFIC = ("a2a", "agent", "mcp")
STRONG, MEDIUM, WEAK = 0.65, 0.45, 0.30


def concepts_sql(text: str, low: str | None = None) -> dict[str, str]:
    """Whether a text holds each concept, and as imperative, whether a sentence of it begins as an order."""
    has = {k: gated(text, p, pattern(p), low) for k, p in fixed.CONCEPTS.items()}
    order = fixed.CONCEPTS["imperative"]
    sentence = f"exists(split({text}, '[.!?]'), s -> rlike(trim(s), {quoted(pattern(order))}))"
    has["imperative"] = f"({may_match(low, order)} and {sentence})" if low else sentence
    return has


def concepts(text: str, low: str | None = None) -> dict[str, Column]:
    return {k: F.expr(c) for k, c in concepts_sql(text, low).items()}


def relations_sql(text: str, mode: str, has: dict[str, str]) -> str:
    """Relations between concepts (an order to an assistant to drop its rules, and the like), as findings.

    Where nothing is aimed at an assistant, protected or an order, no score exceeds .04. Between agents scores are
    raised by a third, to .85 at most. mode: chat, one of AGENT_TRAFFIC, or SQL that tells them apart record by record. has: the concepts of the text, by name or as SQL.
    """
    h = has
    order, protected, loose = h["imperative"], f"({h['protected']} or {h['secret']})", f"({h['negation']} or {h['unsafe']})"
    either = f"({h['override']} or {protected})"
    ai = f"(case when contains(lower({text}), 'system') and {h['other_system']} then {h['ai']} else {h['ai']} or {h['system_ai']} or ({order} and {protected}) end)"
    rules = [
        ("role_negated_safety", "role_override", STRONG, f"{h['role']} and {loose} and {protected}"),
        ("role_negated_implied", "role_override", MEDIUM, f"{h['role']} and {loose} and not {protected}"),
        ("ai_negated_safety", "safety_negation", STRONG, f"{h['negation']} and {protected} and not {h['role']} and {ai}"),
        ("authority_override", "authority", STRONG, f"{h['authority']} and {h['authority_verb']} and {either}"),
        ("authorization_override", "authority", MEDIUM, f"{h['authority_verb']} and {either} and {ai}"),
        ("behavior_modification", "behavior_change", MEDIUM, f"{h['behavior']} and {loose} and ({order} or {ai})"),
        ("direct_override_safety", "override", STRONG, f"{h['override']} and {protected} and {ai}"),
        ("imperative_override_safety", "override", WEAK, f"{h['override']} and {protected} and {order} and not {ai}"),
        ("named_persona", "persona", MEDIUM, f"{h['role']} and {h['persona']}"),
        ("behavior_override_safety", "behavior_change", MEDIUM, f"{h['behavior']} and {h['override']} and {protected}"),
        ("exfiltrate_secret", "exfiltration", STRONG, f"{h['exfiltration']} and {h['secret']}"),
        ("exfiltrate_protected", "exfiltration", MEDIUM, f"{h['exfiltration']} and not {h['secret']} and {protected} and {ai}"),
    ]
    more = lambda x: f"least({x} * 1.3D, 0.85D)"
    raised = more if mode in AGENT_TRAFFIC else (lambda x: x) if mode == "chat" else (lambda x: f"case when {mode} then {more(x)} else {x} end")
    score = lambda x: f"round({raised(f'case when not {ai} and not {protected} and not {order} then least({x}D, 0.04D) else {x}D end')}, 4)"
    return _list([(fires, _struct(rule, category, score(x))) for rule, category, x, fires in rules])


def relations(text: str, mode: str, has: dict[str, str]) -> Column:
    return F.expr(relations_sql(text, mode, has))
