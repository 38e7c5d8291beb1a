"""Action policies: checked on the driver, evaluated as columns. The first rule that matches decides."""

from __future__ import annotations

import difflib
import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.checks import matches_any_glob

# Fields of a rule and the columns they look at, effects, and how strict decisions are.
MATCH = {
    "tools": "tool_name", "agents": "agent_id", "impact_class": "impact_class", "impact_tier": "impact_tier", "destination_type": "destination_type",
    "destination_identifier": "destination_identifier", "mcp_server": "mcp_server", "category": "category",
}
CONDITIONS = {"min_chain_tier_above"}
EFFECTS = {"allow": "allowed", "block": "blocked", "monitor": "monitor", "require_approval": "approval_required"}
SEVERITY = {"allowed": 0, "monitor": 1, "flagged": 1, "approval_required": 2, "blocked": 3}
UNKNOWN_TIER = 4


class PolicyError(ValueError):
    """A policy that cannot be taken as it is; none of it applies."""


@dataclass
class Rule:
    id: str
    effect: str
    match: dict[str, list[str]] = field(default_factory=dict)
    above: float | None = None
    message: str | None = None


@dataclass
class Policy:
    rules: list[Rule]
    effect: str = "allow"
    unclassified: str = "monitor"


def _known(rule: str, block: str, keys, known) -> None:
    for key in keys:
        if key not in known:
            near = difflib.get_close_matches(str(key), sorted(known), n=1)
            raise PolicyError(f"rule {rule!r}: unknown key {key!r} under {block!r}" + (f", perhaps {near[0]!r}" if near else ""))


def parse_policy(source: dict | str) -> Policy:
    """A checked policy. An unknown key would make a rule that never fires, so it rejects the policy as a whole."""
    raw = json.loads(source) if isinstance(source, str) else source
    if not isinstance(raw, dict) or raw.get("version") not in ("1", "1.0", 1):
        raise PolicyError("a policy is an object of version 1")
    rules = []
    for k, r in enumerate(raw.get("rules") or []):
        name = str(r.get("id", k))
        if r.get("effect") not in EFFECTS:
            raise PolicyError(f"rule {name!r}: effect is one of {sorted(EFFECTS)}")
        match, conditions = r.get("match") or {}, r.get("conditions") or {}
        if "trust_below" in conditions:
            raise PolicyError(f"rule {name!r}: trust_below can never hold here")
        _known(name, "match", match, MATCH)
        _known(name, "conditions", conditions, CONDITIONS)
        lists = {key: [str(v) for v in (value if isinstance(value, list) else [value])] for key, value in match.items()}
        above = conditions.get("min_chain_tier_above")
        if above is not None and (isinstance(above, bool) or not isinstance(above, (int, float))):
            raise PolicyError(f"rule {name!r}: min_chain_tier_above is a number")
        rules.append(Rule(name, r["effect"], lists, above, r.get("message")))
    defaults = raw.get("defaults") or {}
    policy = Policy(rules, defaults.get("effect", "allow"), defaults.get("unclassified", "monitor"))
    for effect in (policy.effect, policy.unclassified):
        if effect not in EFFECTS:
            raise PolicyError(f"defaults: {effect!r} is no effect")
    return policy


def _matches(rule: Rule) -> Column:
    """All fields of the rule match; a rule without any matches nothing, nor does a null."""
    parts = [matches_any_glob(F.col(MATCH[k]), globs) for k, globs in rule.match.items()]
    if rule.above is not None:
        parts.append(F.coalesce(F.col("least_privileged_tier") > rule.above, F.lit(False)))
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(False)


def evaluated(requests: DataFrame, policy: Policy) -> DataFrame:
    """requests with decision and policy_id. Columns that a rule looks at and requests lack are null."""
    for c in [*MATCH.values(), "least_privileged_tier"]:
        if c not in requests.columns:
            requests = requests.withColumn(c, F.lit(None).cast("double" if c == "least_privileged_tier" else "string"))
    default = F.when(F.coalesce("impact_class", F.lit("unknown")) == "unknown", EFFECTS[policy.unclassified]).otherwise(EFFECTS[policy.effect])
    decision, name = None, None
    for rule in policy.rules:
        hit = _matches(rule)
        decision = (F.when if decision is None else decision.when)(hit, EFFECTS[rule.effect])
        name = (F.when if name is None else name.when)(hit, rule.id)
    return requests.withColumns({"decision": default if decision is None else decision.otherwise(default), "policy_id": F.lit(None).cast("string") if name is None else name})


def evaluated_by_join(requests: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """The same as a join, for policies kept as a table: rules (ordinal, id, effect, tool_glob, class_glob), each glob
    null or a LIKE pattern. Rules are few, which a broadcast of more than 10 000 would contradict."""
    n = rules.count()
    if n > 10_000:
        raise PolicyError(f"{n} rules are no policy")
    small = F.broadcast(rules.withColumnRenamed("id", "rule_id"))
    fits = F.expr("(tool_glob is null or lower(tool_name) like lower(tool_glob)) and (class_glob is null or lower(impact_class) like lower(class_glob)) and (tool_glob is not null or class_glob is not null)")
    met = requests.join(small, fits, "left")
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.col("ordinal").asc_nulls_last()))
    return met.withColumn("place", first).where("place = 1").drop("place", "ordinal", "tool_glob", "class_glob")


def severity(decision: Column) -> Column:
    out = F.lit(0)
    for name, s in SEVERITY.items():
        out = F.when(decision == name, s).otherwise(out)
    return out


def composed(action: Column, decision: Column) -> Column:
    """The stricter of what a scan and a policy say; a policy that monitors flags."""
    asked = F.when(decision == "monitor", "flagged").otherwise(decision)
    return F.when(severity(asked) > severity(action), asked).otherwise(action)


def annotated(df: DataFrame) -> DataFrame:
    """df (action, category, rules, score, decision, policy_id) with what the policy adds where it does not allow."""
    acts = F.coalesce(F.col("decision") != "allowed", F.lit(False))
    floor = F.when(F.col("decision").isin("blocked", "approval_required"), 0.6).otherwise(0.3)
    tag = F.when(F.col("policy_id").isNotNull(), F.concat(F.lit("policy:"), "policy_id")).otherwise("policy")
    return df.withColumns(
        {
            "action": composed(F.col("action"), F.col("decision")),
            "category": F.when(acts, F.coalesce("category", F.lit("policy"))).otherwise(F.col("category")),
            "rules": F.when(acts, F.array_append("rules", tag)).otherwise(F.col("rules")),
            "score": F.when(acts, F.greatest("score", floor)).otherwise(F.col("score")),
        }
    )


def least_privileged_tier(own: Column, upstream: Column) -> Column:
    """The largest tier (the least privilege) of an agent and of those it acts for; an unknown tier counts as the
    least. Null where nothing was delegated."""
    tiers = F.transform(F.concat(F.array(own), upstream), lambda x: F.coalesce(x, F.lit(UNKNOWN_TIER)))
    return F.when(F.size(upstream) > 0, F.array_max(tiers))


def destination_decision(url: Column, policy: Policy, requests: DataFrame) -> DataFrame:
    """requests with destination_blocked: a fixed request for the URL's host and for the URL; what is neither allowed
    nor monitored is blocked in every mode."""
    fixed = {"tool_name": F.lit("http_request"), "impact_class": F.lit("network"), "impact_tier": F.lit("external"), "destination_type": F.lit("external_api")}
    kept = requests.columns
    out = requests.withColumn("destination_blocked", F.lit(False))
    for target in (F.try_parse_url(url, F.lit("HOST")), url):
        found = evaluated(out.select(*kept, "destination_blocked").withColumns(fixed | {"destination_identifier": target}), policy)
        out = found.withColumn("destination_blocked", F.col("destination_blocked") | (~F.col("decision").isin("allowed", "monitor") & F.col("destination_identifier").isNotNull()))
    return out.select(*kept, "destination_blocked")


def is_listed(value: Column, exact: list[str] = (), parts: list[str] = ()) -> Column:
    """In a list of names, or with a part of a list in it whatever its case."""
    out = value.isin(*exact) if exact else F.lit(False)
    for p in parts:
        out = out | F.lower(value).contains(p.lower())
    return F.coalesce(out, F.lit(False))
