"""Event rows: what is reported of a verdict. Texts never leave, only their hash and length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kind and way of an interaction by the direction of a scan.
INTERACTION = {"input": "prompt", "output": "response", "a2a": "a2a", "a2a_inbound": "a2a", "tool_call": "a2tool", "mcp": "a2mcp", "llm": "a2llm"}
WAY = {"input": "inbound", "output": "outbound", "a2a": "outbound", "a2a_inbound": "inbound", "tool_call": "outbound"}
SCHEMA_VERSION = "1.0"


def _looked_up(value: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(value == k, v).otherwise(out)
    return out


def detection_severity(action: Column, score: Column) -> Column:
    return F.when(action == "blocked", F.when(score >= 0.95, "critical").otherwise("high")).when(action == "flagged", F.when(score >= 0.90, "high").otherwise("medium")).when(action == "allowed", "info")


def detection_message(action: Column, category: Column, agent: Column, rules: Column, score: Column) -> Column:
    """"<action> <category> on <agent> via <rule> (+n more)"; without a category, the score instead."""
    named = F.filter(rules, lambda r: r != "")
    n = F.coalesce(F.size(named), F.lit(0))
    via = F.when(n == 1, F.concat(F.lit(" via "), F.get(named, F.lit(0)))).when(n > 1, F.concat(F.lit(" via "), F.get(named, F.lit(0)), F.lit(" (+"), (n - 1).cast("string"), F.lit(" more)"))).otherwise("")
    who = F.coalesce(F.when(agent != "", agent), F.lit("unknown-agent"))
    plain = F.concat(action, F.lit(" on "), who, F.coalesce(F.concat(F.lit(" (score "), F.format_string("%.2f", score), F.lit(")")), F.lit("")))
    base = F.when(category != "", F.concat(action, F.lit(" "), category, F.lit(" on "), who)).otherwise(plain)
    return F.when(action.isNotNull(), F.concat(base, via))


#: Attribute, and the column it comes from.
ATTRIBUTES = {
    "gen_ai.security.event_id": "event_id", "gen_ai.security.timestamp": "timestamp", "gen_ai.agent.id": "agent_id", "gen_ai.tool.name": "tool_name",
    "gen_ai.security.interaction.destination_type": "destination_type", "gen_ai.security.interaction.destination_id": "destination_identifier",
    "gen_ai.security.interaction.content_hash": "content_hash", "gen_ai.security.interaction.content_length": "content_length",
    "gen_ai.security.detection.action": "action", "gen_ai.security.detection.score": "score", "gen_ai.security.detection.category": "category",
    "gen_ai.security.detection.enforcement_mode": "enforcement_mode", "gen_ai.security.detection.latency_ms": "latency_ms",
    "gen_ai.security.detection.error_type": "error_type", "gen_ai.security.detection.degraded": "degraded", "gen_ai.security.authz.impact_tier": "impact_tier",
    "gen_ai.security.authz.decision": "decision", "gen_ai.security.authz.policy_id": "policy_id",
    "gen_ai.security.provenance.on_behalf_of": "on_behalf_of", "gen_ai.security.provenance.actor": "actor",
    "gen_ai.security.provenance.correlation_id": "correlation_id", "gen_ai.security.provenance.origin_agent": "origin_agent",
    "gen_ai.security.provenance.delegation_depth": "delegation_depth",
}


def _values(events: DataFrame) -> dict[str, Column]:
    """Attributes of events by their dotted names, each of its own type."""
    found = {a: F.col(c) for a, c in ATTRIBUTES.items() if c in events.columns}
    action, score = F.col("action"), F.col("score")
    found |= {
        "gen_ai.security.schema_version": F.lit(SCHEMA_VERSION),
        "gen_ai.security.interaction.type": _looked_up(F.col("direction"), INTERACTION),
        "gen_ai.security.interaction.direction": _looked_up(F.col("direction"), WAY),
        "gen_ai.security.detection.rules": F.when(F.size("rules") > 0, F.col("rules")),
        "gen_ai.security.detection.severity": detection_severity(action, score),
        "gen_ai.security.detection.message": detection_message(action, F.col("category"), F.col("agent_id"), F.col("rules"), score),
    }
    if "mcp_server" in events.columns:
        name = "gen_ai.security.interaction.destination_id"
        found[name] = F.coalesce(F.col("mcp_server"), found.get(name, F.lit(None).cast("string")))
    if "impact_class" in events.columns:
        found["gen_ai.security.authz.impact_class"] = F.when(F.col("impact_class") != "unknown", F.col("impact_class"))
    return dict(sorted(found.items()))


def mapped(events: DataFrame) -> DataFrame:
    """events with attributes, a map of dotted names to strings; what is missing or empty is left out.

    events has direction, action, score, category, rules and agent_id, and any of the columns of ATTRIBUTES.
    """
    texts = {k: F.to_json(v) if k.endswith(".rules") else v.cast("string") for k, v in _values(events).items()}
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in texts.items()])
    return events.withColumn("attributes", F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull() & (e["value"] != ""))))


def as_json(events: DataFrame) -> DataFrame:
    """One compact JSON object a row: numbers, booleans and the list of rules keep their types; missing and empty values are left out."""
    found = {k: F.when(v.cast("string") != "", v) for k, v in _values(events).items()}
    return events.select(F.to_json(F.struct(*[v.alias(k) for k, v in found.items()]), {"ignoreNullFields": "true"}).alias("value"))
