"""What a tool call touches: its class and tier, and findings of its structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from tessera.functions.checks import matches_any_glob
from tessera.functions.columns import named, packed, pinned, unpacked
from tessera.operators.commands import SEGMENT, holds, segment_matches, segments
from tessera.operators.findings import FINDING
from tessera.operators.shapes import VERBS, sql_shapes, with_url_shape
from tessera.rules.impact import COMMAND_KEYS, PRECEDENCE, TIERS, ImpactRules

HIT = "struct<rule:string,class:string,tier:int,rank:int,at:int,score:double,sure:boolean>"


def tier_number(tier: str) -> int:
    return TIERS.index(tier)


def tier_name(number: Column) -> Column:
    return F.get(F.array(*map(F.lit, TIERS)), number)


def _hit(rule: str, cls: str, tier: str, score: float | None, at: Column | int = 0, sure: Column | bool = True) -> Column:
    rank = PRECEDENCE.index(cls) if cls in PRECEDENCE else 99
    at, sure = (F.lit(x) if isinstance(x, int) else x for x in (at, sure))
    return F.struct(F.lit(rule).alias("rule"), F.lit(cls).alias("class"), F.lit(tier_number(tier)).alias("tier"), F.lit(-rank).alias("rank"), (-at).cast("int").alias("at"), F.lit(score).cast("double").alias("score"), sure.alias("sure")).cast(HIT)


def _first(cases: list[tuple[Column, Column]]) -> Column:
    out = None
    for fires, value in cases:
        out = (F.when if out is None else out.when)(fires, value)
    return out


def strongest(hits: Column) -> Column:
    """By tier, then by precedence of classes, then the earliest; null of none."""
    return F.get(F.reverse(F.array_sort(F.transform(hits, lambda h: F.struct(h["tier"], h["rank"], h["at"], h["rule"], h["class"], h["score"], h["sure"])))), F.lit(0))


def _matcher(cond: dict):
    return lambda s: segment_matches(s, cond)


def command_hits(parsed: Column, rules: ImpactRules) -> Column:
    """The first rule that each segment matches, and combinations of segments; sure: no degraded segment is needed."""
    numbered = F.arrays_zip(parsed.alias("s"), F.sequence(F.lit(0), F.greatest(F.size(parsed) - 1, F.lit(0))).alias("k"))
    per = F.transform(numbered, lambda x: _first([(segment_matches(x["s"], cond), _hit(rule, cls, tier, score, x["k"], ~x["s"]["degraded"])) for rule, cls, tier, cond, score in rules.commands]) if rules.commands else F.lit(None).cast(HIT))

    def level(cond: dict) -> Column:
        """0: no segment matches, 1: degraded ones, 2: others too."""
        return F.aggregate(parsed, F.lit(0), lambda most, s: F.greatest(most, F.when(segment_matches(s, cond), F.when(s["degraded"], 1).otherwise(2)).otherwise(0)))

    def combination(rule: str, cls: str, tier: str, score: float | None, one: dict, two: dict) -> Column:
        return F.transform(F.array(F.least(level(one), level(two))), lambda v: F.when(v > 0, _hit(rule, cls, tier, score, 99, v == 2)))

    combined = [combination(*rule) for rule in rules.combinations]
    none = F.array().cast(f"array<{HIT}>")
    # Most calls carry no command; rules are not tried on what is not there.
    return F.when(F.size(parsed) > 0, F.filter(F.concat(F.coalesce(per, none), *combined), lambda h: h.isNotNull())).otherwise(none)


def sql_hits(shapes: Column, rules: ImpactRules) -> Column:
    def fires(s: Column, cond: dict) -> Column:
        return holds(cond, lambda name, globs: matches_any_glob(s[name], globs))

    if not rules.sql:
        return F.array().cast(f"array<{HIT}>")
    return F.filter(F.transform(shapes, lambda s: _first([(fires(s, cond), _hit(rule, cls, tier, score)) for rule, cls, tier, cond, score in rules.sql])), lambda h: h.isNotNull())


def url_hit(rules: ImpactRules) -> Column:
    """The first rule that columns scheme, host and address match."""
    cases = [(holds(cond, lambda name, globs: matches_any_glob(F.col(name), globs)), _hit(rule, cls, tier, score)) for rule, cls, tier, cond, score in rules.urls]
    return F.when(F.coalesce("scheme", "host", "address").isNotNull(), _first(cases)) if cases else F.lit(None).cast(HIT)


def _value(arguments: Column, looks: str) -> Column:
    """The first value of any key that looks so."""
    return F.get(F.filter(F.map_values(arguments), lambda v: v.rlike(looks)), F.lit(0))


def command_of(arguments: Column) -> Column:
    """The value of the first of the keys that carry commands, whatever their case."""
    pairs = F.map_entries(arguments)

    def of(key: str) -> Column:
        return F.get(F.filter(pairs, lambda e: F.lower(e["key"]) == key), F.lit(0))["value"]

    return F.coalesce(*map(of, COMMAND_KEYS))


def _raises(globs: list[str], pattern: str | None):
    return lambda e: matches_any_glob(e["key"], globs) & (e["value"].rlike(pattern) if pattern else F.lit(True))


def _by_name(rules: list[tuple], calls: DataFrame) -> Column:
    """The first rule (globs of tools, class, tier, and globs of MCP servers, if any) that a call's names match."""
    cases = []
    for globs, cls, tier, *servers in rules:
        fires = matches_any_glob(F.col("tool_name"), globs)
        if servers:
            fires = fires & (matches_any_glob(F.col("mcp_server"), servers[0]) if "mcp_server" in calls.columns else F.lit(False))
        cases.append((fires, _hit("tool." + cls, cls, tier, None)))
    return _first(cases) if cases else F.lit(None).cast(HIT)


def classified(calls: DataFrame, tool_rules: list[tuple] | None = None, rules: ImpactRules | None = None) -> DataFrame:
    """calls (tool_name, arguments map<string,string>, ...) with segments, impact_class, impact_tier, structure.

    rules: all rules, as sources.impact_files loads them. tool_rules: those on names alone: (globs of tools, class, tier[,
    globs of servers]); those with servers ask for a column mcp_server.

    A rule on the tool's name goes first; the command decides only where none fits; SQL and URLs override it if their
    tier is higher; arguments can raise the tier. structure are findings of segments, statements and URLs that rules
    give a score; segments that could not be cut as a shell would give none and no tier above high, those beside them do.
    Columns of calls stay.
    """
    rules = rules or ImpactRules()
    out = packed(calls, **{c: named(c) for c in ("tool_name", "arguments", "mcp_server") if c in calls.columns})
    arguments = F.col("arguments")
    out = out.withColumns({"command": command_of(arguments), "sql": _value(arguments, rf"(?is)^(?:\s++|/\*.*?\*/|(?:--|#)[^\n]*+\n|\()*+(?:{VERBS})\b"), "url": _value(arguments, r"(?i)^\s*[a-z][a-z0-9+.\-]{0,31}:(?://)?\S+$|^\s*[0-9a-fx.]+(?::\d+)?(?:/|$)")})
    out = out.withColumn("segments", segments(F.when(F.length("command") > 0, F.col("command"))))
    out = with_url_shape(out, "url")
    out = pinned(out, {"command_hits": command_hits(F.coalesce("segments", F.array().cast(ArrayType(SEGMENT))), rules), "sql_hits": sql_hits(sql_shapes(F.col("sql")), rules), "url_hit": url_hit(rules)})
    by_name = _by_name(rules.tools if tool_rules is None else tool_rules, calls)
    # What degraded segments alone say names a class, but no critical tier and no finding.
    sure = F.filter("command_hits", lambda h: h["sure"])
    command = strongest(F.col("command_hits"))
    out = pinned(out, {"by_name": by_name, "by_command": command, "by_sql": strongest(F.col("sql_hits")), "most": F.greatest(F.coalesce(strongest(sure)["tier"], F.lit(0)), F.lit(tier_number("high")))})
    none = F.lit(tier_number("medium"))
    tier = F.coalesce(F.col("by_name.tier"), F.when(F.col("by_command").isNotNull(), F.least("by_command.tier", "most")), none)
    cls = F.coalesce(F.col("by_name.class"), F.col("by_command.class"), F.lit("unknown"))
    out = out.withColumns({"tier": tier, "impact_class": cls})
    for other in ("by_sql", "url_hit"):
        higher = F.coalesce(F.col(f"{other}.tier") > F.col("tier"), F.lit(False))
        out = out.withColumns({"impact_class": F.when(higher, F.col(f"{other}.class")).otherwise(F.col("impact_class")), "tier": F.when(higher, F.col(f"{other}.tier")).otherwise(F.col("tier"))})
    for globs, pattern, least in rules.escalations:
        raises = F.exists(F.map_entries(arguments), _raises(globs, pattern))
        out = out.withColumn("tier", F.when(F.coalesce(raises, F.lit(False)), F.greatest("tier", F.lit(tier_number(least)))).otherwise(F.col("tier")))
    hits = F.concat(sure, F.col("sql_hits"), F.filter(F.array("url_hit"), lambda h: h.isNotNull()))
    structure = F.transform(F.filter(hits, lambda h: h["score"].isNotNull()), lambda h: F.struct(h["rule"].alias("rule"), h["class"].alias("category"), h["score"].alias("score"), F.lit(None).cast("string").alias("matched"))).cast(FINDING)
    return unpacked(pinned(out, {"impact_tier": tier_name(F.col("tier")), "structure": structure}), "segments", "impact_class", "impact_tier", "structure")

