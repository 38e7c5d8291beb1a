"""Delegation chains, tiers and trace parents as they arrive in headers, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOP = "struct<agent_id:string,role:string>"
TRACEPARENT = r"^[0-9a-f]{2}-([0-9a-f]{32})-([0-9a-f]{16})-([0-9a-f]{2})$"


def parsed_chain(header: Column) -> Column:
    """"agent:role>agent:role" as an array of hops."""
    hops = F.filter(F.split(header, ">"), lambda x: F.trim(x) != "")
    return F.coalesce(F.transform(hops, lambda x: F.struct(F.trim(F.element_at(F.split(x, ":", 2), 1)).alias("agent_id"), F.try_element_at(F.split(x, ":", 2), F.lit(2)).alias("role"))), F.array().cast(f"array<{HOP}>"))


def written_chain(chain: Column) -> Column:
    return F.array_join(F.transform(chain, lambda h: F.concat_ws(":", h["agent_id"], h["role"])), ">")


def parsed_tiers(header: Column, chain: Column) -> Column:
    """"4,1," as an array aligned with the chain, null where a tier is missing or none; all null if the lengths differ."""
    tiers = F.transform(F.split(header, ","), lambda x: F.when(x.rlike(r"^\s*[0-4]\s*$"), F.trim(x).cast("int")))
    fits = F.coalesce(F.size(tiers) == F.size(chain), F.lit(False))
    return F.when(fits, tiers).otherwise(F.transform(chain, lambda _: F.lit(None).cast("int")))


def trace_parent(header: Column) -> Column:
    found = lambda k: F.when(header.rlike(TRACEPARENT), F.regexp_extract(header, TRACEPARENT, k))
    return F.struct(found(1).alias("trace_id"), found(2).alias("span_id"), found(3).alias("trace_flags"), F.when(header.rlike(TRACEPARENT), "header").alias("source"))


def with_context(df: DataFrame, headers: str = "headers") -> DataFrame:
    """df with correlation_id, delegation_chain, tiers, origin_agent, delegation_depth and parent of its headers (a
    map of lower-case names)."""
    h = lambda name: F.col(headers)[name]
    df = df.withColumn("delegation_chain", parsed_chain(h("x-delegation-chain")))
    chain = F.col("delegation_chain")
    return df.withColumns(
        {
            "correlation_id": F.coalesce(h("x-correlation-id"), F.when(h("traceparent").rlike(TRACEPARENT), F.substring(F.regexp_extract(h("traceparent"), TRACEPARENT, 1), 1, 16))),
            "tiers": parsed_tiers(h("x-delegation-tiers"), chain),
            "origin_agent": F.get(chain, F.lit(0))["agent_id"],
            "delegation_depth": F.greatest(F.size(chain) - 1, F.lit(0)),
            "parent": trace_parent(h("traceparent")),
        }
    )


def with_hop(chain: Column, agent: Column, role: Column) -> Column:
    """The chain with a hop; the hop that is its tail already is not repeated."""
    hop = F.struct(agent.alias("agent_id"), role.alias("role"))
    return F.when(F.coalesce(F.try_element_at(chain, F.lit(-1))["agent_id"] == agent, F.lit(False)), chain).otherwise(F.array_append(chain, hop))


def headers_of(chain: Column, tiers: Column, correlation: Column, parent: Column) -> Column:
    """What a message carries on."""
    return F.create_map(
        F.lit("x-delegation-chain"), written_chain(chain),
        F.lit("x-delegation-tiers"), F.array_join(F.transform(tiers, lambda t: F.coalesce(t.cast("string"), F.lit(""))), ","),
        F.lit("x-correlation-id"), correlation,
        F.lit("traceparent"), F.when(parent["trace_id"].isNotNull(), F.concat_ws("-", F.lit("00"), parent["trace_id"], parent["span_id"], F.coalesce(parent["trace_flags"], F.lit("01")))),
    )


def flow_hops(hops: DataFrame) -> DataFrame:
    """(correlation_id, place, agent_id, role, origin) of hops (correlation_id, seq, agent_id, role): the hops of each flow
    in order of seq, numbered from 1, with the agent that began it. A hop to the agent that has the flow already is none.

    A flow is a sorted run of rows and no array, so it may have any number of hops. A null correlation_id is one flow.
    """
    order = Window.partitionBy("correlation_id").orderBy("seq", "agent_id", "role")
    tail = F.lag(F.struct("agent_id")).over(order)
    moved = hops.select("correlation_id", "seq", "agent_id", "role", (tail.isNull() | ~tail["agent_id"].eqNullSafe(F.col("agent_id"))).alias("moves")).where("moves")
    return moved.select("correlation_id", F.row_number().over(order).cast("long").alias("place"), "agent_id", "role", F.first("agent_id").over(order).alias("origin"))


def flows(hops: DataFrame) -> DataFrame:
    """(correlation_id, delegation_chain) of hops, for flows whose chain is to go into a message; long ones are flow_hops."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("place", "agent_id", "role"))), lambda x: F.struct(x["agent_id"].alias("agent_id"), x["role"].alias("role")))
    return flow_hops(hops).groupBy("correlation_id").agg(ordered.alias("delegation_chain"))
