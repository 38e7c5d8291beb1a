"""Envelopes between agents: their shape, the text in them, and signals of their structure.

Known paths are read natively from the JSON text; only collecting text from any depth takes a function.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tessera.functions.columns import named, packed, unpacked
from tessera.rules import fixed

# Keys that carry identifiers rather than text; shapes of identifiers.
NOISE_KEYS = {
    "id", "messageid", "taskid", "contextid", "artifactid", "jsonrpc", "method", "kind", "role", "mimetype", "version", "uuid", "userid", "user_id", "useremail",
    "user_email", "email", "sessionid", "session_id", "requestid", "request_id", "traceid", "trace_id", "correlationid", "correlation_id", "source", "timestamp",
    "fileid", "file_id",
}
_NOISE = re.compile(r"^(?:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[0-9a-f]{16,})$", re.I)
SHORTEST = 4
# Providers by a part of a host.
PROVIDERS = [("anthropic", "anthropic"), ("openai", "openai"), ("azure", "azure-openai"), ("generativelanguage", "google"), ("googleapis", "google"), ("cohere", "cohere"), ("mistral", "mistral"), ("bedrock", "bedrock"), ("groq", "groq")]


def _path(body: Column, path: str) -> Column:
    return F.get_json_object(body, path)


def _at(tree: Column, path: str) -> Column:
    return F.try_variant_get(tree, path, "variant")


def _kind(tree: Column, path: str = "$") -> Column:
    """OBJECT, ARRAY, STRING and the like at a path of a VARIANT; null where there is none."""
    return F.regexp_extract(F.schema_of_variant(_at(tree, path)), r"^\w+", 0)


def _is(tree: Column, path: str, kind: str) -> Column:
    return F.coalesce(_kind(tree, path) == kind, F.lit(False))


def _items(tree: Column, path: str) -> Column:
    """The elements of an array at a path; none where there is no array."""
    return F.coalesce(F.try_variant_get(tree, path, "array<variant>"), F.array().cast("array<variant>"))


def is_envelope(body: Column) -> Column:
    """JSON-RPC 2.0 with a method, or parts in a message, a result or any artifact, or any message that is an object."""
    tree = F.try_parse_json(body)
    rpc = F.coalesce(_path(body, "$.jsonrpc") == "2.0", F.lit(False)) & _is(tree, "$.jsonrpc", "STRING") & _is(tree, "$.method", "STRING")
    parts = _is(tree, "$.params.message.parts", "ARRAY") | _is(tree, "$.result.message.parts", "ARRAY")
    messages = F.exists(_items(tree, "$.params.messages"), lambda m: _is(m, "$", "OBJECT"))
    artifacts = F.exists(_items(tree, "$.result.artifacts"), lambda a: _is(a, "$.parts", "ARRAY"))
    return _is(tree, "$", "OBJECT") & (rpc | parts | messages | artifacts)


def routed(df: DataFrame, body: str = "body") -> DataFrame:
    """df with route: a2a for envelopes, input for everything else."""
    return df.withColumn("route", F.when(is_envelope(F.col(body)), "a2a").otherwise("input"))


def _walk(node, key: str | None, out: list[str]) -> None:
    if isinstance(node, str):
        text = node.strip()
        if len(text) >= SHORTEST and not _NOISE.match(text) and not (key and key.lower() in NOISE_KEYS):
            out.append(text)
    elif isinstance(node, list):
        for x in node:
            _walk(x, key, out)
    elif isinstance(node, dict):
        for k, v in node.items():
            _walk(v, k, out)


def text_of(body: str | None) -> str | None:
    """Texts of an envelope, each once, a line each: parts of messages first, then anything that is no identifier.
    A body that is no JSON object is its own text."""
    if body is None:
        return None
    try:
        tree = json.loads(body)
    except (ValueError, RecursionError):
        return body
    if not isinstance(tree, dict):
        return body
    found: list[str] = []
    params, result = tree.get("params"), tree.get("result")
    for holder in (params, result):
        if isinstance(holder, dict):
            for key in ("message", "messages", "artifacts", "input", "prompt", "query"):
                _walk(holder.get(key), key, found)
    _walk(tree, None, found)
    return "\n".join(dict.fromkeys(found)) or body


@F.pandas_udf(StringType())
def envelope_text(bodies: pd.Series) -> pd.Series:
    return bodies.map(text_of, na_action="ignore")


# Signals of a structure and their scores.
SIGNALS = {
    "envelope_jsonrpc_version": 0.30, "envelope_method_not_string": 0.30, "envelope_params_not_object": 0.30, "envelope_missing_required": 0.30,
    "part_oneof_no_content": 0.35, "part_oneof_multiple_content": 0.35, "part_kind_content_mismatch": 0.35, "part_role_forgery": 0.40, "part_unexpected_role": 0.30,
    "role_unexpected_value": 0.25, "metadata_prose_surface": 0.20, "id_field_traversal": 0.40, "id_field_malicious_content": 0.40,
}
PRIVILEGED_ROLES = ["system", "assistant", "tool", "developer", "function"]


@F.pandas_udf(ArrayType(StringType()))
def id_values(bodies: pd.Series) -> pd.Series:
    """Values of the identifiers in params and its message: id, and keys that end in Id."""

    def found(body: str | None) -> list[str]:
        try:
            params = json.loads(body or "").get("params")
        except (ValueError, AttributeError, RecursionError):
            return []
        if not isinstance(params, dict):
            return []
        holders = [params, params.get("message")]
        return [v for h in holders if isinstance(h, dict) for k, v in h.items() if isinstance(v, str) and (k == "id" or k.endswith("Id"))]

    return bodies.map(found)


def structural(df: DataFrame, body: str = "body") -> DataFrame:
    """df with signals (names, sorted) and structural_score, the largest of their scores. What is no JSON object has none.

    Parts are those of a request's message and of all artifacts of a result.
    """
    df = packed(df, body=named(body))
    # The body is parsed once: what is looked at below are columns of the parsed tree.
    fields = {name: f"$.{name}" for name in ("jsonrpc", "method", "params")} | {"message": "$.params.message", "role": "$.params.message.role", "metadata": "$.params.message.metadata", "extensions": "$.params.message.extensions"}
    df = df.withColumn("tree", F.try_parse_json("body"))
    tree = F.col("tree")
    parts = F.concat(_items(tree, "$.params.message.parts"), F.flatten(F.transform(_items(tree, "$.result.artifacts"), lambda a: _items(a, "$.parts"))))
    seen = {f"kind_{k}": _kind(tree, p) for k, p in fields.items()} | {f"text_{k}": F.try_variant_get(tree, p, "string") for k, p in fields.items()}
    seen |= {"is_object": _is(tree, "$", "OBJECT"), "parts": F.transform(parts, _part)}
    df = df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in seen.items()])))).drop("tree")
    kind, value = (lambda k: F.col(f"kind_{k}")), (lambda k: F.col(f"text_{k}"))
    rpc = F.col("is_object") & (kind("jsonrpc").isNotNull() | kind("method").isNotNull() | kind("params").isNotNull())
    role = value("role")
    known = (kind("role") == "STRING") & (role.isin("user", "agent") | role.rlike(r"^agent/[\w.-]+$"))
    long = F.lit(r'"(?:[^"\\]|\\.){201,}"')
    prose = [F.coalesce(F.rlike(value(k), long) | ((kind(k) == "STRING") & (F.length(value(k)) > 200)), F.lit(False)) for k in ("metadata", "extensions")]
    fires: dict[str, Column] = {
        "envelope_jsonrpc_version": kind("jsonrpc").isNotNull() & ~F.coalesce((kind("jsonrpc") == "STRING") & (value("jsonrpc") == "2.0"), F.lit(False)),
        "envelope_method_not_string": kind("method").isNotNull() & (kind("method") != "STRING"),
        "envelope_params_not_object": kind("params").isNotNull() & (kind("params") != "OBJECT"),
        "envelope_missing_required": (kind("method") == "STRING") & (value("method") == "message/send") & ~F.coalesce(kind("message") == "OBJECT", F.lit(False)),
        "role_unexpected_value": (kind("message") == "OBJECT") & kind("role").isNotNull() & ~known,
        "metadata_prose_surface": (kind("message") == "OBJECT") & (prose[0] | prose[1]),
    } | {name: F.exists("parts", _field(name)) for name in ("part_oneof_no_content", "part_oneof_multiple_content", "part_kind_content_mismatch", "part_role_forgery", "part_unexpected_role")}
    df = df.withColumn("ids", id_values(F.when(F.col("is_object") & F.col("body").rlike(r'"(?:id|\w*Id)"\s*:'), F.col("body"))))
    moves = lambda v: v.rlike(fixed.ID_TRAVERSAL) | v.rlike(fixed.ID_ENCODED) | v.rlike(fixed.ID_ABSOLUTE)
    fires["id_field_traversal"] = F.exists("ids", moves)
    fires["id_field_malicious_content"] = F.exists("ids", lambda v: ~moves(v) & (v.rlike(fixed.ID_CONTROL) | v.rlike(fixed.ID_INJECTION)))
    gate = {k: (rpc if k.startswith("envelope") else F.col("is_object")) for k in fires}
    hits = F.filter(F.array(*[F.when(F.coalesce(gate[k] & c, F.lit(False)), F.struct(F.lit(k).alias("name"), F.lit(SIGNALS[k]).alias("score"))) for k, c in fires.items()]), lambda h: h.isNotNull())
    found = {"signals": F.sort_array(F.transform(hits, lambda h: h["name"])), "structural_score": F.coalesce(F.array_max(F.transform(hits, lambda h: h["score"])), F.lit(0.0))}
    return unpacked(df.withColumns(found), "signals", "structural_score")


def _part(p: Column) -> Column:
    """What is wrong with a part of a message: one kind of content is asked for, and no role."""
    text = _is(p, "$.text", "STRING") & F.coalesce(F.trim(F.try_variant_get(p, "$.text", "string")) != "", F.lit(False))
    data = _is(p, "$.data", "OBJECT")
    file = _is(p, "$.file", "OBJECT") | _is(p, "$.file", "STRING") | _is(p, "$.fileId", "STRING") | _is(p, "$.url", "STRING") | _is(p, "$.uri", "STRING")
    n = text.cast("int") + data.cast("int") + file.cast("int")
    named, role = (F.try_variant_get(p, f"$.{k}", "string") for k in ("kind", "role"))
    wrong = F.when(named == "text", ~text).when(named == "data", ~data).when(named == "file", ~file).otherwise(F.lit(False))
    forged = _is(p, "$.role", "STRING") & F.coalesce(F.lower(F.trim(role)).isin(*PRIVILEGED_ROLES), F.lit(False))
    # A role of null is none.
    has_role = ~F.coalesce(_kind(p, "$.role").isin("VOID", "NULL"), F.lit(False)) & _at(p, "$.role").isNotNull()
    cases = {"part_oneof_no_content": n == 0, "part_oneof_multiple_content": n > 1, "part_kind_content_mismatch": (n >= 1) & wrong, "part_role_forgery": forged, "part_unexpected_role": has_role & ~forged}
    return F.struct(*[(_is(p, "$", "OBJECT") & c).alias(k) for k, c in cases.items()])


def _field(name: str):
    return lambda p: p[name]


def destination(url: Column, body: Column) -> Column:
    """The agent that a message goes to: from the path, else from the body, else the host, else unknown."""
    named = [F.nullif(_path(body, f"$.{k}"), F.lit("")) for k in ("targetAgent", "agentId", "agent_id", "destination")]
    host = F.nullif(F.regexp_extract(url, r"://([^:./]+)", 1), F.lit(""))
    return F.coalesce(F.nullif(F.regexp_extract(url, r"/agents/([^/]+)", 1), F.lit("")), *named, F.when(~host.isin("localhost", "127", "0"), host), F.lit("unknown"))


def provider(url: Column) -> Column:
    host = F.lower(F.coalesce(F.nullif(F.regexp_extract(url, r"://([^/:]+)", 1), F.lit("")), url))
    out = F.lit(None).cast("string")
    for part, name in reversed(PROVIDERS):
        out = F.when(host.contains(part), name).otherwise(out)
    return out


def response_text(body: Column) -> Column:
    """The first text under a usual key of a response, else all of it."""
    return F.coalesce(*[F.nullif(_path(body, f"$.{k}"), F.lit("")) for k in ("text", "content", "message", "output", "response", "result")], body)
