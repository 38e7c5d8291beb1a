"""Scans of records: text, tool calls and envelopes between agents, each one verdict a record.

Order matters: scores are fused, then caps by the frame apply, then signals that no cap may lower, then bands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import named, packed, pinned, unpacked
from tessera.functions.gates import Sieved, held_sql, literals
from tessera.functions.text import HEAD, all_normalised, coerced, content_hash, head, normalised, percent_decoded
from tessera.operators import context as C
from tessera.operators import findings as D
from tessera.operators import verdict as V
from tessera.rules import fixed
from tessera.rules.inputs import INPUT_RULES, REPETITION_RULES, RESERVED_FILTERED


#: Bytes for each core up to which a table is dealt to all cores: a file may be one group of rows of that size, which one
#: task reads. A larger table is read by all.
SMALL = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table dealt to all cores, as a scan is bound by them; one whose size is not known, or not small, stays as it is read.

    The size is the planner's estimate from the source's files, so no job runs.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SMALL * cores:
        return df
    return df.repartition(2 * cores)


def _looked_for(rules: list[tuple]) -> frozenset[str]:
    """The literals of all patterns that scans try, those of rules among them."""
    intents = [p for i in fixed.INTENTS for p in i[4:7]]
    patterns = [*[r[4] for r in rules], *[r[5] for r in fixed.DATA_LOSS], fixed.SELF_REFERENCE, *intents, *fixed.CONCEPTS.values(), *fixed.CUES.values(), fixed.DECODE_DIRECTIVE]
    return literals(tuple(patterns))


def lows(rules: list[tuple]) -> tuple[Sieved, Sieved]:
    """The names of the texts in lower case that views gives."""
    words = _looked_for(rules)
    return Sieved("low", "held", words), Sieved("low_raw", "held_raw", words)


def views(df: DataFrame, rules: list[tuple], text: str = "text", normalise: bool = True) -> DataFrame:
    """df with raw (the first HEAD characters), view (as a reader sees them), both in lower case, and held and held_raw,
    the literals of rules and of all other patterns that stand in them (lows)."""
    df = df.withColumn("raw", head(F.col(text)))
    df = df.withColumn("view", normalised("raw") if normalise else F.col("raw"))
    words = _looked_for(rules)
    found = f"named_struct('low', t.low, 'low_raw', t.low_raw, 'held', h, 'held_raw', case when t.low_raw = t.low then h else {held_sql('t.low_raw', words)} end)"
    lowered = "array(named_struct('low', lower(view), 'low_raw', lower(raw)))"
    return df.select("*", F.inline(F.expr(f"flatten(transform({lowered}, t -> transform(array({held_sql('t.low', words)}), h -> {found})))")))


def _texts(df: DataFrame, text: str) -> DataFrame:
    """df packed, with its text; bytes are read as UTF-8."""
    return packed(df, text=coerced(named(text)) if dict(df.dtypes)[text] == "binary" else named(text))


def related(df: DataFrame, view: str = "view", traffic: str = "chat", low: str = "low") -> DataFrame:
    """df (with low, the view in lower case) with related, the relations in a view; each concept is looked for once."""
    has = D.concepts(view, low)
    out = pinned(df, {f"has_{k}": c for k, c in has.items()})
    out = pinned(out, {"related": D.relations(view, traffic, {k: f"has_{k}" for k in has})})
    return out.drop(*[f"has_{k}" for k in has])


def behind(df: DataFrame, text: str, normalise: bool = True) -> DataFrame:
    """df with tails, the overlapping windows of a text behind its head (null for a short text), and tail_views, the
    same windows as a reader sees them. They cover all of the text, and stay in the record's own row."""
    parts = F.filter(C.windows(F.col(text), HEAD, most=None), lambda w: w["at"] > 0)
    out = pinned(df, {"tails": F.when(F.length(text) > HEAD, F.transform(parts, lambda w: w["part"]))})
    return out.withColumn("tail_views", all_normalised("tails") if normalise else F.col("tails"))


def judged(df: DataFrame, texts: str, rules, words: frozenset[str], traffic: str = "chat") -> DataFrame:
    """df with texts, an array of texts, replaced by what is found in each: l1, score, category, rules, and whether it is
    clean (no command to run, and no block for what it says).

    Layers are those of a whole text, without a frame and with the largest score; a text of null gives no findings and is not clean.
    rules: a text's name, and that of its lower-cased form -> SQL of findings. words: literals that their gates look for.
    """
    low = Sieved("t.low", "t.held", words)
    names = list(D.concepts_sql("t"))
    has = ", ".join(f"'{k}', {c}" for k, c in D.concepts_sql("t.part", low).items())
    lowered = f"transform(transform({texts}, t -> named_struct('part', t, 'low', lower(t))), t -> named_struct('part', t.part, 'low', t.low, 'held', {held_sql('t.low', words)}))"
    looked = f"named_struct('part', t.part, 'l1', {rules('t.part', low)}, 'intents', {D.intents_sql('t.part', low)}, 'dlp', {D.data_loss_sql('t.part', low=low)}, 'has', named_struct({has}))"
    out = pinned(df, {texts: F.expr(f"transform({lowered}, t -> {looked})")})
    related = D.relations_sql("p.part", traffic, {k: f"p.has.{k}" for k in names})
    layers = f"named_struct('there', p.part is not null, 'l1', p.l1, 'l2', {D.behaviours_sql('p.intents', 'p.l1')}, 'dlp', p.dlp, 'related', {related})"

    def told(p):
        l1, l2, dlp, rel = (p[c] for c in ("l1", "l2", "dlp", "related"))
        score = F.greatest(D.rule_score(l1), D.top_score(l2), D.top_score(dlp), D.top_score(rel))
        category = V.category(F.concat(l1, l2, dlp), rel, F.lit(None).cast("string"))
        said = F.greatest(V.fused(D.rule_score(l1), D.top_score(l2)), D.top_score(rel))
        clean = p["there"] & ~F.exists(l1, lambda x: x["category"] == "code_execution") & (said < V.BLOCK)
        return F.struct(l1.alias("l1"), score.alias("score"), category.alias("category"), F.transform(F.concat(l1, l2, dlp, rel), lambda x: x["rule"]).alias("rules"), clean.alias("clean"))

    return pinned(pinned(out, {texts: F.expr(f"transform({texts}, p -> {layers})")}), {texts: F.transform(texts, told)})


def with_tail(df: DataFrame, text: str, rules, words: frozenset[str], normalise: bool = True) -> DataFrame:
    """df with tail_score, tail_category and tail_rules, of the strongest window behind the head (the first of equals; null
    for a short text)."""
    out = judged(behind(df, text, normalise).drop("tails"), "tail_views", rules, words)
    return pinned(out, _of_tail(F.col("tail_views"))).drop("tail_views")


def _of_tail(windows) -> dict:
    # Fields of their own: Catalyst loses a struct's fields that generators above generators use.
    top = V.first_top(windows)
    return {f"tail_{k}": top[k] for k in ("score", "category", "rules")}


def _twice(scan, low: str, low_raw: str) -> dict:
    """Findings in the view, and in the raw text where that is another."""
    none = F.array().cast(D.FINDING)
    return {"by_view": F.expr(scan("view", low)), "by_raw": F.when(F.col("raw") != F.col("view"), F.expr(scan("raw", low_raw))).otherwise(none)}


RESULTS = ("score", "category", "rules", "input_status", "true_action", "action")


def scan_outputs(df: DataFrame, text: str = "text", mode: str = "block", normalise: bool = True, rules: list[tuple] = fixed.OUTPUT_RULES) -> DataFrame:
    """df with the verdict on model outputs: score, score_exact, category, rules, input_status, true_action, action.

    A null text is not scannable: it is allowed, with input_status saying so. Bytes are read as UTF-8. rules: those of
    the first layer, as sources.rule_files loads them. Columns of df stay as they are; one with the name of a result is
    replaced by it.
    """
    scan = lambda t, low=None: D.scanned_sql(t, rules, fixed.RESERVED_FILTERED, low)
    low, low_raw = lows(rules)
    out = views(_texts(spread(df), text), rules, normalise=normalise)
    out = pinned(out, _twice(scan, low, low_raw) | {"acts": D.intents("view", low), "dlp": D.data_loss("view", low=low)})
    out = pinned(out, {"l1": D.united(F.col("by_view"), F.col("by_raw"))})
    out = pinned(out, {"l2": D.behaviours("acts", "l1")})
    out = with_tail(related(out, low=low), "text", scan, low.literals, normalise)
    l1, l2, dlp, rel = (F.col(c) for c in ("l1", "l2", "dlp", "related"))
    score = F.greatest(V.fused(D.rule_score(l1), D.top_score(l2), D.top_score(dlp)), D.top_score(rel))
    missing, long = F.col("text").isNull(), F.length("text") > HEAD
    score = F.when(missing, 0.0).when(long, F.greatest(score, F.lit(V.FLAG), F.col("tail_score"))).otherwise(score)
    fallback = F.when(missing, "input_not_scannable").when(long, F.coalesce("tail_category", F.lit("oversized_input")))
    rules = F.transform(F.concat(l1, l2, dlp, rel), lambda x: x["rule"])
    return unpacked(_told(out, score, V.category(F.concat(l1, l2, dlp), rel, fallback), rules, mode), "score_exact", *RESULTS)


def _and_tail(rules):
    """Rules, then those of the tail that are not among them."""
    return F.concat(rules, F.coalesce(F.array_except("tail_rules", rules), F.array().cast("array<string>")))


def _told(out: DataFrame, score, category, rules, mode: str) -> DataFrame:
    """out (text, tail_score, tail_category, tail_rules) with score_exact and RESULTS."""
    missing, long = F.col("text").isNull(), F.length("text") > HEAD
    rules = F.when(missing, F.array(F.lit("INPUT_NOT_SCANNABLE"))).when(long, F.array_append(_and_tail(rules), OVERSIZED)).otherwise(rules)
    out = pinned(out, {"score_exact": score, "category": category, "rules": rules, "input_status": F.when(missing, "not_scannable")})
    true = V.true_action(V.band(F.col("score_exact")))
    return out.withColumns({"true_action": true, "action": V.action(true, mode), "score": F.round("score_exact", 3)})


OVERSIZED = "LLM01_oversized_input"


def _scan_of(rules: list[tuple]):
    """A text's name, and that of its lower-cased form -> SQL for the findings of rules on inputs."""
    return lambda text, low=None: D.scanned_sql(text, rules, RESERVED_FILTERED, low)


def scan_inputs(df: DataFrame, text: str = "text", mode: str = "block", traffic: str = "chat", rules: list[tuple] = INPUT_RULES, detectors: list[tuple] = REPETITION_RULES) -> DataFrame:
    """df with the verdict on inputs: as for outputs, with the frame's calibration and signals against evasion.

    rules and detectors: those of the first layer, as sources.rule_files loads them. Columns of df stay as they are.
    """
    return unpacked(_inputs(_texts(spread(df), text), mode, traffic, rules, detectors), *RESULTS)


#: Decoded forms of an encoded text count with findings of these categories.
DANGERS = ["prompt_injection", "jailbreak", "system_prompt_leak", "code_execution", "credential_access", "data_exfiltration"]


def _inputs(df: DataFrame, mode: str, traffic: str, rules: list[tuple] = INPUT_RULES, detectors: list[tuple] = REPETITION_RULES) -> DataFrame:
    """df (text) with RESULTS.

    A text with cues of a frame is read again without them, and one that reaches the block band without what it reports
    and without code spans (context.residues): a frame may lower a verdict only if these hold no command of their own,
    and a command that a cue splits counts. Other texts are not read again.
    """
    scan = _scan_of(rules)
    low, low_raw = lows(rules)
    out = C.with_extraction(views(df, rules), "view", low)
    found = _twice(scan, low, low_raw) | {"acts": D.intents("view", low), "dlp": D.data_loss("view", low=low), "frame": C.frame("view", F.col("extraction"), low), "repeats": C.repetitions("text", detectors)}
    out = pinned(out, found)
    out = pinned(out, {"l1": F.concat("repeats", D.united(F.col("by_view"), F.col("by_raw"))).cast(D.FINDING)}).drop("repeats", "by_view", "by_raw")
    out = related(pinned(out, {"l2": D.behaviours("acts", "l1")}).drop("acts"), "view", traffic, low)

    def fused(first, second, dlp, rel):
        return F.greatest(V.fused(first, D.top_score(second), D.top_score(dlp)), D.top_score(rel))

    l1, l2, dlp, rel = (F.col(c) for c in ("l1", "l2", "dlp", "related"))
    raw = F.col("raw")
    out = pinned(out, {"hot": fused(D.rule_score(l1), l2, dlp, rel) >= V.BLOCK, "decoded": percent_decoded(F.when(raw.rlike("%[0-9A-Fa-f]{2}"), raw))})
    windows = F.transform(F.filter(C.windows(F.col("text"), HEAD, most=None), lambda w: w["at"] > 0), lambda w: w["part"])
    long, missing = F.length("text") > HEAD, F.col("text").isNull()
    out = pinned(out, {"again": C.residues("hot", "decoded", low=low)})
    out = pinned(out, {"again": F.when(F.col("again").isNotNull() | long, F.concat(F.coalesce("again", C.no_residues()), F.when(long, windows).otherwise(F.array().cast("array<string>"))))})
    out = judged(out.withColumn("again", all_normalised("again")), "again", scan, low.literals, traffic)
    behind_head = F.slice("again", C.RESIDUES + 1, F.greatest(F.size("again") - C.RESIDUES, F.lit(1)))
    out = pinned(out, _of_tail(F.when(long, behind_head)) | {"again": F.slice("again", 1, C.RESIDUES)})

    out = pinned(out, {"l1": C.wedged("l1")})
    disarmed = C.live_command("concat(l1, l2)", C.residue("unframed"), directives=False) & (F.col("frame") != "protective")
    out = out.withColumn("framed", F.coalesce(F.col("frame").isNotNull() & ~disarmed, F.lit(False)))
    out = pinned(out, {c: C.dampened(F.col(c), F.col("framed")) for c in ("l1", "l2")} | {"related": F.when(F.col("framed"), F.array().cast(D.FINDING)).otherwise(F.col("related"))})
    # A dampened text has plain maxima.
    score = fused(F.when(F.col("framed"), D.top_score(l1)).otherwise(D.rule_score(l1)), l2, dlp, rel)
    active = C.active_extraction("view", low)
    mentioned = ~F.exists(F.concat(l1, l2), C.is_live) & C.earned_mention("concat(l1, l2)", "view", low)
    documentary = F.coalesce(F.expr(f"{C.residue('uncoded')}.clean"), F.lit(False))
    capped = (score >= V.BLOCK) & (D.top_score(dlp) < V.BLOCK) & ~active & (mentioned | documentary)
    score = F.when(F.coalesce(capped, F.lit(False)), F.least(score, F.greatest(F.lit(V.FLAG), F.lit(V.BLOCK - 0.05)))).otherwise(score)
    danger = F.coalesce(D.top_score(F.filter(F.expr(f"{C.residue('decoded')}.l1"), lambda x: x["category"].isin(DANGERS))), F.lit(0.0))
    out = pinned(out, {"danger": F.when(F.col("decoded").isNotNull(), danger).otherwise(F.lit(0.0)), "bypass": C.protective_then_override("view", F.col("extraction"), low), "encoded": C.encoded_directive("raw", low_raw), "capped": score})
    bypass, encoded, decoded, score = (F.col(c) for c in ("bypass", "encoded", "danger", "capped"))
    score = F.when(bypass, F.greatest(score, F.lit(0.85))).otherwise(score)
    score = F.when(encoded, F.greatest(score, F.lit(0.75))).otherwise(score)
    score = F.greatest(score, decoded, F.when(long, F.greatest(F.lit(V.FLAG), F.col("tail_score"))).otherwise(F.lit(0.0)))
    extra = F.array_compact(F.array(F.when(bypass, "LLM01_protective_override"), F.when(encoded, "LLM01_encoded_payload_directive"), F.when(decoded > 0, "LLM01_url_encoded_danger")))
    rules = F.concat(F.transform(F.concat(l1, l2, dlp, rel), lambda x: x["rule"]), extra)
    fallback = F.when(missing, "input_not_scannable").when(bypass, "system_prompt_leak").when(encoded | (decoded > 0), "prompt_injection").when(long, F.coalesce("tail_category", F.lit("oversized_input")))
    return _told(out, F.when(missing, 0.0).otherwise(score), V.category(F.concat(l1, l2, dlp), rel, fallback), rules, mode)


def hashed(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the text's hash and length in place of the text: what events may carry."""
    return df.withColumns({"content_hash": content_hash(F.col(text)), "content_length": F.length(text)}).drop(text)


#: Categories that block a tool call, and those that only flag it.
HARD = ["code_execution", "excessive_agency", "prompt_injection", "credential_access"]
SOFT = ["data_exfiltration", "jailbreak", "system_prompt_leak", "encoding_evasion", "dos_attempt", "forged_trust"]
PROSE_FREE_KEYS = ["command", "cmd", "script", "args", "shell", "code"]


def _found_behind(scan):
    """Findings in the windows behind the head of a tool call's text, each rule once."""
    none = F.array().cast(D.FINDING)
    kept = ", ".join(f"'{c}'" for c in (*HARD, *SOFT))
    content = F.expr(f"transform(array_union(tail_views, tails), t -> filter({scan('t')}, x -> x.category in ({kept})))")
    secrets = F.expr(f"transform(tails, t -> {D.data_loss_sql('t', D.SURE_SECRETS)})")
    return F.coalesce(F.aggregate(F.concat(content, secrets), none, D.united), none)


def scan_tool_calls(calls: DataFrame, mode: str = "block", blocked_tools: list[str] = (), policy=None, rules: list[tuple] = INPUT_RULES, tool_rules: list[tuple] | None = None, impact=None) -> DataFrame:
    """calls (tool_name, arguments map<string,string>, ...) with impact, findings and a verdict.

    tool_rules: rules on names of tools and servers, and impact: all rules on what a call touches, as impact.classified
    takes them and sources.impact_files loads them. Columns of calls stay as they are.

    There are no thresholds here: a finding of a hard category, of the structure or a sure secret stops the call in
    block mode, others flag it. A blocked tool is not looked at further. A policy can only make a verdict stricter.
    """
    from tessera.operators.commands import rebuilt
    from tessera.operators.impact import classified
    from tessera.operators.policy import annotated, evaluated, is_listed

    scan = _scan_of(rules)
    needed = [c for c in ("tool_name", "arguments", "mcp_server") if c in calls.columns]
    out = classified(packed(spread(calls), **{c: named(c) for c in needed}), tool_rules, impact)
    flat = F.concat_ws(" ", "tool_name", F.array_join(F.map_values("arguments"), " "))
    low, low_raw = lows(rules)
    out = views(out.withColumn("flat", flat), rules, "flat")
    none = F.array().cast(D.FINDING)
    out = pinned(out, {"rebuilt": rebuilt(F.col("segments")), "uncoded": C.uncoded("raw")})
    # A command that is rebuilt as it stands is seen already.
    again = F.col("rebuilt").isNotNull() & ~F.col("raw").contains(F.col("rebuilt"))
    found = _twice(scan, low, low_raw) | {"by_rebuilt": F.when(again, F.expr(scan("rebuilt"))).otherwise(none), "secrets": D.data_loss("raw", D.SURE_SECRETS, low_raw)}
    out = pinned(out, found)
    every = D.united(D.united(F.col("by_view"), F.col("by_raw")), F.col("by_rebuilt"))
    out = pinned(out, {"content": F.filter(every, lambda x: x["category"].isin(*HARD, *SOFT))})
    out = pinned(behind(out, "flat"), {"tail_found": _found_behind(scan)})
    listed = is_listed(F.col("tool_name"), list(blocked_tools))
    prose = F.col("uncoded").isNotNull() & ~F.exists(F.map_keys("arguments"), lambda k: F.lower(k).isin(*PROSE_FREE_KEYS))
    residue = ~F.exists(F.expr(scan("uncoded")), lambda x: x["category"].isin(*HARD))
    head_found = F.concat("content", "structure", "secrets")
    all_found = D.united(head_found, F.col("tail_found"))
    # What prose explains is explained in the head only.
    hard, hard_behind = (F.filter(x, lambda x: ~x["category"].isin(*SOFT)) for x in (head_found, F.col("tail_found")))
    missing = F.col("tool_name").isNull()
    out = pinned(out, {"all_found": all_found, "hard": F.when(F.coalesce(prose & residue, F.lit(False)), hard_behind).otherwise(D.united(hard, hard_behind)), "listed": listed})
    found, long = F.col("all_found"), F.length("flat") > HEAD
    out = out.withColumns(
        {
            "score": F.when(missing, 0.0).when(F.col("listed"), 1.0).otherwise(F.greatest(D.top_score(found), F.when(long, F.lit(V.FLAG)).otherwise(F.lit(0.0)))),
            "category": F.when(missing, "input_not_scannable").when(F.col("listed"), "blocked_tool").otherwise(F.coalesce(F.get("hard", F.lit(0))["category"], F.get("all_found", F.lit(0))["category"], F.when(long, "oversized_input"))),
            "rules": F.when(missing, F.array(F.lit("INPUT_NOT_SCANNABLE"))).when(F.col("listed"), F.array(F.lit("blocked_tool"))).otherwise(F.concat(F.transform(found, lambda x: x["rule"]), F.when(F.coalesce(long, F.lit(False)), F.array(F.lit(OVERSIZED))).otherwise(F.array().cast("array<string>")))),
            "true_action": F.when(missing, "allowed").when(F.col("listed") | (F.size("hard") > 0), "blocked").when((F.size(found) > 0) | F.coalesce(long, F.lit(False)), "flagged").otherwise("allowed"),
        }
    )
    out = unpacked(out.withColumn("action", F.col("true_action")), "impact_class", "impact_tier", "score", "category", "rules", "true_action", "action")
    if policy is not None:
        own = out.columns
        out = annotated(evaluated(out, policy)).withColumn("true_action", F.col("action")).select(*own, "decision", "policy_id")
    return out.withColumn("action", V.action(F.col("true_action"), mode))


def scan_routed(df: DataFrame, body: str = "body", mode: str = "block") -> DataFrame:
    """df with route and a verdict: envelopes between agents are scanned as such, everything else as an input.

    The table is read once; a record's route decides which text of it is scanned and how.
    """
    from tessera.operators.envelopes import envelope_text, routed, structural

    out = routed(_texts(spread(df), body).withColumnRenamed("text", "body"))
    out = structural(out.withColumn("envelope", F.when(F.col("route") == "a2a", F.col("body"))), "envelope")
    out = out.withColumn("text", F.coalesce(envelope_text("envelope"), "body"))
    return unpacked(_raised(_inputs(out.drop("body", "envelope"), "block", "route = 'a2a'"), mode), "route", *RESULTS)


def _raised(out: DataFrame, mode: str, block_structure: bool = False) -> DataFrame:
    """out (a verdict, signals, structural_score) with what the structure adds."""
    hit = F.col("structural_score") >= V.FLAG
    true = F.when(hit & F.lit(block_structure), "blocked").when(hit & (F.col("true_action") == "allowed"), "flagged").otherwise(F.col("true_action"))
    out = out.withColumns({"score": F.round(F.greatest("score", "structural_score"), 3), "rules": F.concat("rules", "signals"), "true_action": true})
    return out.withColumn("action", V.action(F.col("true_action"), mode))


def scan_envelopes(df: DataFrame, body: str = "body", mode: str = "block", block_structure: bool = False) -> DataFrame:
    """df with the verdict on envelopes: their text is scanned as traffic between agents, their structure raises it."""
    from tessera.operators.envelopes import envelope_text, structural

    out = structural(_texts(spread(df), body).withColumnRenamed("text", "body"), "body")
    out = out.withColumn("text", envelope_text("body")).drop("body")
    return unpacked(_raised(_inputs(out, "block", "a2a"), mode, block_structure), *RESULTS)
