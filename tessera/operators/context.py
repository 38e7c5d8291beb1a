"""Calibration of findings on inputs by the frame a text stands in, and signals that caps do not touch."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StringType, StructField, StructType

from tessera.functions.gates import gated, may_match, quoted
from tessera.operators.findings import FINDING, pattern
from tessera.operators.verdict import BLOCK
from tessera.rules import fixed
from tessera.rules.inputs import REPETITION_RULES

_CUE = {k: pattern(p) for k, p in fixed.CUES.items()}


def has(text: str, cue: str, low: str | None = None) -> Column:
    """Whether a cue stands in a column; low: the column with the text in lower case."""
    return F.expr(gated(text, fixed.CUES[cue], _CUE[cue], low))


_EXTRACT, _BOUNDARY, _NEGATED = (re.compile(fixed.CUES[k], re.I) for k in ("extract_clause", "clause_boundary", "local_negation"))


def has_unnegated_extraction(text: str) -> bool:
    """Whether an order to hand something out stands in a clause of its own without a negation before it."""
    for m in _EXTRACT.finditer(text):
        before = text[max(0, m.start() - fixed.CLAUSE_LOOKBACK) : m.start()]
        last = None
        for last in _BOUNDARY.finditer(before):
            pass
        if not _NEGATED.search(before[last.end() :] if last else before):
            return True
    return False


@F.pandas_udf(BooleanType())
def unnegated_extraction(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: bool(t) and has_unnegated_extraction(t))


def with_extraction(df, text: str = "text", low: str | None = None):
    """df with extraction (an order to hand something out that is not negated). Only texts with such words reach Python."""
    asked = F.when(has(text, "extract_clause", low), F.col(text))
    return df.withColumn("extraction", F.coalesce(unnegated_extraction(asked), F.lit(False)))


def active_extraction(text: str, low: str | None = None) -> Column:
    return has(text, "active_exfil", low) & ~has(text, "negated_extract", low)


def frame(text: str, extraction: Column, low: str | None = None) -> Column:
    """protective, descriptive or interrogative; null for a text that gives orders or asks for what is its own."""
    cue = lambda name: has(text, name, low)
    protective = cue("protective") & ~active_extraction(text, low) & ~extraction
    return (
        F.when(cue("directive") | cue("self_exfil"), F.lit(None).cast("string"))
        .when(protective, "protective")
        .when(cue("descriptive") | cue("code_as_docs"), "descriptive")
        .when(cue("interrogative") & ~cue("ai_self"), "interrogative")
    )


#: Categories that a frame may explain, unless the finding is an order to run something.
GATED = ["prompt_injection", "jailbreak", "system_prompt_leak", "data_exfiltration", "model_abuse", "pii_harvesting", "tool_misuse", "agentic_abuse", "encoding_evasion", "social_engineering", "privilege_escalation", "memory_manipulation", "excessive_agency"]
LIVE_RULES = ["LLM01_code_injection", "LLM01_decode_and_execute", "LLM08_pipe_exec", "ASI05_pipe_to_shell", "MCP_shell_injection"]


def is_live(finding: Column) -> Column:
    return (finding["category"] == "code_execution") | finding["rule"].isin(LIVE_RULES)


def _list(values) -> str:
    return "(" + ", ".join(map(quoted, values)) + ")"


_LIVE = f"(x.category = 'code_execution' or x.rule in {_list(LIVE_RULES)})"
#: A finding whose matched words are a command: they hold a verb, as the action of an intent does.
_COMMAND = f"(x.rule in {_list([r[0] for r in fixed.INTENTS])} or coalesce(rlike(x.matched, {quoted(_CUE['predicate'])}), false))"


def live_command(found: str, residue: str, directives: bool) -> Column:
    """Whether findings (SQL of an array) carry a command and not only a topic that a frame may be about.

    One of them must reach the block band, and one, or one in the text without the frame's cues (SQL of what judged()
    found there), must have matched a command. directives: all findings count, not only those that a frame may explain.
    """
    counts = "true" if directives else f"x.category in {_list(GATED)} and not {_LIVE}"
    command = f"x -> ({counts}) and {_COMMAND}"
    return F.expr(f"exists({found}, x -> ({counts}) and x.score >= {BLOCK}) and (exists({found}, {command}) or coalesce(exists({residue}.l1, {command}), false))")


#: Residues of a text, in their order: without the cues of its frame, without words for artifacts of security work,
#: without what these report, without code spans; and its percent escapes decoded.
_RESIDUES = ["unframed", "unnamed", "unreported", "uncoded", "decoded"]
RESIDUES = len(_RESIDUES)


def residue(name: str, of: str = "again") -> str:
    """SQL of one of the residues in an array; null where there is none."""
    return f"get({of}, {_RESIDUES.index(name)})"


def no_residues() -> Column:
    return F.expr(f"array_repeat(cast(null as string), {RESIDUES})")


#: Of what a word for an artifact governs, the rest of its clause; a point between digits does not end one.
_CLAUSE = r"(?:[^.;!?\n]++|(?<=\d)\.|\.(?=\d))*+"
_REPORTS = f"{_CUE['artifact']}({_CLAUSE})"
_TOLD = f"{_CUE['attribution']}|{fixed.CUES['code_span']}"


def _unreported(text: str) -> str:
    """SQL of a text without what words for artifacts report; null where they report nothing."""
    spans = f"filter(regexp_extract_all({text}, {quoted(_REPORTS)}, 1), s -> rlike(s, {quoted(_TOLD)}))"
    return f"case when size({spans}) > 0 then aggregate({spans}, {text}, (rest, s) -> replace(rest, s, ' ')) end"


def residues(hot: str, decoded: str, view: str = "view", raw: str = "raw", low: str = "low") -> Column:
    """The residues of texts: those without cues where there are cues, what documents report and quote where a text
    reaches the block band (hot), and a decoded form where there is one; null where there is none of these."""
    artifact = gated(view, fixed.CUES["artifact"], _CUE["artifact"], low)
    cues = f"{_CUE['descriptive']}|{fixed.CUES['code_as_docs']}"
    told = " or ".join(gated(view, fixed.CUES[k], _CUE[k], low) for k in ("descriptive", "code_as_docs"))
    unframed = f"case when {told} then regexp_replace({view}, {quoted(cues)}, ' ') end"
    unnamed = f"case when {artifact} then regexp_replace({view}, {quoted(_CUE['artifact'])}, ' ') end"
    unreported = f"case when {hot} and {artifact} then {_unreported(raw)} end"
    parts = [unframed, unnamed, unreported, f"case when {hot} then {_uncoded_sql(raw)} end", decoded]
    return F.expr(f"transform(array(array({', '.join(parts)})), r -> case when exists(r, x -> x is not null) then r end)[0]")


def wedged(first: str) -> Column:
    """Commands of the block band that a text holds once its cues are gone, as findings of rules that are not among those
    of first (SQL): a cue within a command splits it, and hides it from the rule."""
    none = f"cast(array() as {FINDING})"
    both = f"concat({', '.join(f'coalesce({residue(k)}.l1, {none})' for k in ('unframed', 'unnamed'))})"
    new = f"filter({both}, x -> x.score >= {BLOCK} and {_COMMAND} and not array_contains(transform({first}, f -> f.rule), x.rule))"
    return F.expr(f"concat({first}, filter({new}, (x, i) -> not array_contains(transform(slice({new}, 1, i), f -> f.rule), x.rule)))")


def earned_mention(found: str, view: str, low: str) -> Column:
    """Whether attack words are mentioned and not said: in quotation marks, or by a word for an artifact of security
    work that is about a topic, or that reports a command outside of which nothing dangerous is left."""
    topic = ~live_command(found, residue("unnamed"), directives=True)
    reported = F.coalesce(F.expr(f"{residue('unreported')}.clean"), F.lit(False))
    return has(view, "quoted_attack", low) | has(view, "artifact", low) & (topic | reported)


def dampened(findings: Column, framed: Column) -> Column:
    """Findings that a frame does not explain; all where there is none."""
    return F.when(framed, F.filter(findings, lambda x: ~x["category"].isin(GATED) | is_live(x))).otherwise(findings)


def _uncoded_sql(text: str) -> str:
    bare = f"regexp_replace({text}, {quoted(fixed.CUES['code_span'])}, ' ')"
    return f"case when rlike({text}, {quoted(fixed.CUES['code_span'])}) and rlike({bare}, {quoted(_CUE['documentary'])}) then {bare} end"


def uncoded(text: str) -> Column:
    """A column's prose without its code spans; null where there are none or where the prose documents nothing."""
    return F.expr(_uncoded_sql(text))


def protective_then_override(text: str, extraction: Column, low: str | None = None) -> Column:
    return extraction & has(text, "protective", low)


#: Any blob begins so.
_BLOB_BEGINS = r"[a-z0-9+/]{24}|%[0-9a-f]{2}%"


def _encoded_directive() -> str:
    apart = "[" + re.escape(fixed.BLOB_SEPARATORS) + "]*"
    blob = "(?:" + "|".join(fixed.BLOBS) + ")"
    # A blob before an order is tried from its beginning alone, and whole, so long runs of letters take one pass.
    before = "(?:" + "|".join([r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{24,4096}+={0,2}", r"(?:%[0-9A-Fa-f]{2}){8,}+"]) + ")"
    return f"(?i)(?:{fixed.DECODE_DIRECTIVE}){apart}{blob}|{before}{apart}(?:{fixed.DECODE_DIRECTIVE})"


ENCODED_DIRECTIVE = _encoded_directive()


def encoded_directive(text: str, low: str | None = None) -> Column:
    """An order to decode or run right before or after an encoded blob; low: the column with the text in lower case."""
    match = f"rlike({text}, {quoted(ENCODED_DIRECTIVE)})"
    return F.expr(f"{may_match(low, fixed.DECODE_DIRECTIVE)} and rlike({low}, {quoted(_BLOB_BEGINS)}) and {match}" if low else match)


def longest_repetition(text: str, shortest: int, longest: int, least: int) -> str | None:
    """A unit of so many characters that stands at least so often in a row, white space folded."""
    text, chars = _folded(text)
    return _repeated(text, chars, _periods(chars, shortest, longest, shortest * (least - 1)), shortest, longest, least)


def _folded(text: str) -> tuple[str, np.ndarray]:
    """A text with white space folded, and its characters as numbers."""
    text = re.sub(r"\s+", " ", text)
    return text, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


#: Probes of a text that are compared at once.
_PROBES = 4096


def _periods(chars: np.ndarray, shortest: int, longest: int, need: int) -> list[int]:
    """The shifts at which a text may be equal to itself over a stretch of need characters, in order.

    Such a stretch holds a whole probe of some characters, as one begins every few characters; so none is missed.
    """
    width = min(32, need)
    short, step = min(8, width), need - width + 1
    padded = np.append(chars, np.full(width + longest, 0xFFFFFFFF, np.uint32))
    rows = sliding_window_view(padded, width + longest)[: max(len(chars), 1) : step]
    found: set[int] = set()
    for k in range(0, len(rows), _PROBES):
        part = rows[k : k + _PROBES]
        equal = np.ones((len(part), longest - shortest + 1), bool)
        for j in range(short):
            equal &= part[:, shortest + j : longest + j + 1] == part[:, j : j + 1]
        row, shift = np.nonzero(equal)
        for j in range(short, width):
            if not len(row):
                break
            same = part[row, j] == part[row, shift + shortest + j]
            row, shift = row[same], shift[same]
        found.update((np.unique(shift) + shortest).tolist())
    return sorted(found)


def _repeated(text: str, chars: np.ndarray, periods: list[int], shortest: int, longest: int, least: int) -> str | None:
    for size in periods:
        # Equal to itself shifted by size, over a stretch of (least - 1) units.
        if shortest <= size <= min(longest, len(text) // least):
            ends = len(text) - size
            breaks = np.flatnonzero(chars[:ends] != chars[size:])
            begins, stops = np.append(0, breaks + 1), np.append(breaks, ends)
            long = np.flatnonzero(stops - begins >= size * (least - 1))
            if len(long):
                i = int(begins[long[0]])
                return text[i : i + size]
    return None


_REPEATS = ArrayType(StructType([StructField("rule", StringType()), StructField("category", StringType()), StructField("score", DoubleType()), StructField("matched", StringType())]))


def repetitions(text: str, rules: list[tuple] = REPETITION_RULES) -> Column:
    """Findings of phrases repeated many times, anywhere in a text; in fewer than 100 characters no rule has room.

    rules: (id, category, score, shortest unit, longest unit, least repeats) of each detector.
    """
    if not rules:
        return F.array().cast(_REPEATS)
    units = min(r[3] for r in rules), max(r[4] for r in rules), min(r[3] * (r[5] - 1) for r in rules)

    def found(text: str | None) -> list:
        out = []
        if not text or len(text) < 100:
            return out
        text, chars = _folded(text)
        periods = _periods(chars, *units)
        for rule, category, score, shortest, longest, least in rules:
            unit = _repeated(text, chars, periods, shortest, longest, least)
            if unit:
                out.append((rule, category, score, unit))
        return out

    @F.pandas_udf(_REPEATS)
    def repeats(texts: pd.Series) -> pd.Series:
        return texts.map(found)

    return repeats(text)


def windows(text: Column, size: int = 100_000, overlap: int = 512, most: int | None = 8) -> Column:
    """Overlapping windows of a long text as structs of place and text; a short one is one window. most: windows at
    most, None for as many as cover the text."""
    step = size - overlap
    count = F.greatest(F.lit(1), F.ceil((F.length(text) - overlap) / step).cast("int"))
    if most is not None:
        count = F.least(F.lit(most), count)
    return F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.struct((k * step).alias("at"), text.substr(k * step + 1, F.lit(size)).alias("part")))
