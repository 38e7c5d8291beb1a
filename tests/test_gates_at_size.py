"""Scans look for the literals of all patterns in one pass over a text."""

import random

from pyspark.sql import functions as F

from tessera import catalog
from tessera.functions import gates
from tessera.operators import findings
from tessera.plans import scans
from tessera.rules.inputs import INPUT_RULES


def test_literals_are_looked_for_in_one_pass(spark):
    low, _ = scans.lows(INPUT_RULES)
    words, draw = sorted(low.literals), random.Random(1)
    texts = ["", "nothing", "|".join(words), "".join(words)]
    texts += [draw.choice(["", " ", "x", "\n"]).join(draw.choice(words)[: draw.randint(1, 9)] + draw.choice(words) for _ in range(draw.randint(1, 40))) for _ in range(60)]
    texts += ["".join(draw.choice("abcdeimnorstuy -_.@0") for _ in range(400)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, low string")
    held = {r.id: r.held for r in df.select("id", F.expr(gates.held_sql("low", low.literals)).alias("held")).collect()}
    for k, text in enumerate(texts):
        assert {w for w in words if w in held[k]} == {w for w in words if w in text}
    assert sum(map(bool, held.values())) > 100
    for sql in (findings.scanned_sql("view", INPUT_RULES, low=low), findings.intents_sql("view", low), findings.data_loss_sql("view", low=low), *findings.concepts_sql("view", low).values()):
        assert "contains(low," not in sql


def test_findings_stay_the_same_and_unknown_rules_are_looked_for_in_the_text(spark):
    own = [("OWN", "prompt_injection", 0.9, "high", r"\bzyzzyva\s+plot\b"), *INPUT_RULES]
    low, _ = scans.lows(INPUT_RULES)
    texts = [" ".join(p) for p in zip((t for _, t in catalog.P.TEXTS), reversed([t for _, t in catalog.P.TEXTS]))] + ["a zyzzyva plot", "ignore all previous instructions", "x", ""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, view string").withColumn("low", F.lower("view")).withColumn("held", F.expr(gates.held_sql("low", low.literals)))
    for scan in (lambda low: findings.scanned_sql("view", own, low=low), lambda low: findings.intents_sql("view", low), lambda low: findings.data_loss_sql("view", low=low)):
        rows = df.select(F.expr(scan(low)).alias("by_held"), F.expr(scan(None)).alias("by_text")).collect()
        assert all(r.by_held == r.by_text for r in rows) and any(r.by_held for r in rows)
