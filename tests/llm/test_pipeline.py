"""Each stage against a plain version, on a table with nulls, empty and long texts, repeated rows and clashing columns."""

import re
import shutil

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import quality, registry
from tessera.llm.tokens import byte_encoder

SF = "/root/testdata/sf0.001"
FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def near(percent):
    def groups(rows):
        """Components of rows by their word shingles."""
        sets = []
        for _, t in rows:
            w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
            sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
        alike = lambda a, b: a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b)
        links = [(i, j) for i in range(len(rows)) for j in range(i) if rows[i][0] is not None and rows[j][0] is not None and alike(sets[i], sets[j])]
        top = list(range(len(rows)))
        for _ in range(len(links)):
            before = list(top)
            for i, j in links:
                top[i] = top[j] = min(top[i], top[j])
            if before == top:
                break
        return top

    return groups


def plain_exact(rows):
    best = {}
    for d, t in rows:
        k = low(t)
        if k not in best or (-1 if d is None else d) > (-1 if best[k] is None else best[k]):
            best[k] = d
    return sorted(((d, k) for k, d in best.items()), key=repr)


def plain_clean(rows, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    wanted = {tuple(w[s : s + 10]) for w in map(words, items) for s in range(max(len(w) - 9, 1)) if w}
    sizes = {len(w) for w in wanted}

    def dirty(w):
        return any(tuple(w[s : s + n]) in wanted for n in sizes for s in range(len(w) - n + 1))

    return [(d, t) for d, t in rows if not dirty(words(t))]


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(3)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select(*[f.split()[0] for f in FIELDS.split(", ")]).collect()]
    words = [w for r in rows for w in (r[1] or "").split()]
    prose = lambda n: " ".join(rng.choice(words, n))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    base, long = prose(100), prose(20_000)
    # Four words changed in the middle share 92 of 104 shingles in all: 88 %; eight, 84 of 112 and so 75 %; six, 81 %.
    changed = lambda n: " ".join([*base.split()[:40], *prose(n).split(), *base.split()[40 + n :]])
    texts = [(90_001, base), (90_002, changed(4)), (90_003, changed(6)), (90_004, changed(60)), (90_005, None), (90_006, ""), (90_006, ""), (90_007, base.upper()), (90_008, "x"), (90_008, prose(30)), (90_008, prose(30)), (None, prose(40)), (None, base), (90_009, long), (90_009, long), (90_010, prose(20) + " " + item + " " + prose(20))]
    return spark.createDataFrame(rows + [(d, t, None, None, None) for d, t in texts], FIELDS).withColumnsRenamed({"lang": "text_hash", "source": "component", "n_chars": "hash_of_text"}).selectExpr("*", "1 as _id", "2 as _hash", "3 as _text", "4 as chosen_id")


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=repr)


def test_stages_agree_with_plain_ones(spark, odd):
    docs = corpus_pipeline.written(odd, "test")
    rows = pairs(docs)
    stage = dict(corpus_pipeline.STAGES)

    labels = spark.read.parquet(f"{SF}/labels.parquet").where(~quality.held_out()).selectExpr("doc_id", "quality as label")
    model = quality.fit(docs, labels)
    scores = quality.scored(docs, model).collect()
    out = stage["quality"](spark, docs, SF)
    assert out.columns == docs.columns
    good = pairs(out)
    assert len(good) == sum(r.score >= quality.THRESHOLD for r in scores) and set(good) <= set(rows)

    out = stage["exact dedup"](spark, docs, SF)
    assert out.columns == docs.columns
    assert {tuple(r) for r in out.select("doc_id", "hash_of_text", "_id", "_hash", "_text", "chosen_id").collect()} <= {tuple(r) for r in docs.select("doc_id", "hash_of_text", "_id", "_hash", "_text", "chosen_id").collect()}
    once = pairs(out)
    assert sorted(((d, low(t)) for d, t in once), key=repr) == plain_exact(rows)

    out = stage["near dedup"](spark, docs, SF)
    assert out.columns == docs.columns
    left = pairs(out)
    top = near(corpus_pipeline.LIKE)(rows)
    assert near(85)(rows) != top  # a pair between both is planted
    stay = []
    for g in sorted(set(top)):
        mine = [rows[i] for i in range(len(rows)) if top[i] == g]
        least = min(mine, key=lambda r: (r[0] is None, r[0]))[0]
        some = [r for r in mine if r[0] == least]
        stay.append(some)
    for some in stay:
        kept = [r for r in set(some) if r in left]
        assert len(kept) == 1 or not (some[0][1] or "").strip(), some
    assert {r for r in left} <= {r for some in stay for r in some}

    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    out = stage["decontamination"](spark, docs, SF)
    assert out.columns == docs.columns
    assert pairs(out) == plain_clean(rows, items) and len(plain_clean(rows, items)) < len(rows)

    encoder = byte_encoder()
    sizes = sorted(((d, len(encoder.whole([t or ""])[0]) + 1) for d, t in rows), key=repr)
    packed = stage["packing"](spark, docs, SF).collect()
    assert sorted(((r.doc_id, r.doc_tokens) for r in packed if r.start == 0), key=repr) == sizes
    assert sum(r.length for r in packed) == sum(n for _, n in sizes)


def test_run_applies_the_stages_in_order(spark, tmp_path):
    docs, want = spark.read.parquet(f"{SF}/documents.parquet"), None
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF), "test")
    want = sorted((r.doc_id, r.start, r.length) for r in docs.select("doc_id", "start", "length").collect())
    got = corpus_pipeline.run(spark, SF)
    assert len(want) and {(r[0]) for r in want} == {r.doc_id for r in got.collect()}
    # An empty table of documents gives no sequences.
    for t in ("labels", "benchmark"):
        shutil.copy(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    assert [k.split("_")[0] for k in registry.queries()] == [f"op{n}" for n in range(1, 14)]
