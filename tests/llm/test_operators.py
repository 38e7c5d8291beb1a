"""Each operator against a plain version on a small table with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import decontaminate, exact_dedup, html_text, language_model, licenses, near_dedup, packing, quality, substring_dedup, suffixes, token_files
from tessera.llm.components import components
from tessera.llm.markup import text_blocks
from tessera.llm.tokens import byte_encoder, word_encoder

RNG = np.random.default_rng(5)
WORDS = ["".join(RNG.choice(list("abcdefghij"), 4)) for _ in range(300)]


def prose(n):
    return " ".join(RNG.choice(WORDS, n))


BASE = prose(80)
ITEM = prose(30)
TEXTS = [
    None, "", "   \n ", "one", "two words", BASE, BASE, BASE.upper(), BASE + " tail", "front " + BASE, BASE.replace(BASE.split()[40], "changed"), prose(3000), prose(12) + " " + ITEM + " " + prose(9), ITEM[:40],
    "é ü ß ñ " + prose(30), "a" * 700, "Licensed under CC BY-NC 4.0. All rights reserved.", "GNU General Public License", "x\ty\x0bz", prose(60) + " " + BASE[:260] + " " + prose(60), "all rights", "tie one", "Tie One",
]
ROWS = [(i, t, "clash", 1.0) for i, t in enumerate(TEXTS)] + [(500, BASE, "clash", 1.0), (None, prose(20), "clash", 1.0)]
#: Extra columns with the names that operators use inside.
FIELDS = "doc_id long, text string, bucket string, n double"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, FIELDS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], FIELDS)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def low(t):
    return (t or "").encode().lower().decode()


def test_near_duplicates(docs, none):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = {r[0]: shingles(r[1]) for r in ROWS if r[0] is not None}
    top = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 85 * len(sets[a] | sets[b]) and top[b] < top[a]:
                    top[a], changed = top[b], True
    got = by_id(near_dedup.near_duplicates(docs))
    assert {d: (got[d].n_shingles, got[d].component_id, got[d].kept) for d in sets} == {d: (len(s), top[d], top[d] == d) for d, s in sets.items()}
    assert len(got) == len(ROWS) and got[None].kept and near_dedup.near_duplicates(none).count() == 0


def test_a_repeated_row_is_kept_with_its_twin(spark):
    df = spark.createDataFrame([(1, BASE), (1, BASE), (2, BASE)], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect()) == [(1, 1, True), (1, 1, True), (2, 1, False)]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.id: r.component for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


@pytest.mark.parametrize("share", [0.25, 0.01])
def test_exact_duplicates(docs, none, share, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SHARE", share)
    groups = {}
    for d, t, *_ in ROWS:
        groups.setdefault(low(t), []).append(d)
    for keep, pick in (("largest", max), ("smallest", min)):
        got = by_id(exact_dedup.exact_duplicates(docs, keep))
        for d, t, *_ in ROWS:
            g = groups[low(t)]
            k = pick([x for x in g if x is not None], default=None)
            assert (got[d].keep_id, got[d].group_size, got[d].kept, got[d].text_sha256) == (k, len(g), d == k, hashlib.sha256(low(t).encode()).hexdigest())
    assert exact_dedup.exact_duplicates(none).count() == 0


@pytest.mark.parametrize("share", [0.25, 0.01, 1000.0])
def test_one_of_equal_rows_stays(spark, share, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SHARE", share)
    rows = [(i % 40, "Same text") for i in range(200)] + [(None, "same text"), (7, "other"), (7, "other"), (None, "x"), (None, "X"), (3, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for keep, name in (("largest", 39), ("smallest", 0)):
        got = exact_dedup.exact_duplicates(df, keep).collect()
        assert len(got) == len(rows) and sorted((r.doc_id is None, r.keep_id, r.group_size) for r in got if r.kept) == sorted([(False, name, 201), (False, 7, 2), (True, None, 2), (False, 3, 2)], key=lambda r: (r[0], r[1] or 0))


@pytest.mark.parametrize("together", [256, 1])
def test_repeated_strings(docs, none, together, monkeypatch):
    monkeypatch.setattr(substring_dedup, "TOGETHER", together)
    raw = [(d, (t or "").encode()) for d, t, *_ in ROWS]
    seen = Counter(x[i : i + 200] for _, x in raw for i in range(len(x) - 199))
    got = by_id(substring_dedup.repeated_strings(docs))
    for d, x in raw:
        gone = np.zeros(len(x) + 1, bool)
        for i in range(len(x) - 199):
            if seen[x[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = bytes(b for b, g in zip(x, gone) if not g)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans, got[d].kept_sha256) == (len(x), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()), d
    assert substring_dedup.repeated_strings(none).count() == 0


def test_suffix_order_is_right():
    for trial in range(60):
        rng = np.random.default_rng(trial)
        texts = [bytes(rng.integers(0, rng.integers(1, 4) + 1, rng.integers(1, 50)).astype(np.uint8)) for _ in range(rng.integers(1, 7))]
        symbols, _ = suffixes.joined(texts)
        tails = [tuple(symbols[i:]) for i in range(len(symbols))]
        assert [tails[i] for i in suffixes.suffix_order(symbols, 60)] == sorted(tails)
        count = Counter(t[i : i + 9] for t in texts for i in range(len(t) - 8))
        assert [list(x) for x in suffixes.repeated_starts(texts, 9)] == [[count[t[i : i + 9]] > 1 for i in range(len(t) - 8)] for t in texts]


def test_contamination(spark, docs, none):
    items = spark.createDataFrame([(7, ITEM), (10, "two words"), (None, BASE), (3, None), (4, "")], "item_id long, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    wanted = [(i, tuple(w[s : s + min(10, len(w))])) for i, t in ((7, ITEM), (10, "two words"), (None, BASE)) for w in [words(t)] for s in range(len(w) - min(10, len(w)) + 1)]
    got = by_id(decontaminate.contamination(docs, items))
    for d, t, *_ in ROWS:
        w, hit, names = words(t), set(), set()
        for i, x in wanted:
            for s in range(len(w) - len(x) + 1):
                if tuple(w[s : s + len(x)]) == x:
                    hit |= set(range(s, s + len(x)))
                    names |= {str(i)} if i is not None else set()
        assert (got[d].n_words, got[d].hit_words, got[d].items) == (len(w), sorted(hit), sorted(names)), d
    assert decontaminate.contamination(none, items).count() == 0
    assert all(not r.hit_words for r in decontaminate.contamination(docs, items.limit(0)).collect())


def test_slices_and_pieces_of_items_agree(spark, docs, monkeypatch):
    items = spark.createDataFrame([(k, ITEM if k == 3 else prose(25)) for k in range(6)] + [(9, BASE), (10, prose(30) + " " + ITEM)], "item_id long, text string")
    fields = lambda df: {r.doc_id: (r.n_words, r.hit_words, r.items, r.near_items) for r in df.collect()}
    whole = fields(decontaminate.contamination(docs, items, within=6))
    assert any(v[3] for v in whole.values())
    for name, value in (("SLICE_WORDS", 10), ("PIECE_WORDS", 20), ("PAIRS", 3), ("SEGMENT_BYTES", 500)):
        monkeypatch.setattr(decontaminate, name, value)
    assert whole == fields(decontaminate.contamination(docs, items, within=6))


@pytest.mark.parametrize("window", [4, 13])
def test_other_windows(spark, docs, window):
    items = spark.createDataFrame([(1, ITEM), (2, BASE[:200])], "item_id long, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    wanted = {tuple(w[s : s + window]) for t in (ITEM, BASE[:200]) for w in [words(t)] for s in range(len(w) - window + 1)}
    got = by_id(decontaminate.contamination(docs, items, window))
    for d, t, *_ in ROWS:
        w = words(t)
        hit = {s + k for s in range(len(w) - window + 1) if tuple(w[s : s + window]) in wanted for k in range(window)}
        assert (got[d].n_words, got[d].hit_words) == (len(w), sorted(hit)), d


def test_proximity_matches(spark):
    rng = np.random.default_rng(8)
    vocabulary = WORDS[:25]
    texts = [" ".join(rng.choice(vocabulary, int(rng.integers(0, 60)))) for _ in range(60)]
    asked = [" ".join(rng.choice(vocabulary, int(n))) for n in rng.integers(2, 9, 12)]
    docs, items = (spark.createDataFrame(list(enumerate(x)), f"{n} long, text string") for x, n in ((texts, "doc_id"), (asked, "item_id")))
    frequency = Counter(w for t in texts for w in t.split())
    within, window = 3, 4
    for d, r in by_id(decontaminate.contamination(docs, items, window, within)).items():
        w, near, exact = texts[d].split(), set(), set()
        for i, t in enumerate(asked):
            q = t.split()
            for s in range(max(len(q) - window, 0) + 1):
                part = q[s : s + window]
                least = min(frequency[x] for x in part)
                exact |= {str(i) for p in range(len(w)) if w[p : p + len(part)] == part}
                # Of equally rare terms the first in the window is taken.
                rarest = next(x for x in part if frequency[x] == least)
                near |= {str(i) for p, x in enumerate(w) if x == rarest and all(y in w[max(0, p - within) : p + within + 1] for y in part)}
        assert (r.near_items, r.items) == (sorted(near), sorted(exact)), d


def test_licenses(docs, none):
    got = by_id(licenses.scan(docs))
    assert (got[16].base_labels, got[16].n_base, got[16].first_word, got[16].last_word) == ("cc-by,reserved", 2, 2, 7)
    assert got[16].labels == "cc-by,cc-by-nc,reserved" and got[16].score == 1.0
    assert (got[17].base_labels, got[17].n_base) == ("gpl", 1) and got[20].n_base == 0 and got[20].first_word is None
    assert (got[0].n_words, got[0].labels, got[0].score) == (0, "", 0.0)
    assert len(got) == len(ROWS) and licenses.scan(none).count() == 0


def test_license_spans_are_verified(spark):
    mit = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"
    w = mit.split()
    texts = [
        "under the under the under the", "mit license " * 50, "mit license mit license released under the mit license", " ".join([*w[:9], "new", "words", *w[9:]]),
        " ".join([*w[12:], *w[:12]]), " ".join(w[::-1]), "under the " * 40 + "licensed under the apache license version 2 0", " ".join(w[:20]),
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(licenses.scan(df))

    def plain(text):
        words, best, labels = text.split(), 0.0, set()
        for label, t in licenses.TEMPLATES:
            t = t.split()
            votes = [(p, k) for p in range(len(words) - 1) for k in range(len(t) - 1) if words[p : p + 2] == t[k : k + 2]]
            for band in {p - k + e for p, k in votes for e in range(-licenses.NEAR, licenses.NEAR + 1)}:
                top, n = -1, 0
                for _, k in sorted(((p, k) for p, k in votes if abs(p - k - band) <= licenses.NEAR), key=lambda v: (v[0], -v[1])):
                    if k > top:
                        top, n = k, n + 1
                best = max(best, n / (len(t) - 1))
                if n >= licenses.LEAST and n / (len(t) - 1) >= licenses.COVER:
                    labels.add(label)
        return best, ",".join(sorted(labels))

    assert {d: (pytest.approx(r.score), r.labels) for d, r in got.items()} == dict(enumerate(map(plain, texts)))
    assert [got[k].labels for k in range(8)] == ["", "", "mit", "mit", "", "", "apache-2.0", ""]
    assert got[0].score == 0.25 and got[2].score == 1.0


def test_token_files(spark, docs, none, tmp_path):
    encoder = word_encoder()
    for df, name in ((docs, "a"), (none, "b")):
        token_files.write(df, str(tmp_path / name))
    got = token_files.read_back(spark, str(tmp_path / "a")).collect()
    start = 0
    for r, (d, t, *_) in zip(sorted(got, key=lambda r: r.start), sorted(ROWS, key=lambda r: -1 if r[0] is None else r[0])):
        ids = np.append(encoder.whole([t or ""])[0], 1).astype("<u4")
        assert (r.doc_id, r.start, r.n_tokens, bytes(r.ids)) == (d, start, len(ids), ids.tobytes())
        start += len(ids)
    assert token_files.read_back(spark, str(tmp_path / "b")).count() == 0
    dictionary = bytes(spark.read.parquet(str(tmp_path / "a/dictionary")).first().dictionary)
    shards = [token_files.Shard(bytes(r.shard), dictionary) for r in spark.read.parquet(str(tmp_path / "a/shards")).collect()]
    found = [x for x in (s.find(5) for s in shards) if x is not None]
    assert len(found) == 1 and list(found[0]) == [*encoder.whole([BASE])[0], 1]


def test_encoders_agree_with_the_library():
    import pyarrow as pa

    from tessera.llm.shared import utf8

    rng = np.random.default_rng(2)
    marks = ["a", "B", "é", "ß", ".", "!", "|", " ", " ", "\n", "1", "'", "s", "×", "\t", "́", " ", "you", "İ", "-"]
    texts = ["".join(rng.choice(marks, rng.integers(0, 60))) for _ in range(1500)] + ["<|endoftext|> a", "don't it's", "x" * 3000, ""]
    for e in (word_encoder(), byte_encoder()):
        assert all(np.array_equal(a, b) for a, b in zip(e.encode(*utf8(pa.array(texts))), e.whole(texts)))


def test_packing(docs, none):
    encoder = byte_encoder()
    want = {d: np.append(encoder.whole([t or ""])[0], 0).astype("<u4").tobytes() for d, t, *_ in ROWS}
    rows = packing.pack(docs).collect()
    for d, ids in want.items():
        mine = sorted((r for r in rows if r.doc_id == d), key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in mine) == ids and all(r.doc_tokens == len(ids) // 4 and r.length == len(r.ids) // 4 for r in mine)
        assert [r.start for r in mine] == [0, *np.cumsum([r.length for r in mine])[:-1]]
    sequences = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert all(n <= 1024 and n & (n - 1) == 0 for n in sequences.values())
    assert packing.pack(none).count() == 0


def test_language_model(docs, none):
    got = by_id(language_model.language_scores(docs))
    words = {d: [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None] for d, t, *_ in ROWS}
    counts = Counter(w for d, ws in words.items() for w in ws if d is None or zlib.crc32(str(d).encode()) % 5 != 1)
    total, distinct = sum(counts.values()), len(counts)
    for d, ws in words.items():
        base = sum(np.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws)
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), total)
        assert r.base_score == pytest.approx(base) and r.score < 0 and np.isfinite(r.score)
    assert language_model.language_scores(none).count() == 0


def test_language_model_beats_the_base_on_held_out_text(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(300)
    rows = language_model.language_scores(df).where("held_out").collect()
    assert len(rows) > 20 and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_gradients_of_the_network():
    from tessera.llm import gru

    shape = gru.Shape(9, 5, 2, 3)
    rng = np.random.default_rng(1)
    first = np.array([0, 7, 12])
    symbols, classes, words = rng.integers(0, 8, 12), rng.integers(0, 5, 12), rng.integers(0, 3, 12)
    trainer = gru.Trainer(shape, shape.start(np.ones(5), np.ones((2, 3))), rate=0.02)
    before = gru.score(shape, trainer.flat, symbols, classes, words, first, 8)
    for _ in range(200):
        trainer.take(symbols, classes, words, first, 8)
    after = gru.score(shape, trainer.flat, symbols, classes, words, first, 8)
    assert after.mean() > before.mean() + 1 and after.mean() > -0.5  # it learns these by heart
    alone = gru.score(shape, trainer.flat, symbols[7:], classes[7:], words[7:], np.array([0, 5]), 8)
    assert np.allclose(after[7:], alone, atol=1e-4)  # a document's score does not depend on its neighbours


def test_votes_agree_with_plain_ones():
    rng = np.random.default_rng(9)
    counts = rng.poisson(0.02, (60, quality.WIDTH)).astype(np.float32)
    counts[30:40] = counts[20:30]  # ties, some of unlike labels
    labels = rng.integers(0, 2, 60)
    model = quality.Model(counts, labels, (counts > 0).sum(0), 60)
    asked = rng.poisson(0.02, (25, quality.WIDTH)).astype(np.float32)
    asked[:5] = counts[20:25]
    vectors = quality.unit(quality.weighed(asked.copy(), model.idf) @ model.space)
    for v, got in zip(vectors, model.score(asked)):
        near = [(float(v @ w), int(y)) for w, y in zip(model.vectors, labels)]
        last = sorted((s for s, _ in near), reverse=True)[quality.NEIGHBOURS - 1]
        votes = [(max(s, 1e-6) ** quality.POWER, y) for s, y in near if s >= last - 1e-6]
        assert got == pytest.approx(sum(w * y for w, y in votes) / sum(w for w, _ in votes), abs=0.02)


def test_sample_of_repeated_ids_is_bounded(spark):
    rows = [(1, f"{prose(20)} {i}") for i in range(300)] + [(2, "### ### ###")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.fit(df, spark.createDataFrame([(1, 1), (1, 1), (2, 0)], "doc_id long, label int"))
    assert len(model.labels) == 2 and token_files.train_dictionary(df, 2) is not None


def test_a_wide_id_is_refused():
    with pytest.raises(ValueError, match="width 4"):
        token_files.serialized(np.array([5, 70_000], "<u4").tobytes(), 2)


def test_quality(spark, docs, none):
    good = [(1000 + i, prose(60)) for i in range(60)]
    bad = [(2000 + i, " ".join(w + "###" for w in prose(60).split())) for i in range(60)]
    every = spark.createDataFrame(good + bad, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    labels = spark.createDataFrame([(d, 1) for d, _ in good] + [(d, 0) for d, _ in bad] + [(None, 1), (7777, 0)], "doc_id long, quality int")
    got = by_id(quality.quality(every, labels))
    assert all(got[d].predicted == 1 for d, _ in good) and all(got[d].predicted == 0 for d, _ in bad)
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items() if d is not None)
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == len(ROWS) + 120
    assert {r.score for r in quality.quality(docs, labels.limit(0)).collect()} == {0.5} and quality.quality(none, labels).count() == 0


def test_html(spark):
    pages = spark.createDataFrame(
        [(1, "http://a/x/1", "<p>menu</p><p>one &amp; two</p><p>foot</p>", "t"), (2, "http://a/x/2", "<p>menu</p><p>two</p><p>foot</p>", "t"), (3, None, None, "t"), (4, "http://b/", "", "t"), (5, "http://c/", "<nav>n</nav><article><h1>T</h1><p>a<br>b</p><div class='comments'>c</div></article><footer>f</footer>", "t"), (5, "http://c/", "<p>x</p>", "t")],
        "page_id long, url string, html string, text string",
    )
    got = sorted((r.page_id, r.text) for r in html_text.main_text(pages).collect())
    assert got == [(1, "one & two"), (2, "two"), (3, ""), (4, ""), (5, "T\n\na b"), (5, "x")]
    assert html_text.main_text(pages.limit(0)).count() == 0
    assert text_blocks("<p>a<script>var t='</p>'</script> b<!-- x --><li>c") == [("a b", False, False), ("c", False, False)]


def test_copies_of_a_page_keep_their_text(spark):
    article = "".join(f"<p>{prose(30)}</p>" for _ in range(4))
    text = "\n\n".join(re.findall("<p>(.*?)</p>", article))
    rows = [(1, "http://a/x/1", article), (1, "http://a/x/1", article), (2, "http://a/x/2", article)]
    rows += [(3, "http://b/y/1", "<p>menu</p>" + article + "<p>1 May</p>"), (4, "http://b/y/2", "<p>menu</p>" + article + "<p>2 May</p>")]
    rows += [(5, "http://c/1", f"<p>menu of pages</p><article><p>{text[:90].strip()}</p></article><p>foot</p>"), (6, "http://c/2", f"<p>menu of pages</p><article><p>{text[:90].strip()}</p></article><p>note</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id, r.text) for r in html_text.main_text(df).collect())
    same = [("menu\n\n" + text + f"\n\n{k} May") for k in (1, 2)]
    assert got[:5] == [(1, text), (1, text), (2, text), (3, same[0]), (4, same[1])]
    assert [g[1].endswith(end) for g, end in zip(got[5:], ("foot", "note"))] == [True, True] and all(text[:90].strip() in g[1] for g in got[5:])


def test_html_agrees_with_plain_differencing(spark):
    rng = np.random.default_rng(11)
    menu, foot = [prose(3) for _ in range(4)], prose(4)
    pages = []
    for k in range(40):
        body = [prose(int(rng.integers(8, 30))) for _ in range(int(rng.integers(3, 7)))]
        lines = [*menu[: int(rng.integers(1, 5))], *body, foot]
        pages.append((k, f"http://h{k % 3}/p/{k:03d}", lines))
    df = spark.createDataFrame([(k, u, "".join(f"<div>{x}</div>" for x in lines)) for k, u, lines in pages], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.main_text(df).collect()}

    def common(a, b):
        table = [[[] for _ in range(len(b) + 1)] for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + [i] if x == y else max(table[i][j + 1], table[i + 1][j], key=len)
        return table[-1][-1]

    for h in range(3):
        host = sorted((p for p in pages if p[0] % 3 == h), key=lambda p: p[1])
        for i, (k, _, lines) in enumerate(host):
            near = [host[j] for j in (i - 1, i + 1, i - 2, i + 2) if 0 <= j < len(host)][:2]
            gone = {lines[x] for o in near for x in common(lines, o[2])}
            assert got[k] == "\n\n".join(x for x in lines if x not in gone), k


def test_broken_markup_takes_time_in_proportion():
    began = time.perf_counter()
    for piece in ("<a ", "<a '", '<a "<b ', "<div>", "<div></p>", "<!--", "<script", "</", "<p class=' "):
        text_blocks("x" + piece * (2_000_000 // len(piece) // 4))
    text_blocks("x" + "<a " * 700_000)
    assert time.perf_counter() - began < 20
    assert text_blocks("<p>a<b <i>c</i></p> d < e <a") == [("ac", False, False), ("d < e", False, False)]
    assert text_blocks("<p>a</p><!-- b > c") == [("a", False, False)]


def test_common_lines_is_a_longest_common_subsequence():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a, b = (rng.integers(0, 5, rng.integers(0, 14)) for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        for cells in (1 << 22, 4):
            html_text.CELLS = cells
            mask = html_text.common_lines(a, b)
            assert mask.sum() == table[-1, -1]
            it = iter(b)
            assert all(x in it for x in a[mask])
    html_text.CELLS = 1 << 22


def test_rows_of_one_id_with_unlike_texts_are_documents_of_their_own(spark):
    a, b = prose(60), prose(60)
    df = spark.createDataFrame([(1, a), (1, b), (2, a + " z"), (3, b + " z"), (5, a + " y"), (5, prose(50))], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (5, 1, False), (5, 5, True)]


def test_many_members_apart_in_one_bucket(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "APART", 2)
    texts = [" ".join(BASE.split()[:60] + prose(8 * k % 37).split()) for k in range(24)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set(zip(*(t.split()[i:] for i in range(5)))) for t in texts]
    top = list(range(24))
    for _ in range(24):
        for i in range(24):
            for j in range(24):
                if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                    top[i] = min(top[i], top[j])
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df).collect()} == dict(enumerate(top))
