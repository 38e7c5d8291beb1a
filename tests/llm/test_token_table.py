"""The table of atoms that a Python worker keeps: small for each atom, bounded, and the same ids as the library's."""

import tracemalloc

import numpy as np
import pytest

from tessera.llm import tokens

LETTERS = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)


def random_words(rng, n):
    return [bytes(w).decode() for w in LETTERS[rng.integers(0, 26, (n, 8))]]


def block(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])


def test_an_atom_takes_few_bytes():
    rng, encoder, n = np.random.default_rng(1), tokens.Encoder("byte_bpe_50k.json", True), 0
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        for _ in range(5):
            encoder.encode(*block([" ".join(random_words(rng, 20_000))]))
        held, n = tracemalloc.get_traced_memory()[0] - before, len(encoder.known)
    finally:
        tracemalloc.stop()
    assert n > 90_000
    powers = 2 * 8 << 20  # of the hashes, kept for all blocks
    assert held - powers < 100 * n


@pytest.mark.parametrize("name, leading", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_a_full_table_keeps_what_came_again(monkeypatch, name, leading):
    monkeypatch.setattr(tokens, "MOST_ATOMS", 1000)
    rng, encoder = np.random.default_rng(2), tokens.Encoder(name, leading)
    common, learned = random_words(rng, 100), []
    learn = encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda data, hashes, *rest: (learned.append(len(hashes)), learn(data, hashes, *rest)))
    for _ in range(20):
        texts = [" ".join([*common, *random_words(rng, 150)]), "", " ".join(common) + ", x1 été!\n\n (a)  b"]
        found = encoder.encode(*block(texts))
        assert [x.tolist() for x in found] == [encoder.library.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(encoder.known) < 1000 + 400
        assert encoder.used <= len(encoder.pool)
    # After the first block, common words are new only where they came at the table's turn.
    assert sum(learned[1:]) < 19 * 160


@pytest.mark.parametrize("words", [150, 700])
def test_a_table_full_of_common_atoms_starts_anew(monkeypatch, words):
    monkeypatch.setattr(tokens, "MOST_ATOMS", 600)
    rng, encoder = np.random.default_rng(3), tokens.Encoder("byte_bpe_50k.json", True)
    text = " ".join(random_words(rng, words))
    for _ in range(4):
        more = text + " " + " ".join(random_words(rng, 300))
        assert encoder.encode(*block([more]))[0].tolist() == encoder.library.encode(more, add_special_tokens=False).ids
        assert len(encoder.known) < 600 + words + 300 + 10
