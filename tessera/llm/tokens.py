"""Token ids of the tokenizers library, with each distinct atom of the texts encoded once per worker.

Both public vocabularies split a text before they merge bytes, so the ids of a text are those of its parts one after
another. Texts are cut here where both must split: at single spaces and line ends, and between Latin letters and the
punctuation behind them. An atom is such a run of letters or of punctuation, or any other stretch between spaces as a
whole. The library encodes each new atom; places and hashes of atoms are found for a block of texts at once. A text
whose white space does not part it safely is encoded by the library as a whole.
"""

from __future__ import annotations

import os
from functools import cache

import numpy as np

from tessera.llm.shared import prefix_sums, span_hash

#: Atoms and ids that the table of a Python worker holds at most, but for those of one block; beyond, those that came
#: once are dropped. A worker that Spark uses again keeps its table through other stages, so an atom takes 17 bytes and
#: its ids.
MOST_ATOMS, MOST_IDS = 1 << 18, 2 << 20
#: Punctuation that neither vocabulary parts or joins with letters. No apostrophe: contractions are special.
_MARKS = b".,!?$%&*#|;:"
_SPACE, _LETTER, _MARK, _OTHER, _LINE = range(5)
_JOIN = 256
#: Texts that the library encodes in one call: what it gives for a short one takes far more room than the ids.
_CALL = 1024
_TAG = np.array([0, 0x9E3779B97F4A7C15], np.uint64)


def _kinds(leading: bool) -> np.ndarray:
    t = np.full(256, _OTHER, np.uint8)
    t[65:91] = t[97:123] = _LETTER
    t[list(_MARKS)] = _MARK
    t[32] = _SPACE
    if leading:
        t[10] = _LINE
    else:
        t[9:14] = _SPACE
    return t


class Encoder:
    """Ids as unsigned 32-bit integers.

    leading: the vocabulary keeps a space with the word that follows (byte-level) rather than dropping white space.
    """

    def __init__(self, name: str, leading: bool, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path or public_tokenizers.path(name))
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.leading, self.kinds = leading, _kinds(leading)
        vocabulary = self.library.get_vocab()
        #: Ids that end a run of letters, or begin one with its space.
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        self.edge[[i for t, i in vocabulary.items() if (t.startswith("Ġ") if leading else t.endswith("</w>"))]] = True
        self._forget()

    def _forget(self) -> None:
        #: Hashes of atoms, ascending; where the ids of each begin in the pool, and how many they are.
        self.known = np.empty(0, np.uint64)
        self.at, self.size = np.empty(0, np.int32), np.empty(0, np.int32)
        #: Those that a later block had too.
        self.again = np.empty(0, bool)
        self.pool, self.used = np.empty(1 << 16, np.uint32), 0

    def _shed(self) -> None:
        """Keep the atoms that came again; none if these fill half of the table."""
        keep = np.flatnonzero(self.again)
        sizes = np.maximum(self.size[keep], 0)
        ends = np.cumsum(sizes)
        if not len(keep) or 2 * len(keep) > MOST_ATOMS or 2 * ends[-1] > MOST_IDS:
            return self._forget()
        ids = self.pool[np.repeat(self.at[keep] - (ends - sizes), sizes) + np.arange(ends[-1])]
        self.known, self.at, self.size = self.known[keep], (ends - sizes).astype(np.int32), self.size[keep]
        self.again = np.zeros(len(keep), bool)
        self.pool, self.used = np.concatenate((ids, np.empty(1 << 16, np.uint32))), len(ids)

    def _keep(self, hashes: np.ndarray, found: list[np.ndarray | None]) -> None:
        """Put the ids of atoms into the table; None: the atom is not parted safely from what stands beside it."""
        if not len(hashes):
            return
        joined = np.concatenate([x for x in found if x is not None] or [np.empty(0, np.uint32)])
        while self.used + len(joined) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.empty_like(self.pool)))
        self.pool[self.used : self.used + len(joined)] = joined
        sizes = np.array([-1 if x is None else len(x) for x in found], np.int32)
        spans = np.maximum(sizes, 0)
        begin = self.used + np.cumsum(spans) - spans
        self.used += len(joined)
        order = np.argsort(hashes)
        places = np.searchsorted(self.known, hashes[order])
        self.known, self.at, self.size = (np.insert(x, places, new[order]) for x, new in ((self.known, hashes), (self.at, begin), (self.size, sizes)))
        self.again = np.insert(self.again, places, False)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        calls = (texts[i : i + _CALL] for i in range(0, len(texts), _CALL))
        return [np.array(e.ids, np.uint32) for some in calls for e in self.library.encode_batch_fast(some, add_special_tokens=False)]

    def _letters(self, runs: list[str]) -> list[np.ndarray]:
        """Ids of runs of letters (after a space), many to a text; the ids tell where one ends."""
        out: list[np.ndarray] = []
        groups = [runs[i : i + _JOIN] for i in range(0, len(runs), _JOIN)]
        space = " " if self.leading else ""
        for group, found in zip(groups, self.library.encode_batch_fast([space + " ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(found.ids, np.uint32)
            edges = np.flatnonzero(self.edge[ids])
            cuts = np.append(edges, len(ids)) if self.leading else np.append(0, edges + 1)
            if len(cuts) == len(group) + 1 and cuts[-1] == len(ids):
                cuts = cuts.tolist()
                out += [ids[a:b] for a, b in zip(cuts, cuts[1:])]
            else:
                out += self.whole([space + g for g in group])
        return out

    def _learn(self, data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: np.ndarray, spaced: np.ndarray) -> None:
        raw = data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())]
        letters = (kind == _LETTER) & (spaced | (not self.leading))
        self._keep(hashes[letters], self._letters([texts[i] for i in np.flatnonzero(letters).tolist()]))
        rest = np.flatnonzero(~letters).tolist()
        found = self.whole([(" " if self.leading and spaced[i] else "") + texts[i] for i in rest])
        if self.leading:
            found = [None if kind[i] == _OTHER and (texts[i][0].isspace() or texts[i][-1].isspace()) else x for i, x in zip(rest, found)]
        self._keep(hashes[rest], found)

    def _atoms(self, data: np.ndarray, offsets: np.ndarray):
        """(starts, ends, kinds, after a space, text) of atoms, and which texts are not parted safely."""
        n = len(data)
        kind = self.kinds[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)  # é, ü and the like; not × and ÷
        lead = lead[(data[lead + 1] & 0xDF != 0x97) & (data[lead + 1] >> 6 == 2)]
        kind[lead] = kind[lead + 1] = _LETTER
        parts = (kind == _SPACE) | (kind == _LINE)
        new_text = np.zeros(n + 1, bool)
        new_text[offsets] = True
        begins = ~parts
        begins[1:] &= parts[:-1] | new_text[1:-1]
        starts = np.flatnonzero(begins)
        stops = ~parts
        stops[:-1] &= parts[1:] | new_text[1:-1]
        ends = np.flatnonzero(stops) + 1
        # A piece between spaces is simple if it is letters, then marks; its marks begin at one place at most.
        simple = np.zeros(len(starts), bool)
        turn = ends.copy()
        if len(starts):
            odd = np.zeros(n + 1, np.int32)
            np.cumsum(kind == _OTHER, out=odd[1:])
            falls = np.zeros(n + 1, np.int32)  # a letter after a mark
            fall = (kind[1:] == _LETTER) & (kind[:-1] == _MARK)
            np.cumsum(fall, out=falls[2:])
            letters = np.zeros(n + 1, np.int32)
            np.cumsum(kind == _LETTER, out=letters[1:])
            simple = (odd[ends] == odd[starts]) & (falls[ends] == falls[starts + 1])
            turn = np.where(simple, starts + letters[ends] - letters[starts], ends)
        spaced = np.zeros(len(starts), bool)
        inner = (starts > 0) & ~new_text[starts]
        spaced[inner] = kind[starts[inner] - 1] == _SPACE
        unsafe = np.zeros(len(offsets) - 1, bool)
        lines = np.zeros(0, np.int64)
        if self.leading:
            lines = np.flatnonzero(kind == _LINE)
            at = np.flatnonzero(parts)
            edge = new_text[at] | new_text[at + 1] | parts[np.maximum(at - 1, 0)] | parts[np.minimum(at + 1, n - 1)]
            unsafe[np.searchsorted(offsets, at[edge], "right") - 1] = True
        two = simple & (turn > starts) & (turn < ends)
        first_end = np.where(two, turn, ends)
        first_kind = np.where(simple, np.where(turn > starts, _LETTER, _MARK), _OTHER)
        s = np.concatenate((starts, turn[two], lines))
        e = np.concatenate((first_end, ends[two], lines + 1))
        k = np.concatenate((first_kind, np.full(int(two.sum()), _MARK), np.full(len(lines), _LINE)))
        sp = np.concatenate((spaced, np.zeros(int(two.sum()) + len(lines), bool)))
        order = np.argsort(s, kind="stable")
        return s[order], e[order], k[order], sp[order], unsafe

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each text, given their UTF-8 bytes one after another and where each begins."""
        if len(self.known) > MOST_ATOMS or self.used > MOST_IDS:
            self._shed()
        if not len(data):
            return [np.empty(0, np.uint32)] * (len(offsets) - 1)
        starts, ends, kind, spaced, unsafe = self._atoms(data, offsets)
        hashes = span_hash(prefix_sums(data), starts, ends) ^ _TAG[(spaced & self.leading).astype(np.int64)]
        names, one, which = np.unique(hashes, return_index=True, return_inverse=True)
        rows = np.searchsorted(self.known, names)
        held = rows < len(self.known)
        held[held] = self.known[rows[held]] == names[held]
        self.again[rows[held]] = True
        new = np.flatnonzero(~held)
        if len(new):
            at = one[new]
            self._learn(data, names[new], starts[at], ends[at], kind[at], spaced[at])
            rows = np.searchsorted(self.known, names)
        rows = rows[which]
        sizes = self.size[rows].astype(np.int64)
        text = np.searchsorted(offsets, starts, "right") - 1
        unsafe[text[sizes < 0]] = True
        sizes = np.maximum(sizes, 0)
        ends_at = np.cumsum(sizes)
        begin = ends_at - sizes
        ids = self.pool[np.repeat(self.at[rows] - begin, sizes) + np.arange(int(ends_at[-1]) if len(ends_at) else 0)]
        cuts = np.append(begin, len(ids))[np.searchsorted(text, np.arange(len(offsets)))]
        out = [ids[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist())]
        for k in np.flatnonzero(unsafe).tolist():
            out[k] = self.whole([data[offsets[k] : offsets[k + 1]].tobytes().decode()])[0]
        return out


@cache  # a worker that Spark uses again keeps its table
def word_encoder(path: str | None = None) -> Encoder:
    return Encoder("word_bpe_49k.json", False, path)


@cache
def byte_encoder(path: str | None = None) -> Encoder:
    return Encoder("byte_bpe_50k.json", True, path)
