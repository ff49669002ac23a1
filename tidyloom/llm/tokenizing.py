"""Token ids of whole texts by a tokenizer file, with the work done once for each word.

Byte-pair encoding works on the pieces that the tokenizer's pattern cuts a text into, and most pieces
of a corpus are seen before. Texts are cut at places where every such pattern cuts too; each distinct
piece goes through the tokenizer once and its ids are kept while the Python worker lives. Pieces are found
by a hash, and the bytes of each are compared with those of the piece that was found; one that differs
goes through the tokenizer alone. The places:

* before a space or line break that follows a character that is surely no white space;
* after a line break that stands alone between two such characters;
* between an ASCII letter and ASCII punctuation, in either order, but for apostrophes (contractions).

New pieces are given to the tokenizer many at a time. Where its tokens spell bytes one to one, pieces between
which it is sure to cut are simply joined, and the lengths of the tokens tell them apart; the others
are joined with an added token.

Texts that hold one of the tokenizer's added tokens go through it whole.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from tokenizers import Tokenizer

from tidyloom.llm.byte_words import hash_words, same_words
from tidyloom.llm.common import worker_state

#: Bytes worked on at once, and pieces kept by a worker (some 60 bytes each) before it starts anew.
SLICE, KEPT = 1 << 20, 600_000
#: Bits of the places of the table that finds pieces; a slice adds fewer than 2^19 pieces, so half of it stays free.
TABLE_BITS = 21
#: Pieces joined for one call of the tokenizer, with and without an added token.
MARKED, JOINED = 64, 256


def _kinds() -> np.ndarray:
    """Of each byte: 1 letter, 2 punctuation without the apostrophe, 4 visible ASCII, 8 first byte of a two-byte letter."""
    kinds = np.zeros(256, np.uint8)
    for b in range(0x21, 0x7F):
        c = chr(b)
        kinds[b] = 4 | (1 if c.isalpha() else 2 if not c.isdigit() and c != "'" else 0)
    kinds[0xC3:0xE0] = 8
    return kinds


class WordCache:
    """The ids of pieces by a tokenizer file."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = [t.content for t in added.values()]
        self.mark_id, mark = next(iter(added.items()))
        self.mark = mark.content
        self.kinds = _kinds()
        self.spelled = self._spelled()
        self._clear()

    def _clear(self) -> None:
        #: Hashes of the pieces by number, and the numbers from the place on that a hash names.
        self.hashes, self.table = np.empty(1 << 18, np.uint64), np.full(1 << TABLE_BITS, -1, np.int32)
        self.known, self.used, self.bytes_used = 0, 0, 0
        self.ids, self.text = np.empty(1 << 20, np.uint32), np.zeros(1 << 20, np.uint8)
        #: By number: first id and number of ids, first byte and end in ``text``.
        self.begin, self.length, self.at, self.end = (np.empty(1 << 18, np.int64) for _ in range(4))

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """True where a piece begins."""
        k, n = self.kinds[data], len(data)
        out = np.zeros(n, bool)
        if n < 2:
            return out
        visible = (k & 4) > 0
        solid = visible.copy()  # the last byte of a character that is surely no white space
        solid[1:] |= (k[:-1] == 8) & (data[1:] >= 0x80)
        line = data == 10
        out[1:] = ((data[1:] == 32) | line[1:]) & solid[:-1]
        begins = visible | (k == 8)
        out[2:] |= line[1:-1] & solid[:-2] & begins[2:]
        letter, mark = (k & 1) > 0, (k & 2) > 0
        out[1:] |= (letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])
        return out

    def _grow(self, name: str, size: int) -> None:
        array = getattr(self, name)
        if size > len(array):
            setattr(self, name, np.concatenate([array, np.empty(max(size, 2 * len(array)) - len(array), array.dtype)]))

    def _spelled(self) -> np.ndarray | None:
        """The number of bytes of each token, if its letters stand for bytes; else None."""
        parts = json.loads(self.tokenizer.to_str())
        before = parts["pre_tokenizer"] or {}
        kinds = {p["type"]: p for p in before.get("pretokenizers", [before]) if p}
        if parts["model"]["type"] != "BPE" or parts["normalizer"] or "ByteLevel" not in kinds or kinds["ByteLevel"].get("add_prefix_space"):
            return None
        vocabulary = self.tokenizer.get_vocab()
        out = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            out[i] = len(token)
        return out

    def _apart(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether a piece begins with a space and ends with what is surely no white space: two such are cut apart."""
        last, before = data[ends - 1], np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0)
        solid = ((self.kinds[last] & 4) > 0) | ((self.kinds[before] == 8) & (last >= 0x80))
        return (data[starts] == 32) & solid

    def _ids_of(self, raw: bytes, stops: np.ndarray, apart: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids for the pieces of ``raw`` that end at ``stops``, and where each piece begins and ends among them."""
        if apart:
            got = np.array(self.tokenizer.encode_batch_fast([raw.decode("utf-8", "replace")], add_special_tokens=False)[0].ids, np.uint32)
            read = np.cumsum(self.spelled[got])
            ends = np.searchsorted(read, stops)
            if len(got) and read[-1] == stops[-1] and (read[np.minimum(ends, len(read) - 1)] == stops).all():
                return got, np.append(0, ends[:-1] + 1), ends + 1
        words = [raw[a:b].decode("utf-8", "replace") for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]
        got = np.array(self.tokenizer.encode_batch_fast([self.mark.join(words)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.append(np.flatnonzero(got == self.mark_id), len(got))
        if len(ends) != len(words):
            raise ValueError("the tokenizer's added token did not separate the pieces")
        return got, np.append(0, ends[:-1] + 1), ends

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Keep the ids and bytes of new pieces; their numbers."""
        apart = self._apart(data, starts, ends) if self.spelled is not None else np.zeros(len(starts), bool)
        order = np.argsort(~apart, kind="stable")
        starts, sizes = starts[order], (ends - starts)[order]
        stops = np.cumsum(sizes)
        text = data[np.repeat(starts - (stops - sizes), sizes) + np.arange(int(stops[-1]))]
        raw, n, joined = text.tobytes(), len(order), int(apart.sum())
        groups = [(s, min(joined, s + JOINED), True) for s in range(0, joined, JOINED)]
        groups += [(s, min(n, s + MARKED), False) for s in range(joined, n, MARKED)]
        ids, begin, length, used = [], [], [], self.used
        for s, e, flag in groups:
            a = int(stops[s] - sizes[s])
            got, first, end = self._ids_of(raw[a : int(stops[e - 1])], stops[s:e] - a, flag)
            ids.append(got)
            begin.append(used + first)
            length.append(end - first)
            used += len(got)
        at, now = self.known, slice(self.known, self.known + n)
        for name, size in (("ids", used), ("text", self.bytes_used + len(raw) + 8), *((x, at + n) for x in ("begin", "length", "at", "end", "hashes"))):
            self._grow(name, size)
        self.ids[self.used : used] = np.concatenate(ids)
        self.text[self.bytes_used : self.bytes_used + len(raw)] = text
        self.begin[now], self.length[now] = np.concatenate(begin), np.concatenate(length)
        self.at[now], self.end[now] = self.bytes_used + stops - sizes, self.bytes_used + stops
        self.hashes[now] = hashes[order]
        self.used, self.bytes_used, self.known = used, self.bytes_used + len(raw), at + n
        numbers = np.empty(n, np.int64)
        numbers[order] = np.arange(at, at + n)
        self._enter(hashes, numbers)
        return numbers

    def _enter(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        """Put pieces of different hashes in the table, each at the first free place from that of its hash on."""
        place, left = (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64), np.arange(len(hashes))
        while len(left):
            free = left[self.table[place[left]] < 0]
            self.table[place[free]] = numbers[free]
            left = left[self.table[place[left]] != numbers[left]]
            place[left] = (place[left] + 1) % len(self.table)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of the piece of each hash; -1 if there is none."""
        place = (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        out = self.table[place].astype(np.int64)
        left = np.flatnonzero((out >= 0) & (self.hashes[out] != hashes))
        while len(left):
            place[left] = (place[left] + 1) % len(self.table)
            out[left] = self.table[place[left]]
            left = left[(out[left] >= 0) & (self.hashes[out[left]] != hashes[left])]
        return out

    def _encode_slice(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces that begin at ``starts``, and how many each has."""
        ends = np.append(starts[1:], len(data))
        hashes = hash_words(data, starts, ends)
        if self.known > KEPT:
            self._clear()
        known = self._find(hashes)
        new = np.flatnonzero(known < 0)
        if len(new):
            fresh, first, which = np.unique(hashes[new], return_index=True, return_inverse=True)
            known[new] = self._learn(data, starts[new[first]], ends[new[first]], fresh)[which]
        ids, begin, sizes = self.ids, self.begin[known], self.length[known]
        wrong = np.flatnonzero(~same_words(data, starts, ends, self.text, self.at[known], self.end[known]))
        if len(wrong):
            alone = [np.array(self.tokenizer.encode(data[starts[k] : ends[k]].tobytes().decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32) for k in wrong]
            sizes[wrong] = [len(x) for x in alone]
            begin[wrong] = len(ids) + np.cumsum([0, *sizes[wrong][:-1]])
            ids = np.concatenate([ids, *alone])
        at = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        return ids[at], sizes

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """The ids of each whole text; a null text has none."""
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
        waiting, size = [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if any(a in text for a in self.added):
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                continue
            raw = text.encode("utf-8", "replace")
            if len(raw) > SLICE:
                out[i] = self._encode_long(raw)
                continue
            if size + len(raw) > SLICE:
                self._encode_group(waiting, out)
                waiting, size = [], 0
            waiting.append((i, raw))
            size += len(raw)
        self._encode_group(waiting, out)
        return out

    def _encode_group(self, texts: list[tuple[int, bytes]], out: list[np.ndarray]) -> None:
        if not texts:
            return
        raw = b"".join(t for _, t in texts)
        data = np.frombuffer(raw, np.uint8)
        lengths = np.array([len(t) for _, t in texts])
        first = np.cumsum(lengths) - lengths
        flags = self.cuts(data)
        flags[first] = True
        starts = np.flatnonzero(flags)
        ids, sizes = self._encode_slice(data, starts)
        before = np.concatenate([[0], np.cumsum(sizes)])
        bounds = np.append(before[np.searchsorted(starts, first)], len(ids))
        for (i, _), a, b in zip(texts, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            out[i] = ids[a:b]

    def _encode_long(self, raw: bytes) -> np.ndarray:
        """A text beyond the slice, piece by piece; a piece that is itself longer goes through the tokenizer alone."""
        data = np.frombuffer(raw, np.uint8)
        starts = np.append(np.concatenate([[0], np.flatnonzero(self.cuts(data))]), len(raw))
        parts, i = [], 0
        while i < len(starts) - 1:
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + SLICE, "right")) - 1)
            a, b = int(starts[i]), int(starts[j])
            if b - a > SLICE:
                parts.append(np.array(self.tokenizer.encode(raw[a:b].decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32))
            else:
                parts.append(self._encode_slice(data[a:b], starts[i:j] - a)[0])
            i = j
        return np.concatenate(parts)


def word_cache(path: str) -> WordCache:
    """The cache of this Python worker."""
    caches = worker_state().setdefault("word_caches", {})
    if path not in caches:
        caches[path] = WordCache(path)
    return caches[path]
