"""Token ids of whole texts with the tokenizers library, looked up per piece of text.

A text is cut at white space where its encoding splits as well; every distinct piece of a run is
encoded by the library once and kept in a table of this worker, keyed by a 64-bit hash. Rows whose
cuts could matter are encoded whole. The table only saves work: when full, it starts anew.
"""

from __future__ import annotations

import numpy as np

from . import text as T

MOST_PIECES = 2_000_000
_encoders: dict[tuple[str, bool], "Encoder"] = {}


def encoder(path: str, spaced: bool) -> "Encoder":
    """One encoder per worker and tokenizer file."""
    if (path, spaced) not in _encoders:
        _encoders[path, spaced] = Encoder(path, spaced)
    return _encoders[path, spaced]


def wide_blanks(data: np.ndarray) -> np.ndarray:
    """Places of the last byte of white space beyond ASCII: U+0085, 00A0, 1680, 2000-200A, 2028, 2029, 202F, 205F, 3000."""
    if len(data) < 2 or not (data >= 0xC2).any():
        return np.zeros(0, np.int64)
    a, b = data[:-1], data[1:]
    two = np.flatnonzero((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) + 1
    if len(data) < 3:
        return two
    a, b, c = data[:-2], data[1:-1], data[2:]
    e2 = (a == 0xE2) & (((b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
    three = np.flatnonzero(e2 | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))) + 2
    return np.concatenate((two, three))


class Encoder:
    """spaced: white space belongs to the tokens; else it is dropped and letter case ignored."""

    def __init__(self, path: str, spaced: bool):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [a.content.encode() for a in self.library.get_added_tokens_decoder().values()]
        self.spaced = spaced
        self.clear()

    def clear(self) -> None:
        self.keys, self.starts, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        """keys: sorted, none of them known."""
        if len(self.keys) + len(keys) > MOST_PIECES:
            self.clear()
        got = self.library.encode_batch([pieces], is_pretokenized=True, add_special_tokens=False)[0]
        ids, of = np.array(got.ids, np.uint32), np.array(got.word_ids, np.int64)
        sizes = np.bincount(of, minlength=len(pieces)).astype(np.int32)
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool[: self.used], np.zeros(len(self.pool) + len(ids), np.uint32)))
        self.pool[self.used : self.used + len(ids)] = ids
        starts = self.used + np.concatenate(([0], np.cumsum(sizes[:-1], dtype=np.int64)))
        self.used += len(ids)
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.starts = np.insert(self.starts, at, starts)
        self.sizes = np.insert(self.sizes, at, sizes)

    def run(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a run, one after another, and the offsets of the rows in them."""
        n = len(offs) - 1
        starts, ends, row = (T.units if self.spaced else T.words)(data, offs)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        form = data
        if not self.spaced:
            # a letter before a byte beyond ASCII may compose with it, and keeps its case
            upper = T.UPPER[data]
            upper[:-1] &= data[1:] < 0x80
            form = data + upper.astype(np.uint8) * np.uint8(32)
        keys, first, back = np.unique(T.hashes(form, starts, ends), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[at] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            if len(self.keys) + len(new) > MOST_PIECES:
                self.clear()
                new = np.arange(len(keys))
            raw = form.tobytes()
            self._learn(keys[new], [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
            at = np.searchsorted(self.keys, keys)
        sizes, begin = self.sizes[at][back].astype(np.int64), self.starts[at][back]
        total = np.concatenate(([0], np.cumsum(sizes)))
        ids = self.pool[np.arange(total[-1]) + np.repeat(begin - total[:-1], sizes)]
        bounds = total[np.searchsorted(row, np.arange(n + 1), side="left")]
        at = np.concatenate((self._literals(data, offs), wide_blanks(data) if self.spaced else np.zeros(0, np.int64)))
        return self._whole(data, offs, ids, bounds, np.unique(np.searchsorted(offs, at, side="right") - 1)) if len(at) else (ids, bounds)

    def _literals(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """A place in every row that spells out one of the tokenizer's added tokens."""
        raw, found = data.tobytes(), []
        for token in self.special:
            at = raw.find(token)
            while at >= 0:
                found.append(at)
                at = raw.find(token, int(offs[np.searchsorted(offs, at, side="right")]))
        return np.array(found, np.int64)

    def _whole(self, data, offs, ids, bounds, rows):
        """Rows with white space beyond ASCII or literal added tokens are encoded without cuts."""
        raw = data.tobytes()
        fresh = self.library.encode_batch_fast([raw[offs[r] : offs[r + 1]].decode("utf-8", "replace") for r in rows], add_special_tokens=False)
        parts = [ids[bounds[i] : bounds[i + 1]] for i in range(len(bounds) - 1)]
        for r, e in zip(rows, fresh):
            parts[r] = np.array(e.ids, np.uint32)
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


def with_end(ids: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Appends the end id to every row."""
    return np.insert(ids, bounds[1:], np.uint32(end)), bounds + np.arange(len(bounds))
