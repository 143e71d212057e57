"""Ids of many texts by a byte-level BPE tokenizer of the `tokenizers` library.

Texts are split into the pieces of the tokenizer's pattern by vectorised rules, and the library is asked for each
different piece once; a text with characters outside FAST, or with a special token's string, goes to the library whole.
"""

from __future__ import annotations

import unicodedata
from itertools import chain

import numpy as np

from .common import mix, spread

LETTER, NUMBER, OTHER, BLANK, SPACE, END = range(6)
#: Characters whose classes no version of Unicode has changed; see _classes.
FAST = 0x10000
#: The white space of the pattern's \\s below 0x3001.
_WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_UNSURE = 9


def _classes() -> np.ndarray:
    """The class of each character; _UNSURE where it was not assigned in Unicode 3.2 already, or has changed since."""
    out = np.full(FAST, _UNSURE, np.uint8)
    for c in range(FAST):
        now, then = unicodedata.category(chr(c)), unicodedata.ucd_3_2_0.category(chr(c))
        if now[0] == then[0] and then not in ("Cn", "Cs"):
            out[c] = {"L": LETTER, "N": NUMBER}.get(now[0], OTHER)
    out[list(_WHITE)] = SPACE
    out[0x20] = BLANK
    return out


class PieceEncoder:
    """encode(texts): the ids of all texts, each followed by the id end, as one array, and the number of each text's ids.

    most: different pieces that are kept; beyond it the store starts anew, which changes no result.
    """

    def __init__(self, path: str, end: int = 0, most: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.end, self.most = end, most
        self.classes = _classes()
        self.codes = mix(np.arange(1, FAST + 1, dtype=np.uint64))
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted; start and count in the same order
        self.start, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        start = np.append(self.start, len(self.ids) + np.cumsum(counts) - counts)
        self.ids = np.append(self.ids, np.fromiter(chain.from_iterable(found), np.int32, int(counts.sum())))
        keys = np.append(self.keys, keys)
        order = np.argsort(keys, kind="stable")
        self.keys, self.start, self.count = keys[order], start[order], np.append(self.count, counts)[order]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, keys)
        return at, (self.keys[np.minimum(at, len(self.keys) - 1)] == keys) if len(self.keys) else np.zeros(len(keys), bool)

    def split(self, chars: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where pieces start. ends: the places of the END characters, one after each text."""
        cls = self.classes[chars]
        cls[ends] = END
        n = len(cls)
        white = (cls == BLANK) | (cls == SPACE)
        last = np.empty(n, np.uint8)
        last[0], last[1:] = END, cls[:-1]
        white_before = (last == BLANK) | (last == SPACE)
        follows = np.empty(n, bool)  # the next character belongs to a piece that isn't white space
        follows[-1], follows[:-1] = False, ~white[1:] & (cls[1:] != END)
        start = np.where(white, ~white_before | follows, (cls != last) & (last != BLANK))
        start[ends] = True
        start[ends[:-1] + 1] = True
        for i in np.flatnonzero((chars == 0x27) & start):  # 's 't 're 've 'm 'll 'd at the start of a piece
            tail = "".join(chr(c) for c in chars[i + 1 : i + 3])
            k = 2 if tail[:1] and tail[0] in "stmd" else 3 if tail in ("re", "ve", "ll") else 0
            if k:
                start[i + 1] = False
                if i + k < n:
                    start[i + k] = True
        return np.flatnonzero(start)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not texts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        joined = "\0".join(texts) + "\0"
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        slow = np.zeros(len(texts), bool)
        high = chars >= FAST
        if high.any():
            slow[np.searchsorted(ends, np.flatnonzero(high))] = True
            chars = np.where(high, 0, chars)
        unsure = self.classes[chars] == _UNSURE
        if unsure.any():
            slow[np.searchsorted(ends, np.flatnonzero(unsure))] = True
        for s in self.specials:
            if s in joined:
                slow |= np.fromiter((s in x for x in texts), bool, len(texts))
        start = self.split(chars, ends)
        stop = np.append(start[1:], len(chars))
        # A piece's hash: its characters' codes by their place in it, summed.
        place = np.arange(len(chars)) - np.repeat(start, stop - start)
        key = mix(np.add.reduceat(mix(self.codes[chars] + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), start))
        is_end = np.zeros(len(chars), bool)
        is_end[ends] = True
        is_end = is_end[start]
        text_no = np.searchsorted(ends, start)
        use = ~(is_end | slow[text_no])
        uniq, first, inverse = np.unique(key[use], return_index=True, return_inverse=True)
        if len(self.keys) > self.most:
            self.forget()
        _, known = self.find(uniq)
        if not known.all():
            places = np.flatnonzero(use)[first[~known]]
            self.learn(uniq[~known], [joined[i:j] for i, j in zip(start[places].tolist(), stop[places].tolist())])
        entry = self.find(uniq)[0][inverse]
        ids_from, counts = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        ids_from[use], counts[use] = self.start[entry], self.count[entry]
        pool = [self.ids, np.array([self.end], np.int32)]
        ids_from[is_end], counts[is_end] = len(self.ids), 1
        if slow.any():
            base = len(self.ids) + 1
            for t, e in zip(np.flatnonzero(slow), self.tokenizer.encode_batch_fast([texts[i] for i in np.flatnonzero(slow)], add_special_tokens=False)):
                pool.append(np.array([*e.ids, self.end], np.int32))
                at = np.searchsorted(start, ends[t])
                ids_from[at], counts[at] = base, len(pool[-1])
                base += len(pool[-1])
        ids = np.concatenate(pool)[spread(ids_from, counts)]
        return ids, np.bincount(text_no, weights=counts, minlength=len(texts)).astype(np.int64)


_encoders: dict[str, PieceEncoder] = {}


def encoder_of(path: str) -> PieceEncoder:
    """This process's encoder: a worker's tasks share what it has learnt."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]
