"""Tokenisation of whole texts with a public byte-pair tokenizer, at the speed of distinct pieces.

Texts of Latin script are cut by a vectorised form of the tokenizer's own split pattern; each
distinct piece goes through the tokenizers library once per worker and its ids are looked up
afterwards. Pieces are found by a hash and then compared letter by letter. Any other text, and one
that holds an added token such as `<|endoftext|>`, goes through the library as a whole. Both ways
give the ids that the library gives with its defaults and add_special_tokens=False.
"""

from __future__ import annotations

import itertools
import unicodedata

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from .textops import mix, powers, prefix, ragged

LIMIT = 0x250
_CLASS = np.full(LIMIT + 1, 3, np.uint8)  # 0 white space, 1 letter, 2 number, 3 other
for _c in range(LIMIT):
    _kind = unicodedata.category(chr(_c))
    if chr(_c) in " \t\n\r\x0b\x0c\x85\xa0":
        _CLASS[_c] = 0
    elif _kind[0] == "L":
        _CLASS[_c] = 1
    elif _kind[0] == "N":
        _CLASS[_c] = 2

_BREAK = chr(0x10A)  # the line break in a byte-level vocabulary
_CACHE: dict[str, PieceTokenizer] = {}


def load(path: str) -> PieceTokenizer:
    """One tokenizer per worker process; path names a file of public_tokenizers or is a full path."""
    if path not in _CACHE:
        _CACHE[path] = PieceTokenizer(path)
    return _CACHE[path]


class PieceTokenizer:
    MOST = 1 << 19  # distinct pieces kept before the cache starts anew; about 40 bytes each
    BITS = 21  # slots of the table, four times as many
    STEP = 1 << 13  # pieces encoded at once
    JOINED = 512  # pieces that the library gets as one text

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path if "/" in path else public_tokenizers.path(path))
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        suffix = self.library.model.end_of_word_suffix
        self.words = suffix is not None  # lower case, white space dropped
        # ids that end a piece when pieces are encoded together: a line break between them, or a word's last token
        self.ends = np.zeros(self.library.get_vocab_size(), bool)
        self.ends[[i for t, i in self.library.get_vocab().items() if (t.endswith(suffix) if self.words else t == _BREAK)]] = True
        self.clear()

    def clear(self) -> None:
        self.known = 0
        self.table = np.full(1 << self.BITS, -1, np.int32)  # the piece of a slot, by open addressing
        self.keys = np.zeros(1 << 12, np.uint64)  # hashes of known pieces
        self.starts = np.zeros(1 << 12, np.int64)
        self.sizes = np.zeros(1 << 12, np.int32)
        self.arena = np.zeros(1 << 14, np.uint32)
        self.used = 0
        self.letter_starts = np.zeros(1 << 12, np.int64)  # the known pieces themselves
        self.letter_sizes = np.zeros(1 << 12, np.int32)
        self.letters = np.zeros(1 << 14, np.uint16)
        self.letters_used = 0

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text)."""
        split = [t.lower() for t in texts] if self.words else texts  # capitals below the limit may have small letters beyond it
        odd = np.array([_max(s) >= LIMIT or any(a in t or a in s for a in self.added) for s, t in zip(split, texts, strict=True)], bool)
        plain = np.flatnonzero(~odd)
        some = [split[i] for i in plain]
        found = self._pieces("".join(some), prefix(np.array([len(t) for t in some], np.int64)))
        if found is None:  # two pieces share a hash
            odd[:] = True
        elif not odd.any():
            return found
        ids, offsets = [None] * len(texts), np.zeros(len(texts) + 1, np.int64)
        if found is not None:
            for k, i in enumerate(plain):
                ids[i] = found[0][found[1][k] : found[1][k + 1]]
        rest = np.flatnonzero(odd)
        for i, e in zip(rest, self.library.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            ids[i] = np.array(e.ids, np.uint32)
        offsets[1:] = np.cumsum([len(x) for x in ids])
        return np.concatenate(ids) if len(ids) else np.zeros(0, np.uint32), offsets

    def _pieces(self, text: str, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids, offsets) by known pieces, or None if a hash stands for two of them."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(points)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        starts, ends = self._split(points, bounds)
        lengths = ends - starts
        up, down = powers(n + 1)
        sums = prefix((points.astype(np.uint64) + np.uint64(1)) * up[:-1])
        keys = mix((sums[ends] - sums[starts]) * down[starts] + lengths.astype(np.uint64))
        if self.known > self.MOST:
            self.clear()
        which, _ = self._find(keys)
        lost = np.flatnonzero(which < 0)
        if len(lost):
            distinct, first = np.unique(keys[lost], return_index=True)
            begin, size = starts[lost[first]], lengths[lost[first]]
            self._learn(distinct, [text[s : s + m] for s, m in zip(begin.tolist(), size.tolist(), strict=True)], points[ragged(begin, size)], size)
            which[lost], _ = self._find(keys[lost])
        letters = points[ragged(starts, lengths)] if self.words else points  # there the pieces leave no letter out
        if (self.letter_sizes[which] != lengths).any() or (self.letters[ragged(self.letter_starts[which], lengths)] != letters).any():
            return None
        sizes = self.sizes[which].astype(np.int64)
        out = self.arena[ragged(self.starts[which], sizes)]
        return out, prefix(sizes)[np.searchsorted(starts, bounds)]

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(known piece of each hash or -1, the slot where it is or would be)."""
        slot = (keys >> np.uint64(64 - self.BITS)).astype(np.int64)
        at = self.table[slot]
        live = np.flatnonzero((at >= 0) & (self.keys[at] != keys))
        while len(live):
            slot[live] = (slot[live] + 1) & (len(self.table) - 1)
            at[live] = found = self.table[slot[live]]
            live = live[(found >= 0) & (self.keys[found] != keys[live])]
        return at, slot

    def _learn(self, keys: np.ndarray, pieces: list[str], letters: np.ndarray, lengths: np.ndarray) -> None:
        have, need = self.known, self.known + len(keys)
        if need > len(self.starts):
            for name in ("keys", "starts", "sizes", "letter_starts", "letter_sizes"):
                setattr(self, name, np.resize(getattr(self, name), need + need // 2))
        if self.letters_used + len(letters) > len(self.letters):
            self.letters = np.resize(self.letters, (self.letters_used + len(letters)) * 3 // 2)
        self.letters[self.letters_used : self.letters_used + len(letters)] = letters
        self.letter_starts[have:need] = self.letters_used + prefix(lengths)[:-1]
        self.letter_sizes[have:need] = lengths
        self.letters_used += len(letters)
        done = have
        for begin in range(0, len(pieces), self.STEP):
            fresh, sizes = self._encoded(pieces[begin : begin + self.STEP])
            if self.used + len(fresh) > len(self.arena):
                self.arena = np.resize(self.arena, (self.used + len(fresh)) * 3 // 2)
            self.arena[self.used : self.used + len(fresh)] = fresh
            self.starts[done : done + len(sizes)] = self.used + prefix(sizes)[:-1]
            self.sizes[done : done + len(sizes)] = sizes
            self.used += len(fresh)
            done += len(sizes)
        self.keys[have:need], self.known = keys, need
        numbers, left = np.arange(have, need, dtype=np.int32), np.arange(len(keys))
        while len(left):  # of two pieces that want a slot, one moves on
            _, slot = self._find(keys[left])
            self.table[slot] = numbers[left]
            left = left[self.table[slot] != numbers[left]]

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, number of ids of each)."""
        apart = np.array([p.isspace() for p in pieces], bool)  # white space would join the break between pieces
        together = [pieces[i] for i in np.flatnonzero(~apart)]
        texts = [("" if self.words else "\n") + (" " if self.words else "\n").join(together[k : k + self.JOINED]) for k in range(0, len(together), self.JOINED)]
        encoded = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.fromiter(itertools.chain.from_iterable(encoded), np.uint32, sum(map(len, encoded)))
        marks = np.flatnonzero(self.ends[flat])
        if len(marks) != len(together):  # the pieces do not stand apart: one by one
            apart[:], marks = True, marks[:0]
        sizes = np.zeros(len(pieces), np.int64)
        if self.words:
            sizes[~apart] = np.diff(marks, prepend=-1)
            own = flat
        else:
            sizes[~apart] = np.diff(np.append(marks, len(flat)))[: len(marks)] - 1
            own = flat[~self.ends[flat]]
        rest = np.flatnonzero(apart)
        if not len(rest):
            return own, sizes
        alone = [e.ids for e in self.library.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False)]
        sizes[rest] = [len(x) for x in alone]
        out, starts = np.zeros(sizes.sum(), np.uint32), prefix(sizes)[:-1]
        if len(rest) < len(pieces):
            out[ragged(starts[~apart], sizes[~apart])] = own
        out[ragged(starts[rest], sizes[rest])] = np.fromiter(itertools.chain.from_iterable(alone), np.uint32, int(sizes[rest].sum()))
        return out, sizes

    def _split(self, points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces that the tokenizer's pattern finds."""
        n = len(points)
        kind = _CLASS[np.minimum(points, LIMIT)]
        begins = np.zeros(n + 1, bool)
        begins[bounds] = True
        text_start = begins[:n].copy()
        cut = text_start | np.concatenate([[True], kind[1:] != kind[:-1]])
        if self.words:
            cut |= kind == 2
        else:
            # the last white space before a word stands alone; a plain space there joins the word
            follows = np.zeros(n, bool)
            follows[:-1] = (kind[1:] != 0) & ~text_start[1:]
            last = (kind == 0) & follows
            cut |= last
            joins = np.flatnonzero(last & (points == 32)) + 1
            cut[joins] = False
        # contractions: an apostrophe that opens a piece, with s, t, m, d, re, ve or ll after it
        marks = np.flatnonzero((points == 39) & cut)
        marks = marks[marks + 1 < n]
        if len(marks):
            stop = np.concatenate([np.flatnonzero(begins[1 : n + 1]) + 1, [n]])
            end = stop[np.searchsorted(stop, marks, "right")]
            one, two = points[marks + 1], points[np.minimum(marks + 2, n - 1)]
            short = np.isin(one, [ord(c) for c in "stmd"]) & (marks + 2 <= end)
            long = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
            long &= marks + 3 <= end
            for chosen, size in ((short, 2), (long, 3)):
                at = marks[chosen]
                cut[at + 1] = False
                tail = at + size
                tail = tail[(tail < n)]
                cut[tail] = True
                if not self.words:  # a space right after the contraction still joins what follows
                    pass
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n)
        if self.words:
            keep = kind[starts] != 0
            starts, ends = starts[keep], ends[keep]
        return starts, ends


def _max(text: str) -> int:
    return 0 if text.isascii() else ord(max(text))
