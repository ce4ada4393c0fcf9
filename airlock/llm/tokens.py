"""Token ids of whole batches of texts, for the tokenizer files of the `tokenizers` library.

Byte-level BPE looks at one pre-token (a word with the space before it, a run of digits or of
signs, white space) at a time. A batch is therefore split into pre-tokens with array operations,
and the library encodes each different pre-token once per Python worker; a table keyed by the
pre-token's 64-bit hash gives the ids of the rest.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from airlock.llm.flat import flat, pieces, prefix, ranges, span_hash

_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 4
_SLOT_BITS = 20
#: Ids kept before a worker starts its table anew.
_STORE = 1 << 22
#: What follows an apostrophe in a token of its own: fixed values of this tokenizer's pattern.
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
_open: dict[tuple[str, bool], Encoder] = {}
_classes: list[np.ndarray] = []


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str, specials_as_text: bool = False) -> Encoder:
    """The worker's encoder for a file, kept with its table from task to task."""
    key = (path, specials_as_text)
    if key not in _open:
        _open[key] = Encoder(path, specials_as_text)
    return _open[key]


def _char_classes() -> np.ndarray:
    if not _classes:
        import regex

        every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\x00" for c in range(0x110000))
        table = np.full(0x110000, _OTHER, np.uint8)
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\p{White_Space}+")):
            for m in regex.finditer(pattern, every):
                table[m.start() : m.end()] = kind
        _classes.append(table)
    return _classes[0]


class Encoder:
    def __init__(self, path: str, specials_as_text: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = specials_as_text
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.specials = [] if specials_as_text else sorted({t.content for t in added})
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(1 << _SLOT_BITS, np.uint64)
        self.at = np.zeros(1 << _SLOT_BITS, np.int32)
        self.count = np.zeros(1 << _SLOT_BITS, np.int32)
        self.store = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def encode(self, column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the offsets of each text's ids; null counts as empty."""
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for _, _, buf, offs in pieces(*flat(column)):
            part, per_text = self._piece(buf, offs)
            ids.append(part)
            counts.append(per_text)
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64)

    def _piece(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if buf.size == 0:
            return np.zeros(0, np.uint32), np.zeros(len(offs) - 1, np.int64)
        text = buf.tobytes().decode("utf-8")
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if chars.size == buf.size:
            edges = offs
        else:
            edges = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[offs]
        starts = self._pre_tokens(text, chars, edges)
        ends = np.append(starts[1:], chars.size)
        h = span_hash(prefix(chars.astype(np.uint64) + np.uint64(0x3C6F)), starts, ends)
        at, count = self._look_up(h, text, starts, ends)
        ids = self.store[ranges(at, count)]
        total = np.concatenate([[0], np.cumsum(count)])
        return ids, np.diff(total[np.searchsorted(starts, edges)])

    def _pre_tokens(self, text: str, chars: np.ndarray, edges: np.ndarray) -> np.ndarray:
        n = chars.size
        edge = np.zeros(n + 1, bool)
        edge[edges] = True
        whole = []
        for special in self.specials:
            k = text.find(special)
            while k >= 0:
                whole.append((k, k + len(special)))
                edge[[k, k + len(special)]] = True
                k = text.find(special, k + len(special))
        kind = _char_classes()[chars]
        space = kind == _SPACE
        new = edge[:-1]
        turn = new.copy()  # a run of one kind starts here
        turn[1:] |= kind[1:] != kind[:-1]
        after_blank = np.zeros(n, bool)
        after_blank[1:] = (chars[:-1] == 0x20) & ~new[1:]
        starts = turn & (space | ~after_blank)
        starts[:-1] |= space[:-1] & ~space[1:] & ~new[1:]  # the last of a run of white space before a word
        for k in np.flatnonzero(starts & turn & (chars == 0x27)).tolist():
            for ending in _ENDINGS:
                m = k + 1 + len(ending)
                if text.startswith(ending, k + 1) and m <= n and not edge[k + 1 : m].any():
                    starts[k + 1] = False
                    if m < n:
                        starts[m] = True
                    break
        for a, b in whole:
            starts[a] = True
            starts[a + 1 : b] = False
            if b < n:
                starts[b] = True
        return np.flatnonzero(starts)

    def _look_up(self, h: np.ndarray, text: str, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.used > _STORE:
            self._clear()
        slot, other = self._slots(h)
        at, count, found = self.at[slot], self.count[slot], self.keys[slot] == h
        rest = np.flatnonzero(~found)
        second = other[rest]
        at[rest], count[rest], found[rest] = self.at[second], self.count[second], self.keys[second] == h[rest]
        missing = np.flatnonzero(~found | (count == 0))
        if missing.size:
            new, where, back = np.unique(h[missing], return_index=True, return_inverse=True)
            spans = missing[where]
            made = self.tokenizer.encode_batch([text[a:b] for a, b in zip(starts[spans].tolist(), ends[spans].tolist(), strict=True)], add_special_tokens=False)
            lists = [e.ids for e in made]
            sizes = np.fromiter(map(len, lists), np.int32, len(lists))
            ids = np.fromiter((i for x in lists for i in x), np.uint32, int(sizes.sum()))
            if self.used + ids.size > self.store.size:
                self.store = np.concatenate([self.store[: self.used], np.zeros(self.used + 2 * ids.size, np.uint32)])
            self.store[self.used : self.used + ids.size] = ids
            places = (self.used + np.cumsum(sizes) - sizes).astype(np.int32)
            self.used += ids.size
            at[missing], count[missing] = places[back], sizes[back]
            into = np.where(self.count[slot[spans]] == 0, slot[spans], other[spans])
            self.keys[into], self.at[into], self.count[into] = new, places, sizes
        return at, count

    @staticmethod
    def _slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two places where the table may hold a hash."""
        return (h >> np.uint64(64 - _SLOT_BITS)).astype(np.int64), (h & np.uint64((1 << _SLOT_BITS) - 1)).astype(np.int64)
