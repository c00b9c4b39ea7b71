"""Token ids of whole texts by a public tokenizer, each distinct word merged once.

The library spends most of its time on splitting texts into words and on merging words that it has
merged before.  Here numpy splits a batch of texts into words on its bytes, by the vocabulary's own
splitting rule; each distinct word is looked up in a bounded table, the library merges those that
are new, and the ids are gathered for all words at once.  Every batch is rebuilt from the table and
compared byte by byte, so a clash of hashes cannot go unseen.

Text that the byte rules do not cover (letters beyond Latin Extended-A, special strings) is encoded
by the library as it stands: word by word, or as a whole text where white space matters.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pandas as pd

#: Kinds of bytes: text end, space, other white space, letters, digits, other visible, by the library.
END, SPACE, BREAK, LETTER, DIGIT, OTHER, WHOLE = range(7)
#: White space outside ASCII: U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
_WIDE_SPACE = tuple(c for c in map(chr, range(128, 0x3001)) if c.isspace())
_CUT = re.compile(r"(?<=\S) (?=\S)")
_SHARED: dict[tuple, "WordEncoder"] = {}


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _kinds(letters: str) -> np.ndarray:
    kinds = np.full(256, WHOLE, np.uint8)
    kinds[:128] = OTHER
    kinds[[9, 10, 11, 12, 13]] = BREAK
    kinds[32], kinds[255] = SPACE, END  # 255 is no byte of UTF-8
    kinds[[ord(c) for c in letters]] = LETTER
    kinds[48:58] = DIGIT
    return kinds


_KINDS = _kinds("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_MARKS = np.random.default_rng(11).integers(1, 2**63, (64, 256), dtype=np.uint64)  # hash value of a byte at a place


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start .. start + size of all spans, one after another."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


class WordEncoder:
    """Encodes texts to little-endian id bytes.  ``keep`` bounds the words in the table.

    When the table is full, the less used half of it goes.  ``chunk`` bounds the bytes that numpy
    works on at once; a longer text is cut between a visible character and a single space.
    """

    def __init__(self, path: str, width: str, keep: int = 400_000, longest: int = 48, chunk: int = 3_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = t = Tokenizer.from_file(path)
        self._width, self._keep, self._longest, self._chunk = np.dtype(width), keep, longest, chunk
        self._parts, self._by_space = (t.normalizer, t.pre_tokenizer), pre_tokenizers.WhitespaceSplit()
        #: White space is dropped, letters are lower-cased, and a word ends with a mark of its own.
        self._spaceless = len({tuple(self._ids(x)) for x in ("A b", " a\n\n b ", "a\t 　b", "A\r\nb")}) == 1
        # byte-level vocabularies write each byte as a visible character, by a fixed rule
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in shown]
        self._written = np.zeros(256, "<u2")
        self._written[shown], self._written[hidden] = shown, 256 + np.arange(len(hidden))
        self._written[255] = 32
        self._token_bytes = np.zeros(max(t.get_vocab(True).values()) + 1, np.int64)
        for token, i in t.get_vocab(True).items():
            self._token_bytes[i] = len(token) - 4 * (self._spaceless and token.endswith("</w>"))
        self._empty_table()
        self._by_bytes = True
        probe = ["a", "The Zebra's mixedCase (x1y22z), 3.14...\n\nwe'll  be: 7th\tA|b\r\n don't 'so' ", " é ñandú STRASSE straße ÀÉ\n", "\n x", "_ a_b 0x1F"]
        self._by_bytes = self.encode(probe) == [self._pack(self._ids(x)) for x in probe]
        self._empty_table()

    def _ids(self, text: str) -> list[int]:
        return self._tokenizer.encode(text, add_special_tokens=False).ids

    def _pack(self, ids) -> bytes:
        return np.asarray(ids, dtype=self._width).tobytes()

    # ---- splitting

    def _split(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes, start and kind of each word, and the words of each text, from texts that end with 255."""
        kind = _KINDS[b]
        lead = np.flatnonzero((b == 0xC3) if self._spaceless else (b >= 0xC3) & (b <= 0xC5))
        if len(lead):  # two-byte letters, but for the signs of multiplication and division
            after = b[lead + 1]
            good = (b[lead] != 0xC3) | (after != 0x97) & (after != 0xB7)
            lead, after = lead[good], after[good]
            kind[lead] = kind[lead + 1] = LETTER
            if self._spaceless:
                b = b.copy()
                b[lead[after <= 0x9E] + 1] += 0x20
        special = np.flatnonzero((b[:-1] == 60) & (b[1:] == 124))  # "<|"
        kind[special] = WHOLE
        word = kind >= LETTER
        if (kind == WHOLE).any():  # what lies between white space goes to the library as one word
            first = np.flatnonzero(word & np.append(True, ~word[:-1]))
            last = np.flatnonzero(word & np.append(~word[1:], True))
            held = np.unique(np.searchsorted(first, np.flatnonzero(kind == WHOLE), "right") - 1)
            kind[spans(first[held], last[held] - first[held] + 1)] = WHOLE
        before = np.append(np.uint8(END), kind[:-1])
        start = word & (before != kind)
        # a contraction stands alone: 's 't 'm 'd 're 've 'll
        at = np.flatnonzero((b == 39) & (kind == OTHER) & (before != OTHER) & (True if self._spaceless else before != SPACE))
        at = at[at + 2 < len(b)]
        one, two = (_LOWER[b[at + k]] if self._spaceless else b[at + k] for k in (1, 2))
        short = np.isin(one, [115, 116, 109, 100])
        long = (one == 114) & (two == 101) | (one == 118) & (two == 101) | (one == 108) & (two == 108)
        start[at[short | long] + 1] = False
        end = at + np.where(long, 3, 2)
        end = end[(short | long) & (end < len(b))]
        start[end[word[end]]] = True
        if self._spaceless:
            start |= kind == DIGIT  # digits stand alone
            keep = word | (b == 255)
            b = np.where(kind == WHOLE, b, _LOWER[b])[keep]
            start, kind = start[keep] | (b == 255), kind[keep]
        else:
            start &= before != SPACE  # a space belongs to the word that it precedes
            white = (kind == SPACE) | (kind == BREAK)
            start |= white & ((before == END) | (before > BREAK))  # a run of white space is one word,
            start |= white & np.append(word[1:], False)  # but for its last place, where a word follows
            start |= b == 255
        at = np.flatnonzero(start)
        ends = b[at] == 255
        per_text = np.diff(np.flatnonzero(ends), prepend=-1) - 1
        size, at = np.diff(at, append=len(b))[~ends], at[~ends]
        whole = kind[np.minimum(at + (kind[at] == SPACE), len(b) - 1)] == WHOLE
        return b, at, np.where(whole, -size, size), per_text

    # ---- merging

    def _merge(self, b: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of words (their bytes one after another), and the number of ids of each."""
        written = self._written[np.insert(b, np.cumsum(size)[:-1], 255)].tobytes().decode("utf-16-le")
        t = self._tokenizer
        t.normalizer, t.pre_tokenizer = None, self._by_space
        try:
            ids = np.array(t.encode_batch_fast([written], add_special_tokens=False)[0].ids, dtype=np.int64)
        finally:
            t.normalizer, t.pre_tokenizer = self._parts
        reach, ends = np.cumsum(self._token_bytes[ids]), np.cumsum(size)
        last = np.searchsorted(reach, ends)
        if len(last) and (last[-1] >= len(reach) or (reach[last] != ends).any()):
            return None
        return ids, np.diff(last, prepend=-1)

    def _by_library(self, b: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw, ends = b.tobytes(), np.cumsum(size).tolist()
        found = [e.ids for e in self._tokenizer.encode_batch_fast([raw[e - n : e].decode() for e, n in zip(ends, size.tolist())], add_special_tokens=False)]
        return np.array([x for f in found for x in f], np.int64), np.array([len(f) for f in found], np.int64)

    # ---- the table of words

    def _empty_table(self) -> None:
        self._hash, self._hits = np.zeros(0, np.uint64), np.zeros(0, np.float32)
        self._ids_of, self._id_start, self._id_size = np.zeros(0, self._width), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._bytes, self._byte_start, self._byte_size = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _make_room(self) -> None:
        if len(self._hash) <= self._keep and len(self._bytes) <= 32 * self._keep:
            return
        hits = np.where(self._byte_size > self._longest, np.float32(-1), self._hits)
        stay = np.argpartition(-hits, min(len(hits) - 1, self._keep // 2))[: self._keep // 2]
        stay = np.sort(stay[hits[stay] >= 0])
        self._hash, self._hits = self._hash[stay], self._hits[stay] / 2
        self._ids_of, self._bytes = self._ids_of[spans(self._id_start[stay], self._id_size[stay])], self._bytes[spans(self._byte_start[stay], self._byte_size[stay])]
        self._id_size, self._byte_size = self._id_size[stay], self._byte_size[stay]
        self._id_start, self._byte_start = np.cumsum(self._id_size) - self._id_size, np.cumsum(self._byte_size) - self._byte_size

    def _learn(self, hashes: np.ndarray, b: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
        """Add new words; a negative size marks those for the library."""
        for chosen, by_library in ((np.flatnonzero(size > 0), False), (np.flatnonzero(size < 0), True)):
            for lo in range(0, len(chosen), 16_384):
                part = chosen[lo : lo + 16_384]
                n = np.abs(size[part])
                own = b[spans(at[part], n)]
                found = None if by_library else self._merge(own, n)
                ids, counts = found or self._by_library(own, n)
                self._id_start = np.append(self._id_start, len(self._ids_of) + np.cumsum(counts) - counts)
                self._byte_start = np.append(self._byte_start, len(self._bytes) + np.cumsum(n) - n)
                self._id_size, self._byte_size = np.append(self._id_size, counts), np.append(self._byte_size, n)
                self._ids_of, self._bytes = np.append(self._ids_of, ids.astype(self._width)), np.append(self._bytes, own)
                self._hash, self._hits = np.append(self._hash, hashes[part]), np.append(self._hits, np.zeros(len(part), np.float32))

    def _encode_chunk(self, texts: list[str]) -> list[bytes]:
        self._make_room()
        b, at, marked, per_text = self._split(np.frombuffer("\udcff".join([*texts, ""]).encode("utf-8", "surrogateescape"), np.uint8))
        size = np.abs(marked)
        if not len(at):
            return [b""] * len(texts)
        own = spans(at, size)
        place = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
        mark = _MARKS[place & 63, b[own]]
        if size.max() > 64:
            mark *= (2 * (place >> 6) + 1).astype(np.uint64)
        firsts = np.cumsum(size) - size
        code, distinct = pd.factorize(np.add.reduceat(mark, firsts) + size.astype(np.uint64))
        first = np.zeros(len(distinct), np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        number = pd.Index(self._hash).get_indexer(distinct)
        fresh = np.flatnonzero(number < 0)
        # those for the library come last in the table
        fresh = np.concatenate([fresh[marked[first[fresh]] > 0], fresh[marked[first[fresh]] < 0]])
        number[fresh] = len(self._hash) + np.arange(len(fresh))
        self._learn(distinct[fresh], b, at[first[fresh]], marked[first[fresh]])
        self._hits[number] += np.bincount(code, minlength=len(distinct))
        word = number[code]
        if (self._byte_size[word] != size).any() or (self._bytes[spans(self._byte_start[word], size)] != b[own]).any():
            return [self._pack(self._ids(t)) for t in texts]  # two words of one hash
        counts = self._id_size[word]
        raw = self._ids_of[spans(self._id_start[word], counts)].tobytes()
        ends = np.append(0, np.cumsum(counts))[np.cumsum(per_text)] * self._width.itemsize
        bounds = [0, *ends.tolist()]
        return [raw[lo:hi] for lo, hi in zip(bounds, bounds[1:])]

    # ---- texts

    def _as_it_stands(self, text: str) -> bool:
        """Texts in which white space that the byte rules do not know meets other white space or special strings."""
        if not self._by_bytes:
            return True
        return not self._spaceless and ("<|" in text or not text.isascii() and any(c in text for c in _WIDE_SPACE))

    def _cuts(self, text: str) -> list[str]:
        out, lo = [], 0
        while len(text) - lo > self._chunk and (found := _CUT.search(text, lo + self._chunk)):
            out.append(text[lo : found.start()])
            lo = found.start()
        return [*out, text[lo:]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Id bytes of each text, the same as of encoding it whole."""
        out: list[list[bytes]] = [[] for _ in texts]
        held, owner, waiting = [], [], 0

        def flush() -> None:
            nonlocal waiting
            for i, ids in zip(owner, self._encode_chunk(held) if held else []):
                out[i].append(ids)
            held.clear(), owner.clear()
            waiting = 0

        for i, text in enumerate(texts):
            if self._as_it_stands(text):
                out[i].append(self._pack(self._ids(text)))
                continue
            for part in self._cuts(text):
                if held and waiting + len(part) > self._chunk:
                    flush()
                held.append(part), owner.append(i)
                waiting += len(part)
        flush()
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]


def shared_encoder(path: str, width: str) -> WordEncoder:
    """One encoder per worker process and vocabulary."""
    key = (path, width)
    if key not in _SHARED:
        _SHARED[key] = WordEncoder(path, width)
    return _SHARED[key]
