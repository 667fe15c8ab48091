"""Token ids as compressed, checksummed binary blocks: an adaptive context-mixing range coder.

A segment of ids is cut into blocks, each coded on its own with fresh statistics. Three predictions stand before each id: what
followed the last two ids (order 2), what followed the last id (order 1), and the frequencies of all ids (order 0), which
the segment's head gives and with which each block begins. The coder codes which of the first two is right, or that
neither is. The odds mix two adaptive models, each with a few states: how well the order-2 prediction has held, and how well the
order-1 prediction has. An id that neither met is coded by its order-0 frequency. Both parts make one interval of a 64-bit
carry-less range coder. All totals are powers of two, so writing needs no division and reading one.

The blocks of a segment are coded in lockstep, a lane a block, so each step is a few dozen array operations for a thousand ids. All
arithmetic is in integers, so decoding retraces it exactly.

A segment holds whole documents in order: ``TGS2``, counts, the order-0 frequencies with their CRC-32, then for each block its size, the CRC-32 of its
ids and its code. Segments are binary rows of a Parquet table in the shared folder, with the documents' ids and lengths beside
them, so Spark's own readers and committers reach them wherever that folder is.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallygrid.llm.common import checkpoint, saved

MAGIC = b"TGS2"
#: Most blocks of a segment, and least ids of a block; ids after which a segment is closed.
LANES, LEAST, SEGMENT = 2048, 512, 1 << 21
#: Segments whose places are broadcast; beyond, they are joined by shuffling.
MOST_BROADCAST = 500_000
#: Places for a worker's words, a power of two, of 32 bytes; a table that is three fifths full is emptied. Longer words that it keeps besides, at most.
PLACES, CACHE = 1 << 22, 100_000
#: Bytes of text that are looked up at once; a longer text is taken in pieces.
AT_ONCE = 4 << 20
#: Fixed value: ASCII punctuation that is cut off the end of a word (no apostrophe, with which contractions begin).
TAIL = b'.,;:!?#$%&*|"()'
#: Slots of each lane's order-1 and of its order-2 table; bits of the odds and of the frequencies; a power of two is how far odds move.
SLOTS, ODDS, WEIGHTS, RATE = 512, 17, 18, 5
_TOP, _BOTTOM = np.uint64(1 << 48), np.uint64(1 << 40)
_U16, _U48, _SCALE = np.uint64(16), np.uint64(48), np.uint64(ODDS + WEIGHTS)
#: The two odds of a model, of 16 bits each, are fields of one integer. What a decay leaves of them, what the one that held gains, and how they begin.
_DECAY = (0xFFFF >> RATE) * 0x1_0000_0001
_GAIN = np.array([0, (65536 >> RATE) - 8 << 32, (65536 >> RATE) - 8, (65536 >> RATE) - 8])
_BEGIN = 4096 * 0x1_0000_0001
_MIX = np.uint32(0x9E3779B1)


class _Lanes:
    """Statistics of many blocks side by side, a lane a block; of two rows, the first is order 1 and the second order 2.

    Contexts, slots and predictions are 32-bit integers and what serves as an index is made wide once, as arithmetic of mixed widths is several times as slow.
    """

    def __init__(self, n: int, weights: np.ndarray):
        lane = np.arange(n)
        self.first = np.stack([lane * SLOTS, (n + lane) * SLOTS]).astype(np.uint32)
        self.states = np.stack([lane * 4, (n + lane) * 4]).astype(np.uint32)
        self.table, self.odds = np.zeros(2 * n * SLOTS, np.uint32), np.full(2 * n * 4, _BEGIN, np.int64)
        self.hash, self.mixed = np.zeros((2, n), np.uint32), np.zeros(n, np.uint32)
        self.bounds = np.zeros((4, n), np.int64)
        self.bounds[3] = 1 << ODDS
        # by which predictions hold (order 1 counts 1, order 2 counts 2): where the interval begins among the bounds
        self.place, self.lane = np.array([2 * n, n, 0, 0]), lane
        # beyond the ids' own, a place for what a prediction met: all of the frequencies
        self.whole = len(weights)
        self.least = np.append(np.cumsum(weights) - weights, 0).astype(np.int64)
        self.weights = np.append(weights, 1 << WEIGHTS).astype(np.int64)

    def predict(self) -> None:
        at = self.hash >> 15
        at &= SLOTS - 1
        at += self.first
        self.at = at.astype(np.int64)
        self.slot = self.table.take(self.at)
        self.guess = self.slot >> 2
        row = self.slot & 3
        row += self.states
        self.row = row.astype(np.int64)
        self.now = self.odds.take(self.row)
        both = self.now[0] + self.now[1]
        np.bitwise_and(both, (1 << ODDS) - 1, out=self.bounds[1])
        both >>= 32
        np.add(self.bounds[1], both, out=self.bounds[2])

    def met(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which predictions are the ids, and the same as a number for each lane."""
        hit = self.guess == ids
        flags = hit.view(np.uint8)
        return hit, (flags[0] | flags[1] << 1).astype(np.int64)

    def interval(self, ids: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids' intervals start, and their widths, out of 2 to the power of ODDS + WEIGHTS."""
        at = self.place.take(held)
        at += self.lane
        low = self.bounds.take(at)
        at += len(ids)
        wide = self.bounds.take(at)
        wide -= low
        of = ids.astype(np.int64)
        np.putmask(of, held, self.whole)
        low <<= WEIGHTS
        low += wide * self.least.take(of)
        wide *= self.weights.take(of)
        return low.view(np.uint64), wide.view(np.uint64)

    def update(self, ids: np.ndarray, hit: np.ndarray, held: np.ndarray) -> None:
        odds = self.now >> RATE
        odds &= _DECAY
        np.subtract(self.now, odds, out=odds)
        odds += _GAIN.take(held)
        self.odds[self.row] = odds
        slot, missed = self.slot, ids << 2
        new = np.minimum(slot + 1, slot | 3)
        # the one or the other without a branch: a choice by a random mask is slow
        new ^= missed
        new *= hit.astype(np.uint32)
        new ^= missed
        self.table[self.at] = new
        h = self.hash
        np.multiply(ids, _MIX, out=h[0])
        np.bitwise_xor(h[0], self.mixed, out=h[1])
        np.right_shift(h[0], 7, out=self.mixed)


def _settle(low: np.ndarray, span: np.ndarray, move) -> None:
    """Shift settled upper bits out of each lane until its interval is wide enough; ``move`` writes or reads 16 bits of some lanes."""
    end = low + span
    end ^= low
    todo = ((end < _TOP) | (span < _BOTTOM)).nonzero()[0]
    while len(todo):
        a, s = low.take(todo), span.take(todo)
        end = a + s
        end ^= a
        if len(cut := (end >= _TOP).nonzero()[0]):
            s[cut] = (~a.take(cut) + np.uint64(1)) & (_BOTTOM - np.uint64(1))
        move(todo, a)
        a <<= _U16
        s <<= _U16
        low[todo], span[todo] = a, s
        end = a + s
        end ^= a
        todo = todo.take(((end < _TOP) | (s < _BOTTOM)).nonzero()[0])


def encode_blocks(blocks: np.ndarray, weights: np.ndarray) -> list[bytes]:
    """The code of each row of ``blocks``, equally many ids a row, by order-0 ``weights`` of all ids."""
    n = len(blocks)
    lanes, low, span = _Lanes(n, weights), np.zeros(n, np.uint64), np.full(n, (1 << 64) - 1, np.uint64)
    of, said, kind = [], [], np.uint16 if n <= 1 << 16 else np.uint32

    def write(todo: np.ndarray, a: np.ndarray) -> None:
        of.append(todo.astype(kind))
        said.append((a >> _U48).astype("<u2"))

    for ids in np.ascontiguousarray(blocks.T, np.uint32):
        lanes.predict()
        hit, held = lanes.met(ids)
        start, wide = lanes.interval(ids, held)
        span >>= _SCALE
        start *= span
        low += start
        span *= wide
        _settle(low, span, write)
        lanes.update(ids, hit, held)
    every = np.arange(n)
    for _ in range(4):
        write(every, low)
        low <<= _U16
    # what lanes wrote in turn is put in order of lanes
    lane = np.concatenate(of)
    code = np.concatenate(said)[np.argsort(lane, kind="stable")].tobytes()
    ends = (2 * np.cumsum(np.bincount(lane, minlength=n))).tolist()
    return [code[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def decode_blocks(codes: list[bytes], length: int, weights: np.ndarray) -> np.ndarray:
    """The ids of blocks that ``encode_blocks`` made, ``length`` a row."""
    n = len(codes)
    lanes, low, span = _Lanes(n, weights), np.zeros(n, np.uint64), np.full(n, (1 << 64) - 1, np.uint64)
    width = max(map(len, codes), default=0) // 2 + 8
    words, at = np.zeros((n, width), "<u2"), np.arange(n) * width
    for i, c in enumerate(codes):
        words[i, : len(c) // 2] = np.frombuffer(c, "<u2")
    words = words.reshape(-1)
    value = np.zeros(n, np.uint64)

    def read(todo: np.ndarray, a: np.ndarray) -> None:
        where = at.take(todo)
        v = value.take(todo)
        v <<= _U16
        v |= words.take(where, mode="clip").astype(np.uint64)  # a damaged block may ask for more
        value[todo] = v
        where += 1
        at[todo] = where

    every = np.arange(n)
    for _ in range(4):
        read(every, low)
    which = np.repeat(np.arange(len(weights), dtype=np.uint16), weights)
    out, most = np.zeros((length, n), np.uint32), np.uint64((1 << ODDS + WEIGHTS) - 1)
    b = lanes.bounds
    for k in range(length):
        lanes.predict()
        span >>= _SCALE
        point = value - low
        point //= span
        point = np.minimum(point, most, out=point).view(np.int64)
        part = point >> WEIGHTS
        # exact: the quotient of such small integers cannot round up to the next
        point -= b[2] << WEIGHTS
        ids = which.take((point / (b[3] - b[2])).astype(np.int64), mode="clip").astype(np.uint32)
        np.putmask(ids, part < b[2], lanes.guess[0])
        np.putmask(ids, part < b[1], lanes.guess[1])
        out[k] = ids
        hit, held = lanes.met(ids)
        start, wide = lanes.interval(ids, held)
        start *= span
        low += start
        span *= wide
        _settle(low, span, read)
        lanes.update(ids, hit, held)
    return np.ascontiguousarray(out.T)


def weights_of(ids: np.ndarray) -> np.ndarray:
    """Integers for the ids from 0 to the greatest that add up to 2 to the power of WEIGHTS, about as the ids' counts do, and 1 at least for each id there is."""
    count = np.bincount(ids)
    there = count > 0
    free = (1 << WEIGHTS) - int(there.sum())
    out = there + count * free // len(ids)
    out[int(count.argmax())] += (1 << WEIGHTS) - int(out.sum())
    return out


def pack(ids: np.ndarray, least: int = LEAST, lanes: int = LANES) -> bytes:
    """A segment of ids (below 65,536), in blocks of ``least`` ids or more, and in at most ``lanes`` blocks."""
    if len(ids) and int(ids.max()) >= 1 << 16:
        raise ValueError("ids must be below 65,536")
    width = max(-(-len(ids) // lanes), min(least, len(ids)))
    n = -(-len(ids) // width) if width else 0
    if not n:
        return MAGIC + struct.pack("<QIIII", 0, 0, 0, 0, 0)
    weights = weights_of(ids)
    rows = np.full(n * width, ids[-1], np.int32)
    rows[: len(ids)] = ids
    codes = encode_blocks(rows.reshape(n, width), weights)
    head = zlib.compress(weights.astype("<u4").tobytes(), 1)
    out = [MAGIC, struct.pack("<QIIII", len(ids), n, width, len(head), zlib.crc32(head)), head]
    plain = ids.astype("<u4")
    for i, c in enumerate(codes):
        out += [struct.pack("<II", len(c), zlib.crc32(plain[i * width : (i + 1) * width])), c]
    return b"".join(out)


def unpack(data: bytes) -> np.ndarray:
    """The ids of a segment; raises ValueError if it is no segment or a checksum fails."""
    if data[:4] != MAGIC or len(data) < 28:
        raise ValueError("not a segment of token ids")
    total, n, width, size, crc = struct.unpack_from("<QIIII", data, 4)
    head, at, codes, sums = data[28 : 28 + size], 28 + size, [], []
    if zlib.crc32(head) != crc:
        raise ValueError("the head is damaged")
    if not n:
        return np.zeros(0, "<u4")
    for _ in range(n):
        if at + 8 > len(data):
            raise ValueError("a segment is cut short")
        size, crc = struct.unpack_from("<II", data, at)
        codes.append(data[at + 8 : at + 8 + size])
        sums.append(crc)
        at += 8 + size
    weights = np.frombuffer(zlib.decompress(head), "<u4").astype(np.int64)
    ids = decode_blocks(codes, width, weights).reshape(-1)[:total].astype("<u4")
    for i, crc in enumerate(sums):
        if zlib.crc32(ids[i * width : (i + 1) * width]) != crc:
            raise ValueError(f"block {i} is damaged")
    return ids


class Words:
    """A hash table of words of up to 16 bytes, none of them zero, with up to seven ids below 65,536 each.

    A row is 32 bytes: the word's own bytes, which are its key, so no two words can be taken for each other; its ids; how many they are.
    """

    LONGEST, MOST_IDS = 16, 7

    def __init__(self, places: int = PLACES):
        self.rows, self.used, self.shift = np.zeros((places, 4), np.uint64), 0, np.uint64(65 - places.bit_length())

    def _place(self, keys: np.ndarray) -> np.ndarray:
        h = keys[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ keys[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F)
        return ((h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> self.shift).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or zeros."""
        at, last = self._place(keys), len(self.rows) - 1
        out = self.rows.take(at, axis=0)
        todo = np.flatnonzero((out[:, 0] != keys[:, 0]) | (out[:, 1] != keys[:, 1]))
        while len(todo := todo[out[todo, 0] != 0]):
            at[todo] = at[todo] + 1 & last
            out[todo] = self.rows.take(at[todo], axis=0)
            todo = todo[(out[todo, 0] != keys[todo, 0]) | (out[todo, 1] != keys[todo, 1])]
        return out

    def add(self, rows: np.ndarray) -> None:
        """Keep the rows of words that are not there, each once."""
        most, last = len(self.rows) * 3 // 5, len(self.rows) - 1
        if self.used + len(rows) > most:
            self.rows[:], self.used, rows = 0, 0, rows[:most]
        self.used += len(rows)
        at, todo = self._place(rows), np.arange(len(rows))
        while len(todo):
            free = todo[self.rows[at[todo], 0] == 0]
            self.rows[at[free]] = rows[free]  # of several that ask for a place, one gets it
            todo = todo[(self.rows[at[todo], :2] != rows[todo, :2]).any(axis=1)]
            at[todo] = at[todo] + 1 & last


#: The bytes of a word that count, in each half of its key, by the word's length.
_HALF = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(17)], np.uint64)
_KEYS = np.stack([_HALF, np.append(np.zeros(8, np.uint64), _HALF[:9])], axis=1)
_BLANK = re.compile(rb"[ \t-\r]")
#: Which of eight fields are a row's ids, by their number: eight flags in one integer.
_FIRST = (np.arange(8) < np.arange(8)[:, None]).view(np.uint64).reshape(-1)
#: Which bytes are ASCII letters or digits, and punctuation that is cut off.
_ALNUM, _TAIL = (np.isin(np.arange(256), list(x)) for x in (b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", TAIL))


#: Fixed value: the second bytes of the letters U+00C0 to U+00FF.
_SECOND = np.isin(np.arange(256), sorted({*range(0x80, 0xC0)} - {0x97, 0xB7}))
#: The model knows a byte of a letter beyond ASCII by the character of that number, and these by others.
_BYTES = (("\x9f", "\u0141"), ("\xa0", "\u0142"), ("\xad", "\u0143"))


class WordTokenizer:
    """A tokenizer that drops white space and cuts between letters and punctuation, so that texts may be encoded word by
    word, and words apart from the punctuation after them, each word once for as long as a table holds it.

    The library's normalizer composes characters before it lower-cases, so A-Z are lower-cased beforehand only in texts that are composed and stay so.
    New words of letters only are encoded together, as one text, and cut at the ends of words; those of a-z and of U+00DF to U+00FF, which
    normalizing leaves as they are, by the library's model without its normalizer. Unless ``special``, the strings of special tokens are ordinary
    text, so that no text can make a control token.
    """

    def __init__(self, path: str, special: bool = False, places: int = PLACES, at_once: int = AT_ONCE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer, self.plain, self.words, self.cache = Tokenizer.from_file(path), Tokenizer.from_file(path), Words(places), {}
        self.tokenizer.encode_special_tokens = self.plain.encode_special_tokens = not special
        self.plain.normalizer, self.plain.pre_tokenizer = None, WhitespaceSplit()
        self.special, self.at_once = special, at_once
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.last[i] = token.endswith("</w>")

    @staticmethod
    def _ids(tokenizer, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)(texts, add_special_tokens=False)]

    def _together(self, tokenizer, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of words of letters, encoded as one text, which is cut at the ends of words; those for which this failed are left out."""
        out = {}
        for k in range(0, len(words), 2000):
            part = words[k : k + 2000]
            ids = np.array(self._ids(tokenizer, [b" ".join(part).decode()])[0], "<u2")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                raw, ends = ids.tobytes(), (2 * ends).tolist()
                out.update(zip(part, [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))
        return out

    def _encoded(self, new: set[bytes]) -> dict[bytes, bytes]:
        """The ids of words, whatever they hold."""
        cut, letters, other = [], set(), set()
        for w in new:
            stem = w.rstrip(TAIL)
            parts = [stem, w[len(stem) :]] if len(stem) < len(w) and stem[-1:].isalnum() else [w]  # an ASCII letter or digit
            if len(parts) > 1:
                cut.append((w, *parts))
            for x in parts:
                (letters if x.isalpha() and x.islower() else other).add(x)  # a-z only
        composed = [w for w in other if not w.isascii() and unicodedata.normalize("NFC", w.decode()).lower().isalpha()]
        out = self._together(self.plain, list(letters)) | self._together(self.tokenizer, composed)
        rest = [w for w in (*letters, *other) if w not in out]
        out.update(zip(rest, [np.array(ids, "<u2").tobytes() for ids in self._ids(self.tokenizer, [w.decode() for w in rest])], strict=True))
        for w, stem, tail in cut:
            out[w] = out[stem] + out[tail]
        return out

    def _rows(self, keys: np.ndarray) -> np.ndarray:
        """Rows for the table of new words, each once. A row ends with the number of ids and one more: zero is no word, and two beyond the most is a word of too many."""
        rows = np.zeros((len(keys), 4), np.uint64)
        rows[:, :2] = keys
        letters, fields = rows.view(np.uint8)[:, :16], rows.view("<u2")[:, 8:]
        spaced = np.concatenate([letters, np.full((len(rows), 1), 32, np.uint8)], axis=1)
        lead, second = letters == 0xC3, (letters >= 0x9F) & (letters <= 0xBF) & (letters != 0xB7)
        plain = np.flatnonzero(((letters - np.uint8(97) < 26) | (letters == 0) | lead | second).all(axis=1) & (lead[:, :-1] == second[:, 1:]).all(axis=1) & ~second[:, 0] & ~lead[:, -1])
        for k in range(0, len(plain), 2000):
            some = plain[k : k + 2000]
            said = spaced[some]
            raw = said[said != 0].tobytes().decode("latin-1")
            for byte, letter in _BYTES:
                raw = raw.replace(byte, letter)
            ids = np.array(self._ids(self.plain, [raw])[0], "<u2")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                self._put(fields, some, ids, np.diff(ends, prepend=0))
        if len(rest := np.flatnonzero(fields[:, 7] == 0)):
            words = np.ascontiguousarray(letters[rest]).view("S16").reshape(-1).tolist()
            of = self._encoded(set(words))
            ids = [of[w] for w in words]
            self._put(fields, rest, np.frombuffer(b"".join(ids), "<u2"), np.array([len(x) // 2 for x in ids]))
        return rows

    @staticmethod
    def _put(fields: np.ndarray, some: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        fits = counts <= Words.MOST_IDS
        mine = np.zeros((len(some), 8), "<u2")
        mine[:, :7][np.arange(7) < np.where(fits, counts, 0)[:, None]] = ids[np.repeat(fits, counts)]
        mine[:, 7] = np.where(fits, counts + 1, Words.MOST_IDS + 2)
        fields[some] = mine

    def _lowered(self, text: str | None) -> bytes:
        raw = (text or "").encode()
        if self.special:
            return raw
        low = raw.lower()
        stays = len(low) == len(text or "") or (unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low.decode()))
        return low if stays else raw

    def _each(self, words: list[bytes]) -> list[bytes]:
        """The ids of words that the table cannot hold."""
        if len(self.cache) > CACHE:
            self.cache.clear()
        if new := set(words).difference(self.cache):
            self.cache.update(self._encoded(new))
        return [self.cache[w] for w in words]

    def _pieces(self, raw: bytes) -> Iterator[bytes]:
        """A text, cut at white space; only a longer word makes a longer piece."""
        at = 0
        while len(raw) - at > self.at_once:
            cut = max(raw.rfind(b" ", at + 1, at + self.at_once), raw.rfind(b"\n", at + 1, at + self.at_once))
            if cut < 0:
                blank = _BLANK.search(raw, at + self.at_once)
                cut = blank.start() if blank else len(raw)
            yield raw[at:cut]
            at = cut
        yield raw[at:]

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 16-bit integers."""
        out, some, size = [], [], 0
        for t in texts:
            raw = self._lowered(t)
            if size + len(raw) > self.at_once:
                out += self._looked_up(some)
                some, size = [], 0
            if len(raw) > self.at_once:
                out.append(b"".join(self._looked_up([piece])[0] for piece in self._pieces(raw)))
            else:
                some.append(raw)
                size += len(raw)
        return out + self._looked_up(some)

    def _looked_up(self, raw: list[bytes]) -> list[bytes]:
        """The ids of texts that are lower-cased."""
        joined = b"\n" + b"\n".join(raw) + b"\n" + bytes(Words.LONGEST)
        firsts = np.cumsum([1, *(len(r) + 1 for r in raw)])
        data = np.frombuffer(joined, np.uint8)[: firsts[-1]]
        space = data - np.uint8(9) < 5
        space |= data == 32
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        begin, end = edges[::2], edges[1::2]
        # up to eight marks of punctuation after a letter or digit are a word of their own
        marks = _TAIL.take(data.take(end - 1)).astype(np.int64)
        todo = np.flatnonzero(marks)
        for _ in range(7):
            todo = todo[_TAIL.take(data.take(end[todo] - 1 - marks[todo]))]
            marks[todo] += 1
        before = end - 1 - marks
        letter = data.take(before)
        cut = (marks > 0) & (_ALNUM.take(letter) | _SECOND.take(letter) & (data.take(before - 1) == 0xC3))
        marks[~cut] = 0
        at = np.repeat(np.arange(len(begin)), 1 + cut)
        tail = np.zeros(len(at), bool)
        tail[1:] = at[1:] == at[:-1]
        middle = (end - marks).take(at)
        begin, end = np.where(tail, middle, begin.take(at)), np.where(tail, end.take(at), middle)
        size = end - begin
        held = size <= Words.LONGEST
        if joined.find(b"\0", 0, firsts[-1]) >= 0:
            zeros = np.cumsum(data == 0)
            held &= zeros.take(end - 1) == zeros.take(begin - 1)
        keys = np.ndarray(len(joined) - 15, "V16", joined, strides=(1,))[begin].view("<u8").reshape(-1, 2)
        keys &= _KEYS.take(np.minimum(size, Words.LONGEST), axis=0)
        rows = self.words.find(keys)
        if len(new := np.flatnonzero((rows[:, 0] == 0) & held)):
            order = new[np.lexsort((keys[new, 0], keys[new, 1]))]
            asked = keys[order]
            differs = np.append(True, (asked[1:] != asked[:-1]).any(axis=1))
            made = self._rows(asked[differs])
            rows[order] = made[np.cumsum(differs) - 1]
            self.words.add(made)
        fields = rows.view("<u2")[:, 8:]
        short = fields[:, 7].astype(np.uint8) - np.uint8(1)
        held &= short <= Words.MOST_IDS
        short[~held] = 0
        ids = np.compress(_FIRST.take(short).view(bool), np.ascontiguousarray(fields).reshape(-1))
        counts = short.astype(np.int64)
        if len(other := np.flatnonzero(~held)):
            said = self._each([joined[a:b] for a, b in zip(begin[other].tolist(), end[other].tolist(), strict=True)])
            counts[other] = [len(x) // 2 for x in said]
            whole = np.empty(counts.sum(), "<u2")
            mine = np.repeat(held, counts)
            whole[mine], whole[~mine] = ids, np.frombuffer(b"".join(said), "<u2")
            ids = whole
        ends = np.append(0, np.cumsum(counts)).take(np.searchsorted(begin, firsts)) * 2
        out = ids.astype("<u2").tobytes()
        return [out[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer_of(path: str) -> WordTokenizer:
    """The worker's own tokenizer. A task's function must ask for it here, by name: a table that it names itself comes with it, pickled, and is empty in each task."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def write(docs: DataFrame, path: str, end: int, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """Encode and write ``docs`` in ascending order of id; returns the written ``(part, number, n_ids, ids, lengths, payload)``.

    Each document's ids are followed by ``end``. Null ids come first; rows of the same id are ordered by text. A null text is
    empty, a very long one is in one segment, and an empty table has none. Other columns are left aside. ``path`` is a tokenizer
    file that every executor has, of a kind that drops white space, with fewer than 65,536 ids.
    """
    kind = dict(docs.dtypes)[id_col]
    stop = np.array([end], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, tokenizer = TaskContext.get().partitionId(), 0, tokenizer_of(path)
        ids, lengths, parts, n = [], [], [], 0

        def closed(type_: pa.DataType) -> pa.RecordBatch:
            tokens = np.frombuffer(b"".join(parts), "<u2").astype(np.int32)
            cols = [pa.array([part]), pa.array([number]), pa.array([n]), pa.array([ids], pa.list_(type_)), pa.array([lengths], pa.list_(pa.int64())), pa.array([pack(tokens)], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["part", "number", "n_ids", "ids", "lengths", "payload"])

        type_ = None
        for batch in batches:
            type_ = batch.schema.field(0).type
            for k in range(0, batch.num_rows, 256):
                some = batch.slice(k, 256)
                for i, data in zip(some.column(0).to_pylist(), tokenizer(some.column(1).to_pylist()), strict=True):
                    ids.append(i)
                    parts += [data, stop]
                    lengths.append(len(data) // 2 + 1)
                    n += lengths[-1]
                    if n >= segment:
                        yield closed(type_)
                        ids, lengths, parts, n, number = [], [], [], 0, number + 1
        if ids:
            yield closed(type_)

    ordered = docs.select(id_col, text_col).repartitionByRange(id_col).sortWithinPartitions(id_col, text_col)
    return saved(ordered.mapInArrow(run, f"part long, number long, n_ids long, ids array<{kind}>, lengths array<long>, payload binary"))


def read(files: DataFrame, id_col: str = "doc_id", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Read segments back: ``id_col``, start, n_tokens, ids_crc32 for every document.

    Null and empty texts have their end id alone; repeated rows each have their place; a very long text makes a long segment, which is
    decoded as a whole; an empty table has no segments and gives no rows. Damage raises ValueError.
    """
    kind = next(f.dataType.elementType.simpleString() for f in files.schema if f.name == "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, ids, lengths, payload in zip(*(batch.column(c) for c in ("part", "number", "ids", "lengths", "payload")), strict=True):
                tokens, n = unpack(payload.as_py()), lengths.as_py()
                ends = np.cumsum(n)
                if (ends[-1] if n else 0) != len(tokens):
                    raise ValueError("a segment's lengths and ids differ")
                starts = ends - n
                crc = [zlib.crc32(tokens[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                cols = [pa.array([part.as_py()] * len(n)), pa.array([number.as_py()] * len(n)), ids.values, pa.array(starts, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["part", "number", id_col, "within", "n_tokens", "ids_crc32"])

    docs = files.select("part", "number", "ids", "lengths", "payload").mapInArrow(run, f"part long, number long, `{id_col}` {kind}, within long, n_tokens long, ids_crc32 long")
    # running sums in two steps: within each thousand written files, and over these thousands, of which the driver gets one row each
    sizes = files.select(F.expr("part div 1024").alias("group"), "part", "number", "n_ids")
    totals = sizes.groupBy("group").agg(F.sum("n_ids").alias("n")).orderBy("group").collect()
    at, firsts = 0, []
    for r in totals:
        firsts.append((r["group"], at))
        at += r["n"]
    first = files.sparkSession.createDataFrame(firsts, "group long, first long")
    inner = F.sum("n_ids").over(Window.partitionBy("group").orderBy("part", "number")) - F.col("n_ids")
    base = checkpoint(sizes.withColumn("inner", inner).join(first, "group").select("part", "number", (F.col("first") + F.col("inner")).alias("base")))
    small = base.limit(most_broadcast + 1).count() <= most_broadcast
    return docs.join(F.broadcast(base) if small else base, ["part", "number"]).select(id_col, (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
