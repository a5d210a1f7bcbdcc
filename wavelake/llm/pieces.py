"""Pre-tokens of whole batches of texts and their encoding by ranked merges, as array operations.

The cut of byte-level BPE needs no scan: whether a pre-token starts at a code point follows from the code points next to it (its
class, the class before, a blank before, the end of a run of white space, a contraction that starts there).  ``piece_starts`` marks
the starts of many texts at once.  Equal pieces of a batch are found by a hash and told apart by their bytes, so each distinct
piece is encoded once; pieces of up to MATRIX bytes are merged together, one merge of every piece a round, longer ones by a heap.
"""

from __future__ import annotations

import base64
import heapq
import json
from functools import lru_cache

import numpy as np

from . import common as C

LETTER, NUMBER, OTHER, SPACE, NONE = range(5)
#: Bytes of the longest piece that is merged as a row of a matrix.
MATRIX = 64
NEVER = np.int64(1) << 40


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point (letter, number, white space, other) as the libraries' regular expressions have it; Python's own
    may know another version of Unicode."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    singles = {bytes([b]): b for b in range(256)}
    # what the pattern does not match is left out, so the tokens are the bytes of what it matches
    found = lambda p: bytes(tiktoken.Encoding("c", pat_str=p, mergeable_ranks=singles, special_tokens={}).encode_ordinary(every)).decode()
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        out[code_points(found(pattern))] = kind
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def byte_places(cps: np.ndarray) -> np.ndarray:
    """Byte offset of each code point in UTF-8, and of the end."""
    out = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(1 + (cps >= 0x80).astype(np.int8) + (cps >= 0x800) + (cps >= 0x10000), out=out[1:])
    return out


def piece_starts(cps: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Which code points start a pre-token; ``begins`` has the first code point of each text."""
    n = len(cps)
    if not n:
        return np.zeros(0, bool)
    kind, first = classes()[cps], np.zeros(n, bool)
    first[begins[begins < n]] = True
    before = np.empty(n, np.uint8)
    before[0], before[1:] = NONE, kind[:-1]
    before[first] = NONE
    space, blank = kind == SPACE, cps == 32
    start = before != kind
    after_blank = np.zeros(n, bool)
    after_blank[1:] = blank[:-1]
    after_blank[first] = False
    start[after_blank & ~space] = False  # a blank belongs to what follows it
    last = space[:-1] & ~space[1:] & ~first[1:]  # the last of white space that something follows stands alone
    start[:-1] |= last
    # The contractions that are pre-tokens of their own.
    q = np.nonzero(start & (cps == ord("'")))[0]
    if q.size:
        wide, edge = np.append(cps, np.zeros(3, cps.dtype)), np.append(first, np.ones(3, bool))
        one, two = wide[q + 1], wide[q + 2]
        pair = lambda s: (one == ord(s[0])) & (two == ord(s[1]))
        short = np.isin(one, [ord(c) for c in "stmd"]) & ~edge[q + 1]
        long = (pair("re") | pair("ve") | pair("ll")) & ~edge[q + 1] & ~edge[q + 2]
        start[q[short | long] + 1] = False
        ends = np.concatenate([q[short] + 2, q[long] + 3])
        start[ends[ends < n]] = True
    return start


def blank_starts(cps: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Which code points start a unit: a run of blanks with what follows up to the next blank."""
    blank = cps == 32
    start = blank.copy()
    start[1:] &= ~blank[:-1]
    start[begins[begins < len(cps)]] = True
    return start


def distinct(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each distinct slice of ``buf`` (from ``common.padded``), and for each slice which of these it is."""
    h = C.word_hashes(buf, starts, ends)
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    w64 = np.ndarray((len(buf) - 7,), "<u8", buffer=buf, strides=(1,))
    n, at, like = ends - starts, starts, starts[first][which]
    same = n == n[first][which]
    for k in (0, 8):
        if (some := np.nonzero(n > k)[0]).size:
            mask = C._HEADS[np.minimum(n[some] - k, 8)]
            same[some] &= (w64[at[some] + k] & mask) == (w64[like[some] + k] & mask)
    for i in np.nonzero(same & (n > 16))[0]:
        same[i] = buf[at[i] : at[i] + n[i]].tobytes() == buf[like[i] : like[i] + n[i]].tobytes()
    if not same.all():  # two slices share a hash: tell them apart by their bytes
        seen: dict[bytes, int] = {}
        of = [seen.setdefault(buf[s:e].tobytes(), i) for i, (s, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True))]
        first, which = np.unique(of, return_inverse=True)
    return first, which


def spread(counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Indices of the runs [start, start + count), one after another."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) - np.repeat(ends - counts - starts, counts)


class RankedMerges:
    """Byte-level BPE by a table of pairs: ``codes`` (left << 32 | right, sorted), the rank of each and the token it makes."""

    def __init__(self, tokens: dict[bytes, int], pairs: dict[tuple[int, int], tuple[int, int]], whole: bool):
        self.whole = tokens if whole else None
        self.bytes_of = dict(zip(tokens.values(), tokens.keys(), strict=True))
        top = max(self.bytes_of) + 1
        self.size = np.zeros(top, np.int64)
        for i, raw in self.bytes_of.items():
            self.size[i] = len(raw)
        self.single = np.array([tokens[bytes([b])] for b in range(256)], np.int64)
        codes = np.array([a << 32 | b for a, b in pairs], np.int64)
        order = np.argsort(codes)
        made = np.array(list(pairs.values()), np.int64).reshape(-1, 2)
        self.codes, self.rank, self.made = codes[order], made[order, 0], made[order, 1]
        self.pairs = pairs

    def look(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank << 20 | token of each pair, NEVER where it is none."""
        code = a << 32 | b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.rank[at] << 20 | self.made[at], NEVER)

    def _heap(self, raw: bytes) -> list[int]:
        """One long piece: the least rank first, of equal ranks the left one."""
        sym = self.single[np.frombuffer(raw, np.uint8)].tolist()
        n, pairs = len(sym), self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [pairs[p][0] << 32 | i for i, p in enumerate(zip(sym, sym[1:], strict=False)) if p in pairs]
        heapq.heapify(heap)
        while heap:
            x = heapq.heappop(heap)
            rank, i = x >> 32, x & 0xFFFFFFFF
            j = after[i] if sym[i] >= 0 else n
            got = pairs.get((sym[i], sym[j])) if j < n else None
            if got is None or got[0] != rank:
                continue  # a neighbour has been merged meanwhile
            sym[i], sym[j] = got[1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if new := pairs.get((sym[i], sym[k])):
                    heapq.heappush(heap, new[0] << 32 | i)
            h = before[i]
            if h >= 0 and (new := pairs.get((sym[h], sym[i]))):
                heapq.heappush(heap, new[0] << 32 | h)
        return [s for s in sym if s >= 0]

    def _rows(self, sym: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces as rows of tokens: merged until no pair is in the table.  Gives the rows and their numbers of tokens."""
        wide = sym.shape[1]
        out, at = sym.copy(), np.arange(len(sym))
        left = size.copy()
        cols = np.arange(wide)
        rank = np.full(sym.shape, NEVER, np.int64)
        ok = cols[None, :-1] + 1 < size[:, None]
        rank[:, :-1][ok] = self.look(sym[:, :-1][ok], sym[:, 1:][ok])
        live = np.ones(len(sym), bool)
        while True:
            p = rank.argmin(axis=1)
            got = rank[np.arange(len(rank)), p]
            live = got < NEVER
            if not live.all():
                out[at[~live]] = sym[~live]
                sym, rank, at, p, got = sym[live], rank[live], at[live], p[live], got[live]
            if not len(at):
                return out, left
            row = np.arange(len(at))
            move = np.minimum(cols[None, :] + (cols[None, :] > p[:, None]), wide - 1)
            sym, rank = np.take_along_axis(sym, move, 1), np.take_along_axis(rank, move, 1)
            left[at] -= 1
            n = left[at]
            made = got & 0xFFFFF
            sym[row, p] = made
            rank[:, -1] = NEVER
            r = row[p > 0]
            rank[r, p[r] - 1] = self.look(sym[r, p[r] - 1], made[r])
            rank[row, p] = NEVER
            r = row[p + 1 < n]
            rank[r, p[r]] = self.look(made[r], sym[r, p[r] + 1])

    def encode(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All tokens of the slices, one slice after another, and the number of each."""
        n = ends - starts
        counts = np.zeros(len(n), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # slices and their tokens in that order
        rest = np.arange(len(n))
        if self.whole is not None:
            raw, get = buf.tobytes(), self.whole.get
            hit = np.array([get(raw[s:e], -1) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
            one = np.nonzero(hit >= 0)[0]
            counts[one] = 1
            parts.append((one, hit[one]))
            rest = np.nonzero(hit < 0)[0]
        edges = [0, 4, 8, 12, 16, 24, 32, MATRIX]
        for low, high in zip(edges, edges[1:], strict=False):
            some = rest[(n[rest] > low) & (n[rest] <= high)]
            if not some.size:
                continue
            size = n[some]
            sym = self.single[buf[np.minimum(starts[some, None] + np.arange(high), len(buf) - 1)]]
            got, left = self._rows(sym, size)
            counts[some] = left
            parts.append((some, got[np.arange(high) < left[:, None]]))
        for i in rest[n[rest] > MATRIX]:
            ids = self._heap(buf[starts[i] : ends[i]].tobytes())
            counts[i] = len(ids)
            parts.append((np.array([i]), np.array(ids, np.int64)))
        base = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), np.int64)
        for some, ids in parts:
            flat[spread(counts[some], base[some])] = ids
        return flat, counts

    def encode_all(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same, each distinct slice once."""
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first, which = distinct(buf, starts, ends)
        flat, counts = self.encode(buf, starts[first], ends[first])
        base = np.cumsum(counts) - counts
        return flat[spread(counts[which], base[which])], counts[which]


@lru_cache(maxsize=4)
def from_ranks(path: str) -> RankedMerges:
    """A file of ranks: a pair makes the token whose bytes are those of both; a piece that is a token is that token."""
    tokens = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb") if line.strip())}
    pairs = {}
    for raw, i in tokens.items():
        for k in range(1, len(raw)):
            a, b = tokens.get(raw[:k]), tokens.get(raw[k:])
            if a is not None and b is not None:
                pairs[a, b] = (i, i)
    return RankedMerges(tokens, pairs, True)


@lru_cache(maxsize=4)
def from_merges(path: str) -> RankedMerges:
    """A JSON vocabulary with its list of merges."""
    from .bpe import byte_letters

    letters, spec = byte_letters(), json.loads(open(path, encoding="utf-8").read())
    vocab = spec["model"]["vocab"]
    added = {t["content"] for t in spec["added_tokens"]}
    tokens = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in added}
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    return RankedMerges(tokens, {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}, False)
