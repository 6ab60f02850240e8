"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding by offsets.

Pre-tokens are found without a regular expression.  Each code point gets a
symbol from class arrays (letter, number, space, other white space, other, and
apostrophes that open a contraction).  A small automaton reads the symbols; a
symbol is a function on its states, functions compose associatively, and the
closure of these functions is small.  So the states at all positions come from
a scan over blocks: compose each block, run over the blocks, then enter all
blocks at once.

Defined cases: a null text counts as empty (no ids); long runs without a
boundary are merged with a heap; repeated rows give equal results; null
doc_ids stay null.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from palimpsest.llm.common import arrow_batches, filesystem, slices, texts_of

# Symbols of the automaton.
LETTER, NUMBER, OTHER, JOINED, SPACE, LAST, INNER, SHORT, LONG, BREAK = range(10)
# States: what the piece just read is, and what is left of a contraction.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_JOIN, IN_SPACES, ONE_LEFT, TWO_LEFT = range(8)

#: White space as \s has it.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# Classes of single code points, before their neighbours count.
_L, _N, _W, _O, _END = range(5)


@cache
def classes() -> np.ndarray:
    """Class of each code point; the one after the last stands for the end of a text."""
    table = np.full(0x110001, _O, np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        if kind == "L":
            table[code] = _L
        elif kind == "N":
            table[code] = _N
    table[WHITE] = _W
    table[0x110000] = _END
    return table


def symbols(codes: np.ndarray) -> np.ndarray:
    """Symbols of code points; texts are closed by code 0x110000.

    JOINED is a plain space before something that is not white space; LAST any
    other white space before such; SPACE and INNER is white space before white
    space or the end.  SHORT and LONG are apostrophes before s, t, m, d and
    before re, ve, ll.
    """
    kind = classes()[codes]
    out = np.array([LETTER, NUMBER, INNER, OTHER, BREAK], np.uint8)[kind]
    after = np.append(kind[1:], np.uint8(_END))
    solid = (kind == _W) & (after != _W) & (after != _END)
    out[solid] = LAST
    out[solid & (codes == 32)] = JOINED
    quotes = np.flatnonzero(codes == 39)
    if len(quotes):
        padded = np.append(codes, (0x110000, 0x110000))
        one, two = padded[quotes + 1], padded[quotes + 2]
        out[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        out[quotes[pair]] = LONG
    return out


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether a piece begins at this symbol."""
    if symbol == BREAK:
        return FRESH, True
    if state == TWO_LEFT:
        return ONE_LEFT, False
    if state == ONE_LEFT:
        return FRESH, False
    joins = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS}
    if symbol in joins:
        return joins[symbol], state not in (joins[symbol], AFTER_JOIN)
    if symbol in (SHORT, LONG):
        if state in (IN_OTHERS, AFTER_JOIN):  # no piece begins here, so it is no contraction
            return IN_OTHERS, False
        return (ONE_LEFT if symbol == SHORT else TWO_LEFT), True
    if symbol == JOINED:
        return AFTER_JOIN, True
    if symbol == LAST:
        return FRESH, True  # what follows begins a piece of its own
    return IN_SPACES, state != IN_SPACES


@cache
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Element of each symbol, composition of elements, their effect on states, and piece starts by (state, symbol)."""
    effect = [tuple(_step(s, x)[0] for s in range(8)) for x in range(10)]
    known = {tuple(range(8)): 0}
    for f in effect:
        known.setdefault(f, len(known))
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in effect:
            h = tuple(g[s] for s in f)
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    functions = list(known)
    compose = np.zeros((len(functions), len(functions)), np.uint16)
    for i, f in enumerate(functions):
        for j, g in enumerate(functions):
            compose[i, j] = known[tuple(g[s] for s in f)]
    starts = np.array([[_step(s, x)[1] for x in range(10)] for s in range(8)])
    return np.array([known[f] for f in effect], np.uint16), compose, np.array(functions, np.uint8), starts


def piece_starts(symbol: np.ndarray, block: int = 128) -> np.ndarray:
    """Whether a piece begins at each position: a scan of the automaton's functions."""
    element, compose, effect, starts = automaton()
    n = len(symbol)
    rows = -(-n // block)
    grid = np.full(rows * block, BREAK, np.uint8)
    grid[:n] = symbol
    grid = grid.reshape(rows, block)
    total = element[grid[:, 0]]
    for k in range(1, block):
        total = compose[total, element[grid[:, k]]]
    # scan over the blocks, doubling the reach each time
    reach, before = 1, total.copy()
    while reach < rows:
        before[reach:] = compose[before[:-reach].copy(), before[reach:]]
        reach *= 2
    state = np.full(rows, FRESH, np.uint8)
    state[1:] = effect[before[:-1], FRESH]
    step = effect[element]  # symbol x state
    out = np.empty((rows, block), bool)
    for k in range(block):
        column = grid[:, k]
        out[:, k] = starts[state, column]
        state = step[column, state]
    return out.reshape(-1)[:n]


def pieces(texts: list[str]) -> list[list[str]]:
    """Pre-tokens of each text."""
    joined = "".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    lengths = np.array([len(t) for t in texts])
    ends = np.cumsum(lengths)
    with_ends = np.full(len(codes) + len(texts), 0x110000, np.uint32)
    place = np.ones(len(with_ends), bool)
    place[ends + np.arange(len(texts))] = False
    with_ends[place] = codes
    begin = np.flatnonzero(piece_starts(symbols(with_ends))[place])
    cut = np.searchsorted(begin, np.append(0, ends)).tolist()
    first = begin.tolist()
    out = []
    for k, end in enumerate(ends.tolist()):
        own = first[cut[k] : cut[k + 1]]
        out.append([joined[a:b] for a, b in zip(own, own[1:] + [end])])
    return out


class Merger(dict):
    """Ids of a pre-token by its ranks: the adjacent pair with the lowest rank merges first, leftmost of equals."""

    KEPT = 200_000
    LONGEST = 48

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks
        size = max(ranks.values()) + 1
        words: list[bytes] = [b""] * size
        for word, rank in ranks.items():
            words[rank] = word
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.bytes = np.frombuffer(b"".join(words), np.uint8)

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.merge(piece.encode("utf-8", "surrogatepass"))
        if len(piece) <= self.LONGEST:
            self[piece] = ids
        return ids

    def merge(self, word: bytes) -> tuple[int, ...]:
        ranks = self.ranks
        if (whole := ranks.get(word)) is not None:
            return (whole,)
        if len(word) > 100:
            return self._merge_long(word)
        cut = list(range(len(word) + 1))
        pairs = [ranks.get(word[k : k + 2], 1 << 30) for k in range(len(word) - 1)]
        while pairs and (least := min(pairs)) < 1 << 30:
            k = pairs.index(least)
            del cut[k + 1], pairs[k]
            if k < len(pairs):
                pairs[k] = ranks.get(word[cut[k] : cut[k + 2]], 1 << 30)
            if k:
                pairs[k - 1] = ranks.get(word[cut[k - 1] : cut[k + 1]], 1 << 30)
        return tuple(ranks[word[a:b]] for a, b in zip(cut, cut[1:]))

    def _merge_long(self, word: bytes) -> tuple[int, ...]:
        """The same with a heap and a linked list."""
        n, ranks = len(word), self.ranks
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, k) for k in range(n - 1) if (r := ranks.get(word[k : k + 2])) is not None]
        heapq.heapify(heap)

        def rank_at(k: int) -> int | None:
            middle = right[k]
            return ranks.get(word[k : right[middle]]) if middle < n else None

        while heap:
            rank, k = heapq.heappop(heap)
            if not alive[k] or rank_at(k) != rank:
                continue
            gone = right[k]
            alive[gone] = False
            right[k] = right[gone]
            if right[k] < n:
                left[right[k]] = k
            for at in (k, left[k]):
                if at >= 0 and (r := rank_at(at)) is not None:
                    heapq.heappush(heap, (r, at))
        out, k = [], 0
        while k < n:
            out.append(ranks[word[k : right[k]]])
            k = right[k]
        return tuple(out)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self) > self.KEPT:
            self.clear()
        found = self.__getitem__
        return [np.fromiter(chain.from_iterable(map(found, p)), "<u4") for p in pieces([t or "" for t in texts])]

    def token_offsets(self, ids: np.ndarray) -> np.ndarray:
        """Where the bytes of each token begin, and where the last ends."""
        return np.concatenate(([0], np.cumsum(self.lengths[ids])))

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        """Bytes of the tokens, gathered from one table by the offsets."""
        shift = np.repeat(self.offsets[ids] - offsets[:-1], np.diff(offsets))
        return self.bytes[shift + np.arange(len(shift))].tobytes()


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of base64 words and numbers."""
    system, place = filesystem(path)
    with system.open_input_stream(place) as source:
        lines = source.read().splitlines()
    return {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in lines if line)}


@cache
def merger(path: str) -> Merger:
    """One merger in each Python process."""
    return Merger(read_ranks(path))


def bpe_round_trip(df: DataFrame, path: str, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts and decode the ids: doc_id, n_tokens, ids_sha256, decoded_sha256; with ids and byte offsets if asked for."""
    arrow_batches(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = merger(path)
        for batch in slices(batches, "text", 2_000_000):
            rows = []
            for ids in merge.encode(batch.column("text").to_pylist()):
                offsets = merge.token_offsets(ids)
                raw = ids.tobytes()
                rows.append((len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(merge.decode(ids, offsets)).hexdigest(), raw, offsets))
            out = [batch.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows])]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                out += [pa.array([r[3] for r in rows], pa.binary()), pa.array([r[4].tolist() for r in rows], pa.list_(pa.int64()))]
                names += ["ids", "byte_offsets"]
            yield pa.RecordBatch.from_arrays(out, names)

    return texts_of(df, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, byte_offsets array<long>" * with_ids)
