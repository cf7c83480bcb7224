"""Byte-level BPE encoding and decoding without a regular expression.

Texts of a batch are one array of code points. A table gives each its class: letter, number, white space or other. Class, blank,
apostrophe and what follows make a symbol, and the rules that cut a text into pieces are a small automaton over symbols: each symbol is
a function from states to states. Functions compose associatively, so the state before every character comes from a scan: blocks of
symbols are composed side by side, a doubling scan over the blocks gives the state in which each begins, and a second walk through all
blocks at once marks where pieces begin. A text's first character is a function that forgets the state.

The slices of UTF-8 between these marks are looked up in a cache of pieces; a piece seen for the first time is merged pair by pair,
lowest rank first, then leftmost. Each token keeps its byte offset, so any run of tokens decodes to its bytes, and offsets map tokens to
the text.

The rules are those of ``public_tokenizers.PATTERN``: 's 't 're 've 'm 'll 'd, an optional blank before letters, numbers or other
characters, white space up to the last one before something else, other white space. Classes are read off the tokenizer library once
per worker, since Python's own tables are of an older Unicode version.

Texts longer than ``SLICE`` characters are cut before a blank that follows something other than white space, where a piece begins in any case; a
run of more characters without such a place stays whole. Null texts count as empty and give no tokens. Rows are encoded one by one, so
repeated rows and ids, null ids and empty tables need no rule; other columns are not read. No shuffle, no broadcast.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.llm.common import slices, small_arrow_batches

SLICE = 1 << 20
#: Bytes of pieces, and of what Python needs to keep them, in a worker's memory; beyond it they are forgotten.
CACHE_BYTES = 40 << 20
#: Bytes up to which new pieces are merged together, all those of some length at once; longer ones go one by one, by a heap.
SHORT = 48

LETTER, NUMBER, OTHER, SPACE = range(4)
#: Symbols: the first three classes; a blank, or other white space, right before something else; white space before white space or the end;
#: an apostrophe that begins a contraction of one or two letters; a symbol that changes nothing. As first of its text: plus FIRST.
LEAD, LONE, RUN, ONE_LETTER, TWO_LETTERS, NOTHING, FIRST = 3, 4, 5, 6, 7, 8, 9
#: States: what the piece that the last character belongs to is, or that it is complete.
CLOSED, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_LEAD, IN_RUN, ONE_TO_COME, TWO_TO_COME = range(8)
_BLOCK = 256


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a piece begins) by symbol * 8 + state."""
    goes, begins = np.zeros((2 * FIRST, 8), np.uint8), np.ones((2 * FIRST, 8), bool)
    joins = {LETTER: (IN_LETTERS, {IN_LETTERS, AFTER_LEAD}), NUMBER: (IN_NUMBERS, {IN_NUMBERS, AFTER_LEAD}), OTHER: (IN_OTHERS, {IN_OTHERS, AFTER_LEAD}), LEAD: (AFTER_LEAD, set()), LONE: (CLOSED, set()), RUN: (IN_RUN, {IN_RUN})}
    for state in range(8):
        for symbol, (to, continued) in joins.items():
            goes[symbol, state], begins[symbol, state] = to, state not in continued
        for symbol, rest in ((ONE_LETTER, ONE_TO_COME), (TWO_LETTERS, TWO_TO_COME)):
            inside = state in (IN_OTHERS, AFTER_LEAD)  # then it is one more character of the piece
            goes[symbol, state], begins[symbol, state] = IN_OTHERS if inside else rest, not inside
        if state in (ONE_TO_COME, TWO_TO_COME):  # a contraction takes what it began with
            goes[:NOTHING, state], begins[:NOTHING, state] = CLOSED if state == ONE_TO_COME else ONE_TO_COME, False
        goes[NOTHING, state], begins[NOTHING, state] = state, False
    goes[FIRST:], begins[FIRST:] = goes[:FIRST, CLOSED, None], True
    return goes.ravel(), begins.ravel()


_GOES, _BEGINS = _automaton()


@functools.cache
def _classes() -> np.ndarray:
    """The class of each code point, as the tokenizer library has it."""
    import tiktoken

    ranks = {bytes([i]): i for i in range(256)}
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, what in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        is_of = tiktoken.Encoding("class", pat_str=what, mergeable_ranks=ranks, special_tokens={})
        out[_code_points(is_of.decode(is_of.encode_ordinary(every)))] = kind
    return out


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _symbols(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The symbol of each character; first: where texts begin, all of one character at least."""
    kind = _classes()[points]
    last = np.append(first[1:], len(points)) - 1
    before_other = np.append(kind[1:] != SPACE, False)
    before_other[last] = False
    out = np.where(kind != SPACE, kind, np.where(before_other, np.where(points == 0x20, np.uint8(LEAD), np.uint8(LONE)), np.uint8(RUN)))
    at = np.flatnonzero(points == 0x27)
    left = last[np.searchsorted(first, at, "right") - 1] - at
    padded = np.append(points, [0, 0])
    one, two = padded[at + 1], padded[at + 2]
    is_ = lambda x, letters: np.isin(x, [ord(c) for c in letters])
    out[at[(left >= 2) & ((is_(one, "rv") & is_(two, "e")) | (is_(one, "l") & is_(two, "l")))]] = TWO_LETTERS
    out[at[(left >= 1) & is_(one, "stmd")]] = ONE_LETTER
    out[first] += FIRST
    return out


def piece_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pieces begin, among the characters of texts that begin at first."""
    n = len(points)
    width = min(_BLOCK, int(n**0.5) + 1)
    blocks = -(-n // width)
    symbols = np.full(blocks * width, NOTHING, np.uint8)
    symbols[:n] = _symbols(points, first)
    columns = np.ascontiguousarray(symbols.reshape(blocks, width).T).astype(np.intp) * 8
    whole = np.tile(np.arange(8, dtype=np.uint8), (blocks, 1))
    for column in columns:  # each block's function, from any state
        whole = _GOES[column[:, None] + whole]
    step = 1
    while step < blocks:  # and those of all blocks up to it
        whole = np.concatenate([whole[:step], np.take_along_axis(whole[step:], whole[:-step], 1)])
        step *= 2
    state = np.append(np.uint8(CLOSED), whole[:-1, CLOSED])
    begins = np.empty((blocks, width), bool)
    for i, column in enumerate(columns):
        column = column + state
        begins[:, i] = _BEGINS[column]
        state = _GOES[column]
    return np.flatnonzero(begins.ravel()[:n])


def cut(text: str, limit: int = SLICE) -> Iterator[str]:
    """text in parts of some limit characters; each part begins where a piece does."""
    begin, at = 0, limit
    while 0 <= (at := text.find(" ", at)):
        if text[at - 1].isspace():
            at += 1
            continue
        yield text[begin:at]
        begin, at = at, at + limit
    yield text[begin:]


@dataclass(frozen=True)
class Encoded:
    """The tokens of a text, or of a part of one, and the byte at which each begins; offsets has one more, the end."""

    ids: np.ndarray
    offsets: np.ndarray


class Codec:
    """Encodes and decodes by a file of ranks."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        with open(path, "rb") as f:  # part of the installation, on every machine
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.sizes = np.zeros(max(self.tokens) + 1, np.int64)
        self.sizes[list(self.tokens)] = list(map(len, self.tokens.values()))
        self.known: dict[bytes, int] = {}
        self.cache_bytes = cache_bytes
        self._forget()
        made = [((self.ranks[t[:i]] << 32) + self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        made.sort()
        self.pairs, self.made = np.array(made, np.int64).reshape(-1, 2).T.copy()  # two tokens that make a token, and which
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)

    def _forget(self) -> None:
        self.known.clear()
        self.held = 0
        self.first, self.count, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def _joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token, which is its rank too, that each two tokens make, or one beyond all."""
        keys = (left << 32) + right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where((right >= 0) & (self.pairs[at] == keys), self.made[at], len(self.sizes))

    def _merge_together(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all pieces, how many each has), for pieces of 2 to width bytes that aren't tokens themselves."""
        n = len(pieces)
        count = np.fromiter(map(len, pieces), np.int64, n)
        parts = np.full((n, width + 1), -1, np.int64)
        column = np.arange(width + 1)
        parts[column < count[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        joins = self._joined(parts[:, :-1], parts[:, 1:])
        rows = np.arange(n)
        while len(rows):  # the rows whose pieces still have a pair to merge
            mine = joins[rows]
            at = mine.argmin(1)
            token = mine[np.arange(len(rows)), at]
            rows, at, token = (x[token < len(self.sizes)] for x in (rows, at, token))
            later = column[:-1] > at[:, None]  # what stands after the pair moves one to the left
            of = parts[rows]
            of[:, :-1][later] = of[:, 1:][later]
            of[:, -1] = -1
            mine = joins[rows]
            mine[:, :-1][later[:, :-1]] = mine[:, 1:][later[:, :-1]]
            mine[:, -1] = len(self.sizes)
            here = np.arange(len(rows))
            of[here, at] = token
            mine[here, at] = self._joined(token, of[here, at + 1])
            before = np.flatnonzero(at)
            mine[before, at[before] - 1] = self._joined(of[before, at[before] - 1], token[before])
            parts[rows], joins[rows] = of, mine
            count[rows] -= 1
        return parts[parts >= 0], count

    def _merge_alone(self, piece: bytes) -> list[int]:
        edges = self._edges_by_heap(piece)
        return [self.ranks[piece[a:b]] for a, b in zip(edges, edges[1:])]

    def _learn(self, pieces: Iterable[bytes]) -> None:
        """Give each of these new pieces a number, and that number its tokens."""
        by_width: dict[int, list[bytes]] = {}
        for p in pieces:
            by_width.setdefault(0 if p in self.ranks else next((w for w in (8, 12, 20, SHORT) if len(p) <= w), -1), []).append(p)
        for width, some in by_width.items():
            if width > 0:
                tokens, count = self._merge_together(some, width)
            else:
                each = [[self.ranks[p]] if width == 0 else self._merge_alone(p) for p in some]
                tokens, count = np.fromiter(chain.from_iterable(each), np.int64), np.fromiter(map(len, each), np.int64, len(each))
            begin = len(self.flat)
            self.known.update(zip(some, range(len(self.first), len(self.first) + len(some))))
            self.first = np.append(self.first, begin + np.cumsum(count) - count)
            self.count, self.flat = np.append(self.count, count), np.append(self.flat, tokens)
            self.held += 200 * len(some) + sum(map(len, some)) + 8 * len(tokens)

    def _ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all pieces, how many each has)."""
        if self.held > self.cache_bytes:
            self._forget()
        numbers = list(map(self.known.get, pieces))
        if None in numbers:
            self._learn({p for p, k in zip(pieces, numbers) if k is None})
            numbers = list(map(self.known.__getitem__, pieces))
        of = np.array(numbers, np.int64)
        count = self.count[of]
        begin = self.first[of] - (np.cumsum(count) - count)
        return self.flat[np.repeat(begin, count) + np.arange(int(count.sum()))], count

    def _edges_by_heap(self, piece: bytes) -> list[int]:
        """Where the tokens of a piece begin, and its end. The heap has the pairs that are tokens; ends[i] is where the part that begins at i ends, 0 once it is merged."""
        rank, n = self.ranks.get, len(piece)
        ends, begins = list(range(1, n + 1)), list(range(-1, n))
        heap = [(r, i) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            middle = ends[i]
            if not 0 < middle < n or rank(piece[i : (end := ends[middle])]) != r:  # one of its parts has become another
                continue
            ends[i], ends[middle], begins[end] = end, 0, i
            if end < n and (r := rank(piece[i : ends[end]])) is not None:
                heapq.heappush(heap, (r, i))
            if i and (r := rank(piece[begins[i] : end])) is not None:
                heapq.heappush(heap, (r, begins[i]))
        return [i for i, end in enumerate(ends) if end] + [n]

    def _encode(self, texts: list[str]) -> list[Encoded]:
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.cumsum(lengths) - lengths
        joined = "".join(texts)
        if not joined:
            return [Encoded(np.empty(0, np.int64), np.zeros(1, np.int64))] * len(texts)
        points, data = _code_points(joined), joined.encode()
        starts = piece_starts(points, first[lengths > 0])
        place = np.arange(len(points) + 1)
        if len(data) > len(points):
            place[1:] = np.cumsum(1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF))
        edges = place[np.append(starts, len(points))].tolist()
        ids, counts = self._ids([data[a:b] for a, b in zip(edges, edges[1:])])
        token_of_piece = np.append(0, np.cumsum(counts))
        at = token_of_piece[np.searchsorted(starts, np.append(first, len(points)))].tolist()
        ends = np.append(0, np.cumsum(self.sizes[ids]))
        return [Encoded(ids[a:b], ends[a : b + 1] - ends[a]) for a, b in zip(at, at[1:])]

    def encode(self, texts: Sequence[str]) -> Iterator[tuple[int, Encoded]]:
        """(number of the text, tokens) of its parts in order, for each text in order; a text is one part unless it is very long."""
        parts = [(i, part) for i, text in enumerate(texts) for part in cut(text)]
        for a, b in slices([len(part) for _, part in parts], SLICE):
            yield from zip([i for i, _ in parts[a:b]], self._encode([part for _, part in parts[a:b]]))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@functools.cache
def codec(path: str) -> Codec:
    """One for each worker."""
    return Codec(path)


def round_trip(documents: DataFrame, ranks: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 of the ids in decimal with commas between, decoded_sha256 of the bytes that these ids decode to."""
    small_arrow_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(ranks)
        for batch in batches:
            texts = [text or "" for text in batch.column(1).to_pylist()]
            sums = [(hashlib.sha256(), hashlib.sha256()) for _ in texts]
            n = [0] * len(texts)
            for i, part in bpe.encode(texts):
                of_ids, of_bytes = sums[i]
                of_ids.update(("," * bool(n[i] and len(part.ids)) + ",".join(map(str, part.ids.tolist()))).encode())
                of_bytes.update(bpe.decode(part.ids))
                n[i] += len(part.ids)
            digests = [pa.array([s[k].hexdigest() for s in sums], pa.string()) for k in (0, 1)]
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), *digests], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
