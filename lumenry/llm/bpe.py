"""Byte-level BPE encoding and decoding.

Texts are cut without a regular expression. Each character gets a class from an array over code points and its
neighbours; the cutting automaton is then a transition function for each class. Functions compose associatively, so
blocks of characters are composed side by side, the blocks' entry states follow from a scan over the compositions,
and a second walk marks every boundary. The slices feed cached pair merging. Each token keeps its byte offset in the
text, and decoding lays every token's bytes at its offset.

The automaton follows this pattern: contractions after an apostrophe; an optional space and a run of letters, of
numbers, or of other signs; runs of white space, whose last character is left to what follows.

Defined results: a null or empty text has no ids; repeated rows are encoded each on its own; extra columns are
ignored; an empty table gives an empty result; slices of any length are merged whole, in n log n.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts, rows_of

SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
REMEMBERED = 400_000
DECODED = 65536
BLOCK = 64

# Classes of characters, by themselves and by what follows.
LETTER, NUMBER, OTHER, LAST_SPACE, LAST_BLANK, BLANK, TAKE_1, TAKE_2, END = range(9)
# States: what the slice so far is. DONE: the next character begins a slice, whatever it is.
DONE, IN_SPACE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_BLANKS, LEFT_1, LEFT_2 = range(8)


def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """next[class, state], and begins[class, state]: whether a slice begins at the character."""
    step, begin = np.zeros((9, 8), np.int8), np.zeros((9, 8), bool)
    run = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS}
    for state in range(8):
        for c in range(9):
            if state in (LEFT_1, LEFT_2):  # inside a contraction: its letters are taken as they are
                step[c, state], begin[c, state] = (DONE if state == LEFT_1 else LEFT_1), False
            elif c in run:
                step[c, state], begin[c, state] = run[c], state not in (IN_SPACE, run[c])
            elif c in (TAKE_1, TAKE_2):  # an apostrophe before a suffix: a contraction, unless a slice takes it in
                inside = state in (IN_SPACE, IN_OTHERS)
                step[c, state], begin[c, state] = (IN_OTHERS if inside else LEFT_1 if c == TAKE_1 else LEFT_2), not inside
            elif c == BLANK:  # white space before more of it, or at the end
                step[c, state], begin[c, state] = IN_BLANKS, state != IN_BLANKS
            elif c == LAST_SPACE:  # a space before something else goes to what follows
                step[c, state], begin[c, state] = IN_SPACE, True
            else:  # LAST_BLANK: another white space before something else stands alone; END: a new text
                step[c, state], begin[c, state] = DONE, True
    return step, begin


STEP, BEGIN = _transitions()


@lru_cache(maxsize=1)
def _plain_classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or BLANK of each code point, as the pattern's library has them."""
    import regex

    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        for m in regex.finditer(pattern, every):
            at = np.frombuffer(m[0].encode("utf-32-le"), np.uint32)
            out[at] = kind
    return out


def classes(codes: np.ndarray) -> np.ndarray:
    """codes: texts, each followed by one zero, whose places `ends` are known by value beyond all characters."""
    table = _plain_classes()
    end = codes == 0xFFFFFFFF
    kinds = table[np.where(end, 0, codes)]
    kinds[end] = END
    after = np.append(kinds[1:], END)
    last = (kinds == BLANK) & (after != BLANK) & (after != END)
    kinds[last & (codes == 32)] = LAST_SPACE
    kinds[last & (codes != 32)] = LAST_BLANK
    quote = np.flatnonzero(codes == 39)
    if len(quote):
        wide = np.append(codes, np.zeros(2, codes.dtype))
        one, two = wide[quote + 1], wide[quote + 2]
        kinds[quote[np.isin(one, [ord(c) for c in "stmd"])]] = TAKE_1
        pair = np.zeros(len(quote), bool)
        for a, b in ("re", "ve", "ll"):
            pair |= (one == ord(a)) & (two == ord(b))
        kinds[quote[pair]] = TAKE_2
    return kinds


def scan(kinds: np.ndarray) -> np.ndarray:
    """The state before each character, by composing transition functions over blocks, then over blocks of blocks."""
    n = len(kinds)
    width = -(-n // BLOCK)
    padded = np.full(width * BLOCK, END, np.uint8)
    padded[:n] = kinds
    grid = np.ascontiguousarray(padded.reshape(width, BLOCK).T)
    # composed[k, s]: the state after block k when it is entered in state s
    composed = np.broadcast_to(np.arange(8, dtype=np.int8), (width, 8)).copy()
    flat = STEP.ravel()
    for row in grid:
        composed = flat[(row[:, None].astype(np.int16) << 3) + composed]
    # inclusive scan of the blocks' functions by doubling
    total, step = composed, 1
    while step < width:
        grown = total.copy()
        grown[step:] = np.take_along_axis(total[step:], total[:-step].astype(np.int64), 1)
        total, step = grown, step * 2
    state = np.concatenate(([DONE], total[:-1, DONE])).astype(np.int8)
    out = np.empty((BLOCK, width), np.int8)
    for j, row in enumerate(grid):
        out[j] = state
        state = flat[(row.astype(np.int16) << 3) + state]
    return out.T.reshape(-1)[:n]


def boundaries(texts: list[str]) -> list[np.ndarray]:
    """Starts of the slices of each text, in code points."""
    if not texts:
        return []
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer(b"\xff\xff\xff\xff".join(t.encode("utf-32-le") for t in texts) + b"\xff\xff\xff\xff", np.uint32)
    kinds = classes(codes)
    begins = np.flatnonzero(BEGIN.ravel()[(kinds.astype(np.int16) << 3) + scan(kinds)])
    firsts = np.concatenate(([0], np.cumsum(sizes + 1)))
    cut = np.searchsorted(begins, firsts)
    # each text's end mark begins a slice too: the last one found, which isn't one of the text
    return [begins[a : b - 1] - first for a, b, first in zip(cut, cut[1:], firsts, strict=False)]


def slices(text: str, starts: np.ndarray) -> list[str]:
    at = starts.tolist()
    return [text[a:b] for a, b in zip(at, [*at[1:], len(text)], strict=True)] if at else []


class Ranks:
    """A rank file: one base64 string and its rank a line."""

    def __init__(self, path: str):
        lines = (line.split() for line in open(path, "rb"))
        self.rank = {base64.b64decode(a): int(b) for a, b in lines}
        self.bytes_of = {b: a for a, b in self.rank.items()}
        self.text_of = {i: str(i) for i in self.bytes_of}
        strings = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of, default=-1) + 1)]
        #: All vocabulary bytes, and by id where each string begins there and its length.
        self.flat = np.frombuffer(b"".join(strings), np.uint8)
        self.size = np.array([len(x) for x in strings], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.known: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one slice: the pair of lowest rank is merged first, the leftmost of equals."""
        rank = self.rank
        if (whole := rank.get(piece)) is not None:
            return (whole,)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        if len(parts) > 48:
            return self._merge_long(parts)
        ranks = [rank.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (least := min(ranks)) < 1 << 60:
            i = ranks.index(least)
            parts[i : i + 2] = [joined := parts[i] + parts[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank.get(joined + parts[i + 1], 1 << 60)
            if i:
                ranks[i - 1] = rank.get(parts[i - 1] + joined, 1 << 60)
        return tuple(map(rank.__getitem__, parts))

    def _merge_long(self, parts: list) -> tuple[int, ...]:
        n, rank = len(parts), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] is not a or j >= n or parts[j] is not b:
                continue
            parts[i], parts[j] = a + b, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(parts[i] + parts[k])) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[k]))
            if (k := before[i]) >= 0 and (r := rank.get(parts[k] + parts[i])) is not None:
                heapq.heappush(heap, (r, k, parts[k], parts[i]))
        return tuple(rank[p] for p in parts if p is not None)

    def encode(self, texts: list[str]) -> list[list[int]]:
        if len(self.known) > REMEMBERED:
            self.known = {}
        known, out = self.known, []
        for text, starts in zip(texts, boundaries(texts), strict=True):
            cut = slices(text, starts)
            for s in set(cut).difference(known):
                known[s] = self.merge(s.encode())
            out.append(list(chain.from_iterable(map(known.__getitem__, cut))))
        return out

    def offsets(self, ids: list[int]) -> np.ndarray:
        """Where each token begins in its text, in bytes: tokens lie side by side."""
        size = self.size[np.array(ids, np.int64)]
        return np.cumsum(size) - size

    def decode(self, ids: list[int], offsets: np.ndarray) -> bytes:
        """The bytes of tokens, each laid at its offset; what no token covers is zero."""
        at = np.array(ids, np.int64)
        size, offsets = self.size[at], np.asarray(offsets, np.int64)
        out = np.zeros(int((offsets + size).max(initial=0)), np.uint8)
        for i in range(0, len(at), DECODED):
            part = slice(i, i + DECODED)
            out[rows_of(offsets[part], size[part])] = self.flat[rows_of(self.begin[at[part]], size[part])]
        return out.tobytes()


@lru_cache(maxsize=2)
def ranks(path: str) -> Ranks:
    return Ranks(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and the byte offset of each id's token for each row of docs(doc_id, text). path is one that executors
    can open. Narrow: no shuffle."""

    def fn(piece):
        r = ranks(path)
        ids = r.encode([t or "" for t in piece["text"]])
        return {"doc_id": piece["doc_id"], "ids": ids, "offsets": [r.offsets(x) for x in ids]}

    return map_texts(docs, fn, "doc_id bigint, ids array<int>, offsets array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the bytes that the rows of encoded(doc_id, ids, offsets) stand for. Narrow: no shuffle."""
    import pyarrow as pa

    def run(rows):
        r = ranks(path)
        for batch in rows:
            found = [None if x is None else r.decode(x, o) for x, o in zip(batch.column("ids").to_pylist(), batch.column("offsets").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids", "offsets").mapInArrow(run, "doc_id bigint, bytes binary")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Counts and digests of each text's ids and of the bytes that they decode to by their offsets. Narrow: no shuffle."""

    def fn(piece):
        r = ranks(path)
        found = r.encode([t or "" for t in piece["text"]])
        return {
            "doc_id": piece["doc_id"], "n_tokens": [len(x) for x in found],
            "ids_sha256": [hashlib.sha256(",".join(map(r.text_of.__getitem__, x)).encode()).hexdigest() for x in found],
            "decoded_sha256": [hashlib.sha256(r.decode(x, r.offsets(x))).hexdigest() for x in found],
        }

    return map_texts(docs, fn, SCHEMA)
