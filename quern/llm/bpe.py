"""Byte-level BPE encoding and decoding with a public rank file.

Pre-tokens are located without a regular expression. Code points become classes (letter, number, white space, other);
each class, with what the next characters say of contractions, stands for a transition function on the scanner's
states, and composing these functions is associative. A function that doesn't depend on the state settles all that
follows it, so only an apostrophe that may open a contraction and the letters after it need composing: a doubling scan
over those few places ends after log2 of their longest run. The slices between boundaries go to a pair merger behind a
bounded cache.
"""

from __future__ import annotations

import base64
import hashlib
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import id_text, map_batches, small_batches, texts

#: Classes of code points. SPACE is U+0020 alone; APOS is the apostrophe, otherwise an OTHER.
OTHER, LETTER, NUMBER, WHITE, SPACE, APOS = range(6)
#: States after a character: in a run of letters, numbers, others; after white space; after a space that the next token
#: takes in; a contraction with one or two letters to come; a contraction that has just ended.
S_LETTER, S_NUMBER, S_OTHER, S_WHITE, S_JOIN, S_ONE, S_TWO, S_END = range(8)
#: Entries of one generation of the cache of merged pre-tokens; two generations are kept.
CACHE = 300_000


@cache
def classes() -> np.ndarray:
    """The class of every code point."""
    import regex

    every = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x110000)))
    points = np.r_[0:0xD800, 0xE000:0x110000]
    out = np.zeros(0x110000, np.uint8)
    for pattern, code in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\p{White_Space}", WHITE)):
        out[points[[m.start() for m in regex.finditer(pattern, every)]]] = code
    out[ord(" ")], out[ord("'")] = SPACE, APOS
    return out


@cache
def _functions() -> np.ndarray:
    """Transition functions, a row each: of the classes, then of an apostrophe before one or two contraction letters, then of a letter that may be in a contraction."""
    def constant(s):
        return [s] * 8
    rows = {OTHER: constant(S_OTHER), LETTER: constant(S_LETTER), NUMBER: constant(S_NUMBER), WHITE: constant(S_WHITE), SPACE: constant(S_JOIN), APOS: constant(S_OTHER)}
    for code, to in ((6, S_ONE), (7, S_TWO)):
        rows[code] = constant(to)
        rows[code][S_OTHER] = rows[code][S_JOIN] = S_OTHER
    rows[8] = constant(S_LETTER)
    rows[8][S_TWO], rows[8][S_ONE] = S_ONE, S_END
    return np.array([rows[i] for i in range(9)], np.uint8)


def boundaries(text: str) -> np.ndarray:
    """Starts of the pre-tokens of a text, and its length; offsets in code points."""
    if not text:
        return np.zeros(1, np.int64)
    return _boundaries(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))


def _boundaries(points: np.ndarray) -> np.ndarray:
    n, kind = len(points), classes()[points]
    state = _functions()[:6, 0][kind]  # where no contraction may be, the class alone says it
    apos = np.flatnonzero(kind[:-1] == APOS)
    if len(apos):
        near = np.pad(points, (0, 2))
        a, b = near[apos + 1], near[apos + 2]
        one = (a == ord("s")) | (a == ord("t")) | (a == ord("m")) | (a == ord("d"))
        two = (a == ord("r")) & (b == ord("e")) | (a == ord("v")) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        apos, one, two = (x[one | two] for x in (apos, one, two))
    if len(apos):
        symbol = kind.copy()
        symbol[apos[one]], symbol[apos[two]] = 6, 7
        symbol[np.r_[apos + 1, apos[two] + 2]] = 8
        open_ = np.flatnonzero(symbol >= 6)
        table = _functions()[symbol[open_]]
        follows = np.r_[False, np.diff(open_) == 1]  # else what stands before is a constant function
        before = np.where(open_ > 0, state[np.maximum(open_ - 1, 0)], S_WHITE)  # the start of a text is like white space
        table[~follows] = table[~follows, before[~follows]][:, None]
        depth = np.arange(len(open_)) - np.maximum.accumulate(np.where(follows, 0, np.arange(len(open_))))
        step = 1
        while step <= depth.max(initial=0):
            late = np.flatnonzero(depth >= step)
            table[late] = np.take_along_axis(table[late], table[late - step], 1)
            step *= 2
        state[open_] = table[:, 0]
    white = (kind == WHITE) | (kind == SPACE)
    start = np.empty(n, bool)
    start[0] = True
    was, is_ = state[:-1], state[1:]
    start[1:] = ~white[1:] & ~((was == is_) | (was == S_JOIN) | (was == S_ONE) | (was == S_TWO))
    last = np.r_[~white[1:], False]  # white space before something else
    start[1:] |= white[1:] & (~white[:-1] | last[1:])
    return np.r_[np.flatnonzero(start), n]


@cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file) if b}


@cache
def pieces(path: str) -> list[bytes]:
    """The bytes of each id."""
    out = [b""] * (max(ranks(path).values()) + 1)
    for piece, rank in ranks(path).items():
        out[rank] = piece
    return out


def merge(word: bytes, rank: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of a pre-token: of the neighbouring parts whose union has the lowest rank, the leftmost are joined, again and again."""
    if (whole := rank.get(word)) is not None:
        return (whole,)
    if len(word) > 400:
        return _merge_long(word, rank)
    get, none = rank.get, 1 << 30
    at = list(range(len(word) + 1))  # where the parts start, and the end
    pairs = [get(word[i : i + 2], none) for i in range(len(word) - 1)]
    pairs.append(none)  # the last part has no partner
    while (least := min(pairs)) < none:
        i = pairs.index(least)
        del at[i + 1], pairs[i + 1]
        a = at[i]
        pairs[i] = get(word[a : at[i + 2]], none) if i + 2 < len(at) else none
        if i:
            pairs[i - 1] = get(word[at[i - 1] : at[i + 1]], none)
    return tuple([rank[word[a:b]] for a, b in zip(at, at[1:], strict=False)])


def _merge_long(word: bytes, rank: dict[bytes, int]) -> tuple[int, ...]:
    """merge() with a heap and linked parts, for runs of thousands of characters without a boundary."""
    import heapq

    n = len(word)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)

    def offer(i):
        if i >= 0 and end[i] < n and (r := rank.get(word[i : end[end[i]]])) is not None:
            heapq.heappush(heap, (r, i, end[end[i]]))

    while heap:
        _, i, to = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != to or end[i] == to:
            continue
        alive[end[i]] = False
        end[i] = to
        if to < n:
            before[to] = i
        offer(i)
        offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(rank[word[i : end[i]]])
        i = end[i]
    return tuple(out)


class Encoder:
    """Encodes and decodes texts; merged pre-tokens are cached in two generations of bounded size."""

    def __init__(self, path: str):
        self.rank, self.piece = ranks(path), pieces(path)
        self.decimal = list(map(str, range(len(self.piece))))
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def _miss(self, word: str) -> tuple[int, ...]:
        if (ids := self.old.get(word)) is None:
            ids = merge(word.encode("utf-8", "surrogatepass"), self.rank)
        if len(word) <= 64:
            if len(self.young) >= CACHE:
                self.old, self.young = self.young, {}
            self.young[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        at = boundaries(text).tolist()
        words = [text[a:b] for a, b in zip(at, at[1:], strict=False)]
        found = list(map(self.young.get, words))
        for i in [i for i, x in enumerate(found) if x is None]:
            found[i] = self._miss(words[i])
        return list(chain.from_iterable(found))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.piece.__getitem__, ids))

    def offsets(self, ids) -> np.ndarray:
        """For each id, the byte at which it starts in the decoded text."""
        return np.r_[0, np.cumsum([len(self.piece[i]) for i in ids], dtype=np.int64)][: len(ids)]


@cache
def encoder(path: str) -> Encoder:
    """One encoder, with its cache, for each Python worker."""
    return Encoder(path)


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, starts array<long> (the byte at which each id starts): one row for each row.

    A null text is encoded as the empty text: no ids. Rows with a null or repeated id are encoded like any other. Other
    columns are not read, whatever their names.
    """
    def run(batch):
        e = encoder(ranks_path)
        ids = [e.encode(t) for t in texts(batch)]
        return {"doc_id": batch.column("doc_id"), "ids": ids, "starts": [e.offsets(x) for x in ids]}

    return map_batches(id_text(docs, id_col, text_col).selectExpr("cast(doc_id AS long) AS doc_id", "text"), run, "doc_id long, ids array<int>, starts array<long>")


def decode(coded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, bytes binary: the bytes that ids stand for. Null ids decode to no bytes."""
    def run(batch):
        e = encoder(ranks_path)
        return {"doc_id": batch.column("doc_id"), "bytes": [e.decode(x or ()) for x in batch.column("ids").to_pylist()]}

    return map_batches(coded.select("doc_id", "ids"), run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode() and decode() in one pass, for checks over whole corpora.

    ids_sha256 is of the decimal ids joined by a space, decoded_sha256 of the bytes that the ids decode to; of an empty
    or null text both are of no bytes.
    """
    def run(batch):
        e, n, coded, decoded = encoder(ranks_path), [], [], []
        for text in texts(batch):
            ids = e.encode(text)
            n.append(len(ids))
            coded.append(hashlib.sha256(" ".join(map(e.decimal.__getitem__, ids)).encode()).hexdigest())
            decoded.append(hashlib.sha256(e.decode(ids)).hexdigest())
        return {"doc_id": batch.column("doc_id"), "n_tokens": n, "ids_sha256": coded, "decoded_sha256": decoded}

    return map_batches(id_text(docs, id_col, text_col).selectExpr("cast(doc_id AS long) AS doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_into(docs: DataFrame, ranks_path: str, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """docs with one more column, the ids of its text; a column of that name is replaced."""
    @pandas_udf("array<int>")
    def ids(text: pd.Series) -> pd.Series:
        e = encoder(ranks_path)
        return pd.Series([np.array(e.encode(t or ""), np.int32) for t in text])

    return small_batches(docs).withColumn(ids_col, ids(F.col(text_col)))
