"""Token counts under a unigram model, by dynamic programming shared along a trie.

The pieces are those of a public vocabulary; a piece's log probability follows from its place there (Zipf's law), since the
file holds merges, not a unigram model, and tokenizers are not trained here. Distinct pre-tokens are inserted in a trie.
The best score of a prefix depends on the prefix alone, so each trie node computes it once, for all pre-tokens that share
it, from its at most longest-piece ancestors; nodes at which a pre-token ends give its number of tokens. A pre-token of more
than LONG characters shares little: its scores roll through a window of the longest piece instead, so that memory doesn't
grow with it.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import cache

from pyspark.sql import DataFrame

from .common import id_text, map_batches, texts

#: Added to a piece's place before the logarithm; log probability of a byte of a character that no piece covers.
FLATTEN, BYTE = 20.0, -25.0
#: Trie nodes after which it is begun anew, pre-tokens whose counts are kept beside it, and characters of one that goes into it.
NODES, KEPT, LONG = 600_000, 300_000, 256
#: What stands before a pre-token, as in the vocabulary.
MARK = "▁"


@cache
def vocabulary(path: str) -> dict[str, float]:
    """Piece to log probability."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = [p.id_to_piece(i) for i in range(p.vocab_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
    total = math.log(math.fsum(1 / (i + FLATTEN) for i in range(len(kept))))
    return {piece: -math.log(i + FLATTEN) - total for i, piece in enumerate(kept)}


class Trie:
    """Prefixes of pre-tokens: children, best score and, of the best, the fewest tokens; for each node."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces, self.longest = pieces, max(map(len, pieces), default=1)
        self.counts: dict[str, tuple[int, float]] = {}
        self._begin()

    def _begin(self) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.score: list[float] = [0.0]
        self.tokens: list[int] = [0]

    def insert(self, word: str) -> tuple[int, float]:
        """Tokens and score of a pre-token; only nodes that are new are computed."""
        if len(self.children) > NODES:
            self._begin()
        node, path = 0, [0]
        for i, c in enumerate(word, 1):
            nxt = self.children[node].get(c)
            if nxt is None:
                nxt = self._node(word, i, path)
                self.children[node][c] = nxt
            node = nxt
            path.append(node)
        return self.tokens[node], self.score[node]

    def _node(self, word: str, end: int, path: list[int]) -> int:
        width = len(word[end - 1].encode("utf-8", "surrogatepass"))
        before = path[end - 1]
        best, fewest = self.score[before] + BYTE * width, self.tokens[before] + width
        get, score, tokens = self.pieces.get, self.score, self.tokens
        for start in range(max(0, end - self.longest), end):
            s = get(word[start:end])
            if s is not None:
                s += score[path[start]]
                n = tokens[path[start]] + 1
                if s > best or s == best and n < fewest:
                    best, fewest = s, n
        self.children.append({})
        self.score.append(best)
        self.tokens.append(fewest)
        return len(self.score) - 1

    def rolled(self, word: str) -> tuple[int, float]:
        """What insert() gives, by a window of as many scores as the longest piece has characters."""
        size = self.longest + 1
        score, tokens, get = [0.0] * size, [0] * size, self.pieces.get
        for end in range(1, len(word) + 1):
            width = len(word[end - 1].encode("utf-8", "surrogatepass"))
            best, fewest = score[(end - 1) % size] + BYTE * width, tokens[(end - 1) % size] + width
            for start in range(max(0, end - self.longest), end):
                s = get(word[start:end])
                if s is not None:
                    s += score[start % size]
                    n = tokens[start % size] + 1
                    if s > best or s == best and n < fewest:
                        best, fewest = s, n
            score[end % size], tokens[end % size] = best, fewest
        return tokens[len(word) % size], score[len(word) % size]

    def count_all(self, words) -> dict[str, tuple[int, float]]:
        """The counts of all distinct words; those that go into the trie are kept, and go in order, so that shared prefixes stand together."""
        if len(self.counts) > KEPT:
            self.counts = {}
        found = {w: self.rolled(w) for w in words if len(w) > LONG}
        for w in sorted(w for w in words if len(w) <= LONG and w not in self.counts):
            self.counts[w] = self.insert(w)
        return found | {w: self.counts[w] for w in words if len(w) <= LONG}


@cache
def trie(path: str) -> Trie:
    """One trie for each Python worker."""
    return Trie(vocabulary(path))


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pretokens, n_tokens, score: one row for each row of docs.

    Pre-tokens are the runs between white space (U+0020, U+0009 to U+000D), each with MARK before it; n_tokens is how many
    pieces, and bytes of characters that no piece covers, their best segmentations have (of equal scores the shorter),
    and score the sum of their log probabilities. A null or empty text has none, and score 0. Rows with null or repeated
    ids are counted like others. Pre-tokens of a batch of rows are inserted together; the trie has a bounded size. Only the
    two columns are read. An empty table gives an empty table.
    """
    def run(batch):
        t = trie(vocabulary_path)
        per_doc = [Counter(text.encode("utf-8", "surrogatepass").split()) for text in texts(batch)]
        every = {w: MARK + w.decode("utf-8", "surrogatepass") for c in per_doc for w in c}
        counts = t.count_all(set(every.values()))
        found = {w: counts[x] for w, x in every.items()}
        out = {"doc_id": batch.column("doc_id"), "n_pretokens": [c.total() for c in per_doc]}
        out["n_tokens"] = [sum(found[w][0] * n for w, n in c.items()) for c in per_doc]
        out["score"] = [math.fsum(found[w][1] * n for w, n in c.items()) for c in per_doc]
        return out

    return map_batches(id_text(docs, id_col, text_col).selectExpr("cast(doc_id AS long) AS doc_id", "text"), run, "doc_id long, n_pretokens long, n_tokens long, score double")
