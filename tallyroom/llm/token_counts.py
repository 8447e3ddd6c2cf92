"""Token counts under a unigram model, by dynamic programming over a trie of the distinct pre-tokens.

A pre-token is a word with a mark before it.  Distinct pre-tokens of a batch are inserted in a trie; the best forward
score of each trie node is computed once, however many pre-tokens run through it, and nodes where a pre-token ends keep
its token count.  The trie belongs to a task and is begun anew when it has grown to ``NODES`` nodes, so memory is
bounded, nothing is shuffled and a lost task is simply run again.  A word of more than ``LONG`` letters adds no nodes.

Pieces come from a public vocabulary file.  It holds ranks, not probabilities: a piece's log-probability is taken from
Zipf's law, -ln(rank + 1).
"""

from __future__ import annotations

import math
import os
from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyroom.llm.common import field, map_texts, split_bytes

#: The mark before a word, in the vocabulary's pieces.
MARK = "▁"
NODES = 400_000
#: Longer pre-tokens are read with the scores of the last few prefixes alone: they share little and would fill the trie.
LONG = 200
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def pieces_of(path: str) -> dict[str, float]:
    """Piece -> log-probability, of a sentencepiece model file; control and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    ranked = sorted(ids, key=lambda i: (-model.get_score(i), i))
    return {model.id_to_piece(i): -math.log(rank + 1) for rank, i in enumerate(ranked, 1)}


class TokenTrie:
    """Best segmentation's token count of each pre-token that was inserted.

    A character that is no piece by itself becomes one token for each byte of its UTF-8 form, each of log-probability
    ``byte_score``.  Of paths with equal scores the one with fewer tokens counts.
    """

    def __init__(self, pieces: dict[str, float], nodes: int = NODES):
        self.pieces, self.limit = pieces, nodes
        self.byte_score = min(pieces.values(), default=-1.0) - 10.0
        self.longest = max(map(len, pieces), default=1)
        # what pieces end with: once a piece of the word is no such ending, nothing longer is a piece
        self.endings: dict[str, float | bool] = {p[k:]: False for p in pieces for k in range(1, len(p))} | pieces
        self.clear()

    def clear(self) -> None:
        # a node: its children, and (score, minus tokens) of the best way to read what leads to it
        self.children: list[dict[str, int]] = [{}]
        self.best: list[tuple[float, int]] = [(0.0, 0)]

    def count(self, token: str) -> int:
        """Inserts a pre-token; only the nodes it adds are computed."""
        if len(token) > LONG:
            return self._count_long(token)
        at, ways = 0, [self.best[0]]
        for i, letter in enumerate(token):
            to = self.children[at].get(letter)
            if to is None:
                to = self.children[at][letter] = len(self.children)
                self.children.append({})
                self.best.append(self._forward(token, i + 1, ways, 0))
            at = to
            ways.append(self.best[at])
        return -self.best[at][1]

    def _count_long(self, token: str) -> int:
        ways: deque[tuple[float, int]] = deque([(0.0, 0)], maxlen=self.longest)
        for end in range(1, len(token) + 1):
            ways.append(self._forward(token, end, ways, end - len(ways)))
        return -ways[-1][1]

    def _forward(self, token: str, end: int, ways, first: int) -> tuple[float, int]:
        """The best way to read ``end`` letters; ways: those to read ``first`` letters, and so on up to one less."""
        score, tokens = ways[-1]
        letter = token[end - 1]
        n = 1 if letter < "\x80" else len(letter.encode("utf-8", "surrogatepass"))
        best = (score + n * self.byte_score, tokens - n)
        get = self.endings.get
        for begin in range(end - 1, max(first, end - self.longest) - 1, -1):
            p = get(token[begin:end])
            if p is None:
                break
            if p is not False:
                score, tokens = ways[begin - first]
                if (way := (score + p, tokens - 1)) > best:
                    best = way
        return best

    def full(self) -> bool:
        return len(self.children) > self.limit


def count_tokens(docs: DataFrame, pieces: dict[str, float], *, text: str = "text", keep: list[str] | None = None, nodes: int = NODES) -> DataFrame:
    """The columns (or ``keep``), then n_words, n_tokens and n_bytes (long) of each whole text.

    A null or empty text has none of each.  Repeated rows give repeated rows, columns with these names are replaced.
    The vocabulary, of fixed size, is sent to the executors.  A word as long as its text is read whole, in memory in
    proportion to the text.
    """
    sent = docs.sparkSession.sparkContext.broadcast(pieces)

    def make() -> Callable[[list], list[tuple]]:
        trie = TokenTrie(sent.value, nodes)
        counts: dict[bytes, int] = {}  # of the pre-tokens that were inserted

        def count(texts: list) -> list[tuple]:
            out = []
            for words in map(split_bytes, texts):
                if trie.full() or len(counts) > nodes:
                    trie.clear(), counts.clear()
                for word in sorted(set(words).difference(counts)):  # in order: words with one beginning follow each other
                    if trie.full():
                        trie.clear()
                    counts[word] = trie.count(MARK + word.decode("utf-8", "surrogatepass"))
                out.append((len(words), sum(map(counts.__getitem__, words)), sum(map(len, words))))
            return out

        return count

    return map_texts(docs, text, [field("n_words", "long"), field("n_tokens", "long"), field("n_bytes", "long")], make, keep=keep)


def read_vocabulary(spark: SparkSession, path: str = VOCABULARY) -> dict[str, float]:
    """Read where the driver runs: executors need not have the file.  A missing file is an error that names it."""
    if not os.path.exists(path):
        raise FileNotFoundError(f"no vocabulary file at {path}; give its path")
    return pieces_of(path)
