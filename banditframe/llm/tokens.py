"""Token counts by a linear longest-match automaton over a vocabulary of byte strings.

The vocabulary is a trie. A node's failure link leads to where matching goes on once the longest piece that ends inside
the node's string, and those that follow from it, are popped; how many those are is precomputed. So a word is read once,
byte by byte, and its greedy pieces are counted without being built.

Cases: a null or blank text has no words and no tokens; a text of any length is counted whole; a byte that no piece
covers makes its word one unknown token; an empty table gives an empty result; columns of the same names as results are
replaced, other columns are kept.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Tens of times what the largest vocabularies of models hold.
MOST_BYTES = 64 << 20


class Automaton:
    """goto[node << 8 | byte] is a child; fail[node] the failure link, -1 if none; popped[node] the pieces it pops."""

    def __init__(self, pieces: Iterable[bytes]) -> None:
        goto: dict[int, int] = {}
        ends, parent = [False], [(0, 0)]
        for piece in pieces:
            node = 0
            for byte in piece:
                key = node << 8 | byte
                if key not in goto:
                    goto[key] = len(ends)
                    ends.append(False)
                    parent.append((node, byte))
                node = goto[key]
            ends[node] = True
        ends[0] = False
        depth = [0] * len(ends)
        for v in range(1, len(ends)):
            depth[v] = depth[parent[v][0]] + 1
        fail, popped = [-1] * len(ends), [0] * len(ends)
        for v in sorted(range(1, len(ends)), key=depth.__getitem__):
            if ends[v]:
                fail[v], popped[v] = 0, 1
                continue
            u, byte = parent[v]
            z, n = fail[u], popped[u]
            while z != -1 and z << 8 | byte not in goto:
                z, n = fail[z], n + popped[z]
            if z != -1:
                fail[v], popped[v] = goto[z << 8 | byte], n
        self.tables = goto, fail, popped

    def count(self, word: bytes) -> int:
        """The number of greedy longest-match pieces, or -1 if some byte can't be covered."""
        return count(word, *self.tables)


def count(word: bytes, goto: dict[int, int], fail: list[int], popped: list[int]) -> int:
    node = n = 0
    for byte in word:
        while (to := goto.get(node << 8 | byte)) is None:
            if (f := fail[node]) == -1:
                return -1
            n += popped[node]
            node = f
        node = to
    while node:
        if (f := fail[node]) == -1:
            return -1
        n += popped[node]
        node = f
    return n


class _Seen(dict):
    """Counts of words met before, emptied when there are `bound`. Words of more than `longest` bytes are counted each time, so what
    is kept is bounded in bytes, too."""

    def __init__(self, tables: tuple, bound: int = 200_000, longest: int = 64) -> None:
        super().__init__()
        self.tables, self.bound, self.longest = tables, bound, longest

    def __missing__(self, word: bytes) -> int:
        n = count(b" " + word, *self.tables)
        if len(word) <= self.longest:
            if len(self) >= self.bound:
                self.clear()
            self[word] = n
        return n


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """Pieces of a rank file (base64 and rank a line), which the driver reads."""
    with open(path, "rb") as lines:
        return [base64.b64decode(x.split()[0]) for x in lines if x.strip()]


def bounded(pieces: list[bytes], most_bytes: int = MOST_BYTES) -> list[bytes]:
    """pieces, if a vocabulary of a model; what is broadcast must not grow with the data."""
    if (size := sum(map(len, pieces))) > most_bytes:
        raise ValueError(f"a vocabulary of {size} bytes is none of a model; the most is {most_bytes}")
    return pieces


def token_counts(docs: DataFrame, text_col: str = "text", vocabulary: str | list[bytes] = VOCABULARY) -> DataFrame:
    """docs with n_words, n_tokens and n_unknown. Words are cut at ASCII white space and matched with a space before them."""
    pieces = read_vocabulary(vocabulary) if isinstance(vocabulary, str) else vocabulary
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(bounded(pieces)).tables)

    @F.pandas_udf("n_words long, n_tokens long, n_unknown long")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        seen = _Seen(shared.value)
        for s in batches:
            out = []
            for text in s:
                counts = list(map(seen.__getitem__, (text or "").encode("utf-8").split()))
                unknown = counts.count(-1)
                out.append((len(counts), sum(counts) + 2 * unknown, unknown))
            yield pd.DataFrame(out, columns=["n_words", "n_tokens", "n_unknown"])

    rest = [c for c in docs.columns if c not in ("n_words", "n_tokens", "n_unknown")]
    return docs.select(*rest, udf(F.col(text_col)).alias("__n")).select(*rest, "__n.*")
