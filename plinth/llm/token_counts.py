"""Token counts: lengths of greedy longest-match word pieces, by a linear automaton.

A word's pieces are found from the left, always the longest that the vocabulary
has.  The vocabulary is a trie over bytes and an end-of-word mark.  Each node
has a failure link and the number of pieces that are complete when it is
followed; a word is read once, symbol by symbol, and these numbers are added
up.  No piece is built.  Every single symbol is a piece, so no word fails.

Words are white-space separated, A-Z lower-cased.  Counts of words already seen
are kept in a table of bounded size, which is emptied when full.

Edge cases: null and empty texts have no words and no tokens.  Repeated rows each
get a row; a null doc_id stays null; empty tables give no rows; other columns
are ignored.
"""

from __future__ import annotations

import json
import uuid
from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm._base import table
from plinth.llm.packing import byte_symbols

END = 256
REMEMBERED = 1 << 19


def read_pieces(path: str, end: str = "</w>") -> list[tuple[int, ...]]:
    """The pieces of a byte-level vocabulary file as symbols; special tokens are left out."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    special = {t["content"] for t in data["added_tokens"]}
    of = byte_symbols()
    out = []
    for t in data["model"]["vocab"]:
        if t not in special:
            closes = t.endswith(end) and t != end
            out.append(tuple(of[c] for c in (t[: -len(end)] if closes else t)) + (END,) * closes)
    return out


class Automaton:
    """``goes`` maps node * 257 + symbol to the next node; node 0 is the root."""

    def __init__(self, pieces: Iterable[tuple[int, ...]]):
        self.goes: dict[int, int] = {}
        last: list[tuple[int, int]] = [(0, 0)]  # parent and symbol of each node
        whole: set[int] = set()
        # single symbols make the match total
        for piece in [*pieces, *((s,) for s in range(257))]:
            node = 0
            for s in piece:
                if (after := self.goes.get(node * 257 + s)) is None:
                    after = self.goes[node * 257 + s] = len(last)
                    last.append((node, s))
                node = after
            if piece:
                whole.add(node)
        below: list[list[int]] = [[] for _ in last]
        for node in range(1, len(last)):
            below[last[node][0]].append(node)
        self.fails, self.pops = [0] * len(last), [0] * len(last)
        todo = deque(below[0])
        while todo:  # nearer to the root first
            node = todo.popleft()
            todo.extend(below[node])
            if node in whole:
                self.pops[node] = 1
                continue
            parent, s = last[node]
            pops, link = self.pops[parent], self.fails[parent]
            while (after := self.goes.get(link * 257 + s)) is None:
                pops += self.pops[link]
                link = self.fails[link]
            self.fails[node], self.pops[node] = after, pops

    def count(self, word: bytes) -> int:
        """Pieces of one word."""
        goes, fails, pops = self.goes, self.fails, self.pops
        node = n = 0
        for s in (*word, END):
            while (after := goes.get(node * 257 + s)) is None:
                n += pops[node]
                node = fails[node]
            node = after
        while node:
            n += pops[node]
            node = fails[node]
        return n


_memory: dict[str, dict[bytes, int]] = {}


def remembered(name: str) -> dict[bytes, int]:
    """Counts of words that this Python worker has met with the automaton of that name; only the last one's are kept."""
    if name not in _memory:
        _memory.clear()
        _memory[name] = {}
    return _memory[name]


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_tokens, longest_word_tokens of every row."""
    # built here and sent once to each executor; its size is that of the vocabulary
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, Automaton(read_pieces(path))))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, automaton = shared.value
        count, known = automaton.count, remembered(name)
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                words = (text or "").encode().lower().split()
                for w in set(words).difference(known):
                    known[w] = count(w)
                sizes = list(map(known.__getitem__, words))
                rows.append((doc_id, len(words), sum(sizes), max(sizes, default=0)))
                if len(known) > REMEMBERED:
                    known.clear()
            yield pd.DataFrame(rows, columns=["doc_id", "n_words", "n_tokens", "longest_word_tokens"])

    d = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    out = d.mapInPandas(each, "doc_id string, n_words long, n_tokens long, longest_word_tokens long")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
