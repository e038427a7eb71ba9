"""Token counts by byte-pair merging with a heap and a linked list.

The text is cut as the tokenizer's pre-tokenizer cuts it. In each word the adjacent pair of lowest rank
is merged again and again; a heap gives that pair and a linked list its neighbours, so a word of n bytes
costs O(n log n) even if it is a whole text without spaces. Only the number of merges is kept: the count
is initial symbols minus merges, and no identifiers are made.

Words repeat, so each worker remembers the counts of the words and chunks it has met, in memories of bounded size. No shuffle, no broadcast: the vocabulary is read once per worker.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from prefrank.llm.words import LATIN, Remembered, byte_symbols, coded, latin_pattern

#: Fixed value: how the byte-level pre-tokenizer cuts a text. White space is Unicode's.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
                      r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
LATIN_WORDS = latin_pattern(r"'s|'t|'re|'ve|'m|'ll|'d| ?[LETTER]+| ?[NUMBER]+| ?[^\sLETTERNUMBER]+|\s+(?!\S)|\s+")
#: Texts that are cut together.
TEXTS = 2048
SPACE_RUN = re.compile(r"\s\s|\s\Z")


def count_symbols(symbols: list[int], ranks: dict[int, int], made: list[int]) -> int:
    """Symbols left after all merges; `symbols` is overwritten. Ties in rank go to the leftmost pair.

    `ranks`: left << 32 | right -> rank of the pair; `made`: rank -> merged symbol. The heap holds
    rank << 32 | place; an entry whose place no longer starts a pair of that rank is stale.
    """
    n = len(symbols)
    rank_of = ranks.get
    heap = [rank << 32 | i for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (rank := rank_of(a << 32 | b)) is not None]
    if not heap:
        return n
    heapq.heapify(heap)
    after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
    while heap:
        entry = heapq.heappop(heap)
        i, rank = entry & 0xFFFFFFFF, entry >> 32
        j = after[i]
        if j >= n or symbols[i] < 0 or rank_of(symbols[i] << 32 | symbols[j]) != rank:
            continue
        new = symbols[i] = made[rank]
        symbols[j] = -1
        k = after[i] = after[j]
        left -= 1
        if k < n:
            before[k] = i
            if (rank := rank_of(new << 32 | symbols[k])) is not None:
                heapq.heappush(heap, rank << 32 | i)
        if (h := before[i]) >= 0 and (rank := rank_of(symbols[h] << 32 | new)) is not None:
            heapq.heappush(heap, rank << 32 | h)
    return left


class Vocabulary:
    """Merge ranks of a byte-level tokenizer file."""

    def __init__(self, path: str, remembered: int):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.ranks = {ids[a] << 32 | ids[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.made = [ids[a + b] for a, b in pairs]
        self.first = [ids[s] for s in byte_symbols()]
        special = [re.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = re.compile("|".join(special) or r"(?!)")
        self.words: Remembered[int] = Remembered(self.word, remembered)
        self.chunks: Remembered[int] = Remembered(self.chunk, remembered)

    def chunk(self, chunk: str) -> int:
        return sum(map(self.words.__getitem__, LATIN_WORDS.findall(chunk)))

    def word(self, word: str) -> int:
        data = word.encode()
        return 1 if len(data) == 1 else count_symbols([self.first[b] for b in data], self.ranks, self.made)

    def texts(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text. The strings of special tokens count one each, as the library takes them.

        A space before a visible character always starts a word. So Latin texts without runs of white
        space are cut at spaces, all together, and each distinct chunk is looked at once.
        """
        plain = [bool(t) and bool(LATIN.fullmatch(t)) and not SPACE_RUN.search(t) and not self.special.search(t) for t in texts]
        marked = pc.replace_substring(pa.array([t for t, ok in zip(texts, plain) if ok], pa.string()), " ", "\x1f ")
        chunks, places, bounds = coded(pc.split_pattern(marked, "\x1f"))
        counts = np.array([self.chunks[c] for c in chunks], dtype="int64")
        sums = np.concatenate([[0], np.cumsum(counts[places])])
        out = np.zeros(len(texts), dtype="int64")
        out[plain] = np.diff(sums[bounds])
        for i, (t, ok) in enumerate(zip(texts, plain)):
            if t and not ok:
                parts = self.special.split(t)
                out[i] = len(parts) - 1 + sum(self.words[w] for p in parts for w in WORDS.findall(p))
        return out


@lru_cache(maxsize=4)
def vocabulary(path: str, remembered: int) -> Vocabulary:
    return Vocabulary(path, remembered)


def token_counts(df: DataFrame, tokenizer: str, text: str = "text", limit: int = 512, remembered: int = 250_000) -> DataFrame:
    """Add n_bytes (UTF-8), n_tokens and over_limit (n_tokens > `limit`) of whole texts.

    `tokenizer` is the path of a byte-level tokenizer file that every worker can read. A null text counts
    as empty: 0 bytes, 0 tokens. Columns of `df` with these names are replaced; rows are never dropped, so
    repeated rows and an empty table need no special case. `remembered` bounds each memory of a worker.
    """

    @F.pandas_udf("long")
    def counted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = vocabulary(tokenizer, remembered).texts
        for s in texts:
            yield pd.Series(np.concatenate([np.zeros(0, "int64")] + [count(s.iloc[i:i + TEXTS].tolist()) for i in range(0, len(s), TEXTS)]))

    kept = [c for c in df.columns if c.lower() not in ("n_bytes", "n_tokens", "over_limit") or c == text]
    return (df.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), counted(text).alias("n_tokens"))
            .withColumn("over_limit", F.col("n_tokens") > limit))
