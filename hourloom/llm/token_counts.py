"""Token counts by rank-synchronous array merging (operator 9).

Pre-tokens wait in a batch as one ragged numpy array of symbols. In every round each sequence's lowest-ranked adjacent
pair is merged, all its occurrences at once and all sequences together, until no sequence has a pair to merge; the
symbols that survive are the tokens. The vocabulary file's own normalizer and pre-tokenizer cut the words.

Null and '' have 0 tokens. A special string inside a text is one token, as the library has it by default. Rows are
independent: repeated rows, ties and other columns change nothing, and an empty table gives an empty result. Very long texts take memory in proportion to themselves.
"""

from __future__ import annotations

import json
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

NO_RANK = np.int64(1) << 40


class RankMerger:
    """The merges of a BPE vocabulary as sorted arrays."""

    def __init__(self, model: dict):
        self.ids = {s: i for i, s in enumerate(model["vocab"])}
        self.end = model.get("end_of_word_suffix") or ""
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        n = self.n = len(self.ids)
        keys = np.array([self.ids[a] * n + self.ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([self.ids[a + b] for a, b in pairs], np.int64)

    def symbols(self, word: str) -> list[int]:
        """The first symbols of a pre-token; characters that the vocabulary lacks are left out, as the library does without an unknown token."""
        ids, last = self.ids, len(word) - 1
        return [i for k, c in enumerate(word) if (i := ids.get(c + self.end if k == last else c)) is not None]

    def counts(self, words: list[str]) -> np.ndarray:
        """Surviving symbols of each word."""
        lists = [self.symbols(w) for w in words]
        out = np.array([len(x) for x in lists], np.int64)
        live = np.flatnonzero(out > 1)
        symbol = np.array([s for i in live for s in lists[i]], np.int64)
        owner = np.repeat(np.arange(len(live)), out[live])
        while len(symbol):
            inside = owner[:-1] == owner[1:]
            key = symbol[:-1] * self.n + symbol[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(inside & (self.keys[at] == key), self.ranks[at], NO_RANK)
            rank = np.append(rank, NO_RANK)  # the last symbol starts no pair
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            sizes = np.diff(np.append(starts, len(owner)))
            least = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            hit = (rank == least) & (rank < NO_RANK)
            # in a run of overlapping equal pairs every second one is merged, from the left
            index = np.arange(len(hit))
            run_start = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), index, 0))
            hit &= (index - run_start) % 2 == 0
            symbol[hit] = self.made[rank[hit]]
            stays = ~np.append(False, hit[:-1])
            going = least < NO_RANK
            done = starts[~going[starts]]
            out[live[owner[done]]] = sizes[~going[starts]]
            stays &= going
            symbol, owner = symbol[stays], owner[stays]
        return out


class TokenCounter:
    def __init__(self, path: str, limit: int = 400_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        tokenizer = Tokenizer.from_file(path)
        self.normalize = tokenizer.normalizer.normalize_str if tokenizer.normalizer else str
        self.split = tokenizer.pre_tokenizer.pre_tokenize_str
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_re = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        self.merger, self.memo, self.limit = RankMerger(spec["model"]), {}, limit

    def _learn(self, new: list[bytes]) -> None:
        words, owner = [], []
        for i, piece in enumerate(new):
            for word, _ in self.split(self.normalize(piece.decode("utf-8"))):
                words.append(word)
                owner.append(i)
        distinct = {w: k for k, w in enumerate(dict.fromkeys(words))}
        each = self.merger.counts(list(distinct))
        got = np.zeros(len(new), np.int64)
        np.add.at(got, owner, each[[distinct[w] for w in words]] if words else each[:0])
        self.memo.update(zip(new, got.tolist(), strict=True))

    def __call__(self, texts: list[str]) -> tuple[list[int], list[int]]:
        cut, extra = [], []
        for text in texts:
            n = 0
            if any(s in text for s in self.special):
                text, n = self.special_re.subn("\n", text)
            cut.append(text.encode("utf-8").split())
            extra.append(n)
        new = {w for ws in cut for w in ws if w not in self.memo}
        if len(self.memo) + len(new) > self.limit:
            self.memo.clear()
            new = {w for ws in cut for w in ws}
        self._learn(list(new))
        get = self.memo.__getitem__
        return [len(t.encode("utf-8")) for t in texts], [n + sum(map(get, ws)) for n, ws in zip(extra, cut, strict=True)]


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """id_col, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``) of every row, by the vocabulary file at ``path``."""
    counted = map_texts(df, [id_col], text_col, lambda: TokenCounter(path), ("token_counts", path), "n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
