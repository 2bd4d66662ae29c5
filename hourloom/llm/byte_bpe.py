"""Byte-level BPE encoding and decoding by backtracking over longest matches (operator 8).

Bytes are mapped to Latin-1 characters so that one automaton finds every vocabulary entry in a pre-token. The encoder takes
the longest entry at each position, keeps it if it may stand beside the token before it, shortens it otherwise, and steps
back when nothing shorter is left; positions that proved dead are not tried again. Whether two tokens may stand beside each
other is worked out once and remembered: they may if merging by rank would not have joined symbols across their border
first. The result is the same as merging by rank, in time linear in the pre-token.

Null and '' encode to no ids. Rows are independent: repeated rows, ties and other columns change nothing, and an empty
table gives an empty result. Long texts need memory in proportion to themselves.
"""

from __future__ import annotations

import base64
import hashlib

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import Memo, map_texts
from .tokens import LONG_PIECE, encode_pieces


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class BacktrackingBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = dict(zip(ranks.values(), ranks, strict=True))
        self.length = {i: len(b) for b, i in ranks.items()}
        self.find = regex.compile(pattern).findall
        #: token -> the two tokens that it is merged from; a single byte stands for itself
        self.halves: dict[int, tuple[int, int]] = {}
        #: tokens side by side -> what they merge to
        self.joined: dict[tuple[int, int], int] = {}
        self.may_meet = Memo(lambda pair: self._may_meet(*pair), 250_000)
        by_rank = sorted(ranks.items(), key=lambda x: x[1])
        for token, rank in by_rank:
            if len(token) == 1:
                self.halves[rank] = (rank, rank)
        for token, rank in by_rank:
            if len(token) > 1:
                for k in range(1, len(token)):
                    left, right = ranks.get(token[:k]), ranks.get(token[k:])
                    if left is not None and right is not None and left < rank > right and left in self.halves and right in self.halves and self._may_meet(left, right):
                        self.halves[rank] = (left, right)
                        self.joined[left, right] = rank
                        break
        self.may_meet.clear()
        #: short pre-token -> its ids
        self.known = Memo(lambda word: self.encode_pretoken(word.encode("utf-8")), 250_000)
        #: token -> its longest proper prefix that is a token that merging can reach
        self.shorter: dict[int, int | None] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in by_rank:
            if rank in self.halves:
                self.automaton.add_word(token.decode("latin-1"), rank)
                self.shorter[rank] = next((r for k in range(len(token) - 1, 0, -1) if (r := ranks.get(token[:k])) in self.halves), None)
        self.automaton.make_automaton()

    def _may_meet(self, left: int, right: int) -> bool:
        """Undo the later merge of the two again and again; they may not meet if some earlier pair across the border would have merged first."""
        bound = None  # merges of this rank or above come too late to matter
        while True:
            across = self.joined.get((left, right))
            if across is not None and (bound is None or across < bound):
                return False
            single_l, single_r = self.halves[left][0] == left, self.halves[right][0] == right
            if single_l and single_r:
                return True
            # equal ranks merge from the left: a pair across the border comes before the same merge on its right, after it on its left
            if not single_l and (single_r or left > right):
                bound, left = left, self.halves[left][1]
            else:
                bound, right = right + 1, self.halves[right][0]

    def encode_pretoken(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        size = len(data)
        longest = [0] * size
        length = self.length
        for end, token in self.automaton.iter(data.decode("latin-1")):
            start = end + 1 - length[token]
            longest[start] = token  # matches that end later are longer
        alive = bytearray(b"\x01") * (size + 1)
        tokens: list[int] = []
        at, token = 0, longest[0]
        meet, shorter = self.may_meet, self.shorter
        while True:
            end = at + length[token]
            if alive[end] and (not tokens or meet[tokens[-1], token]):
                tokens.append(token)
                at = end
                if at == size:
                    return tokens
                token = longest[at]
                continue
            token = shorter[token]
            while token is None:
                alive[at] = 0
                token = tokens.pop()
                at -= length[token]
                token = shorter[token]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known = self.known
        for word in self.find(text):
            out += known[word] if len(word) <= LONG_PIECE else self.encode_pretoken(word.encode("utf-8"))
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class PieceEncoder:
    """ids of texts as little-endian unsigned 32-bit integers; pieces between spaces are remembered."""

    def __init__(self, path: str, pattern: str):
        self.bpe, self.memo = BacktrackingBPE(load_ranks(path), pattern), {}

    def others(self, texts: list[str]) -> list[bytes]:
        return [np.array(self.bpe.encode(t), "<u4").tobytes() for t in texts]

    def after_space(self, words: list[str]) -> list[bytes]:
        return self.others([" " + w for w in words])

    def __call__(self, texts: list[str]) -> list[bytes]:
        return [b"".join(x) for x in encode_pieces(texts, self.memo, self.after_space, self.others)]


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and ids (binary: little-endian unsigned 32-bit integers) of every row."""
    return map_texts(df, [id_col], text_col, lambda: (lambda e: lambda texts: [e(texts)])(PieceEncoder(path, pattern)), ("byte_bpe", path, pattern), "ids binary")


def digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, sha256 of the ids, and sha256 of what the ids decode to, of every row."""

    def make():
        encoder = PieceEncoder(path, pattern)

        def work(texts):
            coded = encoder(texts)
            back = [encoder.bpe.decode(np.frombuffer(x, "<u4").tolist()) for x in coded]
            return [len(x) // 4 for x in coded], [hashlib.sha256(x).hexdigest() for x in coded], [hashlib.sha256(x).hexdigest() for x in back]

        return work

    return map_texts(df, [id_col], text_col, make, ("byte_bpe_digests", path, pattern), "n_tokens long, ids_sha256 string, decoded_sha256 string")
