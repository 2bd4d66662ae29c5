"""What the two byte-level tokenizing operators share: cutting texts into pieces that can be encoded apart."""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate, chain, pairwise

#: White space other than the plain space; none is beyond U+3000.
OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]
#: Longer pieces are encoded each time instead of being remembered.
LONG_PIECE = 80


def clumped(text: str) -> bool:
    """Whether a plain space touches other white space, or white space starts or ends the text."""
    if text[0].isspace() or text[-1].isspace() or "  " in text:
        return True
    return any(c in text and (f" {c}" in text or f"{c} " in text) for c in OTHER_SPACE)


def pieces(text: str, lines: bool = False) -> list[str]:
    """Keys of the pieces of a text, cut before every space; the whole text where it is clumped.

    A piece after a space has the characters after that space as its key; other pieces have a space before them as a mark.
    lines: for a pattern in which a lone line end between other characters is a match of its own, texts are cut before these too; such a piece is its own key.

    In the byte-level pattern a space is the first character of its match or part of a white-space run, so with lone
    spaces between other characters each piece is matched as it would be inside the text.
    """
    if " " not in text or clumped(text):
        return [" " + text]
    if lines and "\n" in text and "\n\n" not in text and not any(c in text for c in OTHER_SPACE if c != "\n"):
        text = text.replace("\n", " \n")
    cut = text.split(" ")
    cut[0] = " " + cut[0]
    return cut


#: Marks that the byte-level pattern parts from a letter or digit before them when white space or nothing follows.
TAIL = ".,;:!?"


def without_tail(word: str, marks: str = TAIL) -> str:
    """The word without marks at its end, where these are pre-tokens of their own; else the whole word."""
    core = word.rstrip(marks)
    return core if core and len(core) < len(word) and (core[-1].isalpha() or core[-1].isdecimal()) else word


def learn(memo: dict, words: list[str], after_space: Callable, others: Callable, marks: str = TAIL) -> None:
    """Values of different words that are not in ``memo``; each is encoded once, without the marks at its end."""
    core = {w: c for w in words if w[-1] in marks and len(c := without_tail(w, marks)) < len(w)}
    plain = [w for w in words if w not in core] if core else words
    memo.update(zip(plain, after_space(plain), strict=True))
    new = [c for c in dict.fromkeys(core.values()) if c not in memo]
    memo.update(zip(new, after_space(new), strict=True))
    tails = list({w[len(c) :] for w, c in core.items()})
    tail = dict(zip(tails, others(tails), strict=True))
    memo.update([(w, memo[c] + tail[w[len(c) :]]) for w, c in core.items()])


def encode_pieces(texts: list[str], memo: dict, after_space: Callable, others: Callable, limit: int = 500_000, after_line: Callable | None = None, marks: str = TAIL) -> list[list]:
    """The remembered or newly encoded value of every piece of every text; what is missing is encoded in one call of each kind.

    after_space: values of words without white space at their ends, each as after a space; others: values of texts.
    after_line: for patterns that ``pieces`` may cut by lines; values of words with the line end before them.
    """
    cut = [pieces(x, after_line is not None) for x in texts]
    flat = list(chain.from_iterable(cut))
    values = list(map(memo.get, flat))  # most are there: each is looked up once
    missing = [i for i, v in enumerate(values) if v is None]  # the only ones that are gone through again
    new = list(dict.fromkeys([flat[i] for i in missing]))
    if len(memo) + len(new) > limit:  # what these texts have stays: frequent pieces are among it
        kept = {p: v for p, v in zip(flat, values, strict=True) if v is not None}
        memo.clear()
        memo.update(kept)
    words, rest = [p for p in new if p[0] != " "], [p for p in new if p[0] == " "]
    if after_line is not None:
        learn(memo, [p for p in words if p[0] == "\n"], after_line, others, marks)
        words = [p for p in words if p[0] != "\n"]
    learn(memo, words, after_space, others, marks)
    memo.update(zip(rest, others([p[1:] for p in rest]), strict=True))
    for i in missing:
        values[i] = memo[flat[i]]
    for p in [p for p in new if len(p) > LONG_PIECE]:
        memo.pop(p, None)
        memo.pop(without_tail(p, marks), None)
    ends = [0, *accumulate(map(len, cut))]
    return [values[low:high] for low, high in pairwise(ends)]
