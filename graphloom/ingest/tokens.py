"""Tokens of brace languages: identifiers, literals and marks with their places; comments dropped."""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # name, text, number, mark
    value: str
    line: int
    col: int


_PARTS = r"""
(?P<skip>//[^\n]*|/\*.*?(?:\*/|\Z)%(hash)s)
|(?P<text>\"\"\".*?(?:\"\"\"|\Z)|"(?:\\.|[^"\\\n])*"?|`(?:\\.|[^`\\])*`?%(single)s)
|(?P<number>\d[\w.]*)
|(?P<name>[$@]?[^\W\d]\w*|@)
|(?P<mark>\?\.|=>|->|::|:=|<-|\.\.\.|[^\s\w])
"""
_LEXERS: dict[tuple[bool, bool], re.Pattern] = {}


def tokenize(source: str, hash_comments: bool = False, char_quotes: bool = False) -> list[Token]:
    """char_quotes: single quotes hold one character (or a lifetime), not a string."""
    key = (hash_comments, char_quotes)
    if key not in _LEXERS:
        single = r"|'(?:\\.[^']*|[^'\\])'" if char_quotes else r"|'(?:\\.|[^'\\\n])*'?"
        _LEXERS[key] = re.compile(
            _PARTS % {"hash": r"|\#[^\n]*" if hash_comments else "", "single": single}, re.DOTALL | re.VERBOSE
        )
    out, line, last = [], 1, 0
    start_of_line = 0
    for m in _LEXERS[key].finditer(source):
        breaks = source.count("\n", last, m.start())
        if breaks:
            line += breaks
            start_of_line = source.rfind("\n", last, m.start()) + 1
        last = m.start()
        if m.lastgroup != "skip":
            out.append(Token(m.lastgroup, m.group(), line, m.start() - start_of_line))
    return out


PAIRS = {"(": ")", "[": "]", "{": "}"}


def match_brackets(tokens: list[Token]) -> list[int]:
    """For each opening bracket the index of its closing one (else the end); for other tokens their own index."""
    ends = list(range(len(tokens)))
    stack: list[int] = []
    for k, t in enumerate(tokens):
        if t.kind != "mark":
            continue
        if t.value in PAIRS:
            stack.append(k)
        elif t.value in PAIRS.values():
            while stack:
                j = stack.pop()
                ends[j] = k
                if PAIRS[tokens[j].value] == t.value:
                    break
    for j in stack:
        ends[j] = len(tokens) - 1
    return ends
