"""Tokens of Rust source text."""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    """kind: ident, lifetime, literal or punct (one character each)."""

    kind: str
    text: str
    start: int
    end: int


_SPACE = re.compile(r"\s+")
_LINE_COMMENT = re.compile(r"//[^\n]*")
_RAW_STRING = re.compile(r"(?:b|c)?r(#*)\"")
_STRING = re.compile(r"[bc]?\"(?:[^\"\\]|\\.)*\"", re.S)
_CHAR = re.compile(r"b?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u\{[^}]*\}|.))'", re.S)
_LIFETIME = re.compile(r"'[^\W\d]\w*")
_NUMBER = re.compile(r"0[xob][0-9a-fA-F_]+\w*|[0-9][0-9_]*(?:\.(?![.\w])|\.[0-9][0-9_]*)?(?:[eE][+-]?[0-9_]+)?\w*")
_IDENT = re.compile(r"(?:r#)?[^\W\d]\w*")


def _block_comment_end(text: str, at: int) -> int:
    """Where the block comment that begins at ``at`` ends; comments nest."""
    depth, pos = 0, at
    for m in re.compile(r"/\*|\*/").finditer(text, at):
        depth += 1 if m.group() == "/*" else -1
        pos = m.end()
        if not depth:
            return pos
    return len(text)


def tokenize(text: str) -> list[Token]:
    """All tokens; comments and white space go. What can't start a token is skipped."""
    out, at, n = [], 0, len(text)
    if text.startswith("#!") and not text.startswith("#!["):
        at = (text.find("\n") + 1) or n
    while at < n:
        c = text[at]
        if m := _SPACE.match(text, at):
            at = m.end()
        elif text.startswith("//", at):
            at = _LINE_COMMENT.match(text, at).end()
        elif text.startswith("/*", at):
            at = _block_comment_end(text, at)
        elif c in "rbc" and (m := _RAW_STRING.match(text, at)):
            close = text.find('"' + m.group(1), m.end())
            end = n if close < 0 else close + 1 + len(m.group(1))
            out.append(Token("literal", text[at:end], at, end))
            at = end
        elif c in '"bc' and (m := _STRING.match(text, at)):
            out.append(Token("literal", m.group(), at, m.end()))
            at = m.end()
        elif c in "'b" and (m := _CHAR.match(text, at)):
            out.append(Token("literal", m.group(), at, m.end()))
            at = m.end()
        elif m := _LIFETIME.match(text, at):
            out.append(Token("lifetime", m.group(), at, m.end()))
            at = m.end()
        elif m := _IDENT.match(text, at):
            out.append(Token("ident", m.group(), at, m.end()))
            at = m.end()
        elif c.isdigit() and (m := _NUMBER.match(text, at)):
            out.append(Token("literal", m.group(), at, m.end()))
            at = m.end()
        else:
            out.append(Token("punct", c, at, at + 1))
            at += 1
    return out
