"""A lexer for C# 12: tokens, comments and the lines they touch."""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple

#: Longest first; a fixed list.
_OPERATORS = (">>>=", "<<=", ">>=", "??=", "...", "=>", "==", "!=", "<=", ">=", "&&", "||", "??", "?.", "++", "--", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "->", "::", "<<", "..")

_BREAKS = "\n\r\u0085  "
_BREAK = re.compile("\r\n|[\n\r\u0085  ]")
_WORD = re.compile(r"@?[^\W\d]\w*")
_NUMBER = re.compile(r"0[xX][0-9a-fA-F_]+[uUlL]*|0[bB][01_]+[uUlL]*|(?:\d[\d_]*)?\.?\d[\d_]*(?:[eE][+-]?\d+)?[fFdDmMuUlL]*")
_STRING_START = re.compile(r'(?:\$+@?|@\$?)?"+')

WORD, NUMBER, STRING, CHAR, PUNCTUATION = "word", "number", "string", "char", "punctuation"


class Token(NamedTuple):
    kind: str
    text: str
    start: int
    end: int


class Comment(NamedTuple):
    start: int
    end: int
    documentation: bool


class Lexed(NamedTuple):
    tokens: list[Token]
    comments: list[Comment]
    line_starts: list[int]
    length: int

    def line(self, position: int) -> int:
        """Line of a position, from 1."""
        return bisect_right(self.line_starts, position)

    def lines(self, start: int, end: int) -> range:
        """Lines that a span touches, without a last one that it only reaches at its first column."""
        first, last = self.line(start), self.line(end)
        if last > first and self.line_starts[last - 1] == end:
            last -= 1
        return range(first, last + 1)


class _Lexer:
    def __init__(self, text: str) -> None:
        self.text = text
        self.n = len(text)
        self.tokens: list[Token] = []
        self.comments: list[Comment] = []
        self.defined: set[str] = set()

    def run(self) -> None:
        self.code(0, self.n, None)

    def add(self, kind: str, start: int, end: int) -> int:
        if end > start:
            self.tokens.append(Token(kind, self.text[start:end], start, end))
        return end

    def code(self, i: int, n: int, closer: str | None) -> int:
        """Lex from i; with a closer (of an interpolation hole) stop at it on the outer level and return its position."""
        text, depth, fresh = self.text, 0, closer is None
        branches: list[tuple[bool, bool]] = []
        while i < n:
            ch = text[i]
            if ch in _BREAKS:
                fresh = closer is None
                i += 1
                continue
            if ch.isspace() or ch == "﻿":
                i += 1
                continue
            if ch == "#" and fresh:
                i = self.directive(i, branches)
                continue
            if ch == "/" and text.startswith("//", i):
                end = self.line_end(i)
                self.comments.append(Comment(i, end, fresh and text.startswith("///", i) and not text.startswith("////", i)))
                i = end
                continue
            if ch == "/" and text.startswith("/*", i):
                end = text.find("*/", i + 2)
                end = n if end < 0 else end + 2
                doc = fresh and text.startswith("/**", i) and not text.startswith(("/***", "/**/"), i)
                self.comments.append(Comment(i, end, doc))
                i = end
                continue
            fresh = False
            if ch in '"$@' and (m := _STRING_START.match(text, i)):
                i = self.string(i, m.end(), m[0])
            elif ch == "'":
                i = self.character(i)
            elif (m := _WORD.match(text, i)) or (ch.isdigit() or ch == "." and text[i + 1 : i + 2].isdigit()) and (m := _NUMBER.match(text, i)):
                i = self.add(NUMBER if m[0][0].isdigit() or m[0][0] == "." else WORD, i, m.end())
            else:
                if closer is not None and depth == 0 and ch in closer and not text.startswith("::", i):
                    return i
                op = next((o for o in _OPERATORS if text.startswith(o, i)), ch)
                if op == "?." and text[i + 2 : i + 3].isdigit():
                    op = "?"
                depth += (op in "([{" and len(op) == 1) - (op in ")]}" and len(op) == 1)
                i = self.add(PUNCTUATION, i, i + len(op))
        return i

    def line_end(self, i: int) -> int:
        m = _BREAK.search(self.text, i)
        return m.start() if m else self.n

    def character(self, i: int) -> int:
        j = i + 1
        while j < self.n and self.text[j] not in "'" + _BREAKS:
            j += 2 if self.text[j] == "\\" else 1
        return self.add(CHAR, i, min(self.n, j + (j < self.n and self.text[j] == "'")))

    def string(self, i: int, body: int, start: str) -> int:
        """A string of any form; an interpolated one comes out as its pieces and the tokens of its holes."""
        text = self.text
        quotes, dollars, verbatim = start.count('"'), start.count("$"), "@" in start
        if quotes >= 3 and not verbatim:
            return self.raw(i, body, quotes, dollars)
        if quotes == 2 and not dollars:  # empty
            if verbatim and text.startswith('""', body - 2):
                return self.verbatim(i, body - 1) if quotes > 2 else self.add(STRING, i, body)
            return self.add(STRING, i, body)
        if verbatim and not dollars:
            return self.verbatim(i, body - quotes + 1)
        if not dollars:
            j = body
            while j < self.n and text[j] not in '"' + _BREAKS:
                j += 2 if text[j] == "\\" else 1
            return self.add(STRING, i, min(self.n, j + (j < self.n and text[j] == '"')))
        j = self.add(STRING, i, i + len(start) - quotes + 1)
        part = j
        while j < self.n:
            ch = text[j]
            if ch == '"':
                if verbatim and text.startswith('""', j):
                    j += 2
                    continue
                self.add(STRING, part, j)
                return self.add(STRING, j, j + 1)
            if ch in "{}" and text.startswith(ch * 2, j):
                j += 2
            elif ch == "{":
                self.add(STRING, part, j)
                j = part = self.hole(j, 1)
            elif ch in _BREAKS and not verbatim:
                break
            else:
                j += 2 if ch == "\\" and not verbatim else 1
        return self.add(STRING, part, min(j, self.n))

    def verbatim(self, i: int, j: int) -> int:
        while j < self.n:
            if self.text[j] == '"':
                if not self.text.startswith('""', j):
                    return self.add(STRING, i, j + 1)
                j += 1
            j += 1
        return self.add(STRING, i, self.n)

    def raw(self, i: int, body: int, quotes: int, dollars: int) -> int:
        close = '"' * quotes
        if not dollars:
            end = self.text.find(close, body)
            if end < 0:
                return self.add(STRING, i, self.n)
            end += quotes
            while self.text.startswith('"', end):
                end += 1
            return self.add(STRING, i, end)
        j = part = self.add(STRING, i, body)
        while j < self.n:
            if self.text.startswith(close, j):
                self.add(STRING, part, j)
                end = j + quotes
                while self.text.startswith('"', end):
                    end += 1
                return self.add(STRING, j, end)
            if self.text[j] == "{":
                run = 1
                while self.text.startswith("{", j + run):
                    run += 1
                if run >= dollars:
                    j += run - dollars
                    self.add(STRING, part, j)
                    j = part = self.hole(j, dollars)
                else:
                    j += run
            else:
                j += 1
        return self.add(STRING, part, self.n)

    def hole(self, i: int, braces: int) -> int:
        """{expression[,alignment][:format]}"""
        j = self.code(self.add(PUNCTUATION, i, i + braces), self.n, "}:")
        if self.text.startswith(":", j):
            end = self.text.find("}", j)
            end = self.n if end < 0 else end
            self.add(PUNCTUATION, j, j + 1)
            self.add(STRING, j + 1, end)
            j = end
        return self.add(PUNCTUATION, j, min(self.n, j + braces))

    # conditional compilation

    def directive(self, i: int, branches: list[tuple[bool, bool]]) -> int:
        end = self.line_end(i)
        word, _, rest = self.text[i + 1 : end].strip().partition(" ")
        rest = rest.split("//")[0].strip()
        if word == "define":
            self.defined.add(rest)
        elif word == "undef":
            self.defined.discard(rest)
        elif word == "if":
            return self.branch(end, branches, self.holds(rest), False)
        elif word in ("elif", "else") and branches:
            taken = branches[-1][1]
            branches.pop()
            return self.branch(end, branches, not taken and (word == "else" or self.holds(rest)), taken)
        elif word == "endif" and branches:
            branches.pop()
        return end

    def branch(self, i: int, branches: list[tuple[bool, bool]], active: bool, taken: bool) -> int:
        branches.append((active, taken or active))
        if active:
            return i
        depth = 0  # skip to the directive that ends this branch
        while i < self.n:
            m = _BREAK.search(self.text, i)
            if not m:
                return self.n
            i = m.end()
            line = self.text[i : self.line_end(i)].lstrip()
            if line.startswith("#"):
                word = re.match(r"#\s*(\w*)", line)[1]
                if word == "if":
                    depth += 1
                elif depth == 0 and word in ("elif", "else", "endif"):
                    return i + self.text[i:].index("#")
                elif word == "endif":
                    depth -= 1
        return self.n

    def holds(self, condition: str) -> bool:
        terms = re.findall(r"\w+|&&|\|\||==|!=|[!()]", condition)
        at = 0

        def either() -> bool:
            nonlocal at
            value = both()
            while at < len(terms) and terms[at] == "||":
                at += 1
                value = both() or value
            return value

        def both() -> bool:
            nonlocal at
            value = equal()
            while at < len(terms) and terms[at] == "&&":
                at += 1
                value = equal() and value
            return value

        def equal() -> bool:
            nonlocal at
            value = one()
            while at < len(terms) and terms[at] in ("==", "!="):
                same = terms[at] == "=="
                at += 1
                value = (value == one()) == same
            return value

        def one() -> bool:
            nonlocal at
            if at >= len(terms):
                return False
            term = terms[at]
            at += 1
            if term == "!":
                return not one()
            if term == "(":
                value = either()
                at += 1
                return value
            return term == "true" or term in self.defined

        return either()


def lex(text: str) -> Lexed:
    """Tokens and comments of a file; directives and the text that they disable are neither. Broken text lexes to its end."""
    lexer = _Lexer(text)
    lexer.run()
    starts = [0, *(m.end() for m in _BREAK.finditer(text))]
    return Lexed(lexer.tokens, lexer.comments, starts, len(text))


def line_facts(text: str, lexed: Lexed) -> dict[str, int]:
    """The seven line counters of a file."""
    code, comment, documentation = set(), set(), set()
    for t in lexed.tokens:
        code.update(lexed.lines(t.start, t.end))
    for c in lexed.comments:
        lines = lexed.lines(c.start, c.end)
        comment.update(lines)
        if c.documentation:
            documentation.update(lines)
    total = len(lexed.line_starts)
    ends = [*lexed.line_starts[1:], len(text)]
    blank = sum(1 for n, (a, b) in enumerate(zip(lexed.line_starts, ends), 1) if n not in code and n not in comment and not text[a:b].strip())
    return {
        "lines_of_code": total,
        "token_line_count": len(code),
        "blank_line_count": blank,
        "comment_only_line_count": len(comment - code),
        "commented_line_count": len(comment),
        "mixed_code_comment_line_count": len(comment & code),
        "documentation_comment_line_count": len(documentation),
    }


def duplication_tokens(text: str) -> tuple[list[str], list[int], list[int]]:
    """Tokens for duplication: kind and text, with first and last line."""
    lexed = lex(text)
    return (
        [f"{t.kind}\0{t.text}" for t in lexed.tokens],
        [lexed.line(t.start) for t in lexed.tokens],
        [lexed.line(t.end) for t in lexed.tokens],
    )
