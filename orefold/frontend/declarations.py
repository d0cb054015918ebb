"""Types and members of a C# file, from its tokens."""

from __future__ import annotations

from dataclasses import dataclass, field

from orefold.frontend.flow import _brackets, control_flow
from orefold.frontend.lexer import PUNCTUATION, WORD, Lexed, Token, lex, line_facts

_MODIFIERS = frozenset(
    "public private protected internal static sealed abstract virtual override readonly partial async extern unsafe new volatile required file ref const fixed implicit explicit event".split()
)
_TYPES = ("class", "struct", "interface", "enum", "record")


@dataclass
class Member:
    name: str
    kind: str
    start_line: int
    end_line: int
    start_column: int
    parameter_count: int
    has_body: bool
    flow: dict[str, int]


@dataclass
class Type:
    name: str
    qualified: str
    namespace: str
    start_line: int
    end_line: int
    start_column: int
    token_lines: int
    members: list[Member] = field(default_factory=list)


@dataclass
class File:
    lines: dict[str, int]
    types: list[Type]


class _Parser:
    def __init__(self, lexed: Lexed) -> None:
        self.lexed = lexed
        self.t = lexed.tokens
        self.match = _brackets(lexed.tokens)
        self.types: list[Type] = []

    def text(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) else ""

    def is_word(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind == WORD

    def skip_attributes(self, i: int) -> int:
        while self.text(i) == "[":
            i = self.match.get(i, len(self.t)) + 1
        return i

    def modifiers(self, i: int) -> tuple[int, set[str]]:
        found = set()
        while self.text(i) in _MODIFIERS and self.is_word(i):
            if self.text(i) in ("file", "required", "partial", "async") and self.text(i + 1) in ("(", ";", "=", "=>", "{"):
                break
            found.add(self.text(i))
            i += 1
        return i, found

    def namespace_members(self, i: int, end: int, namespace: str, owner: str) -> None:
        while i < end:
            s = self.text(i)
            if s == "namespace":
                j = i + 1
                while j < end and self.text(j) not in ("{", ";"):
                    j += 1
                name = "".join(t.text for t in self.t[i + 1 : j])
                full = f"{namespace}.{name}" if namespace else name
                if self.text(j) == "{":
                    close = min(self.match.get(j, end), end)
                    self.namespace_members(j + 1, close, full, full)
                    i = close + 1
                else:
                    self.namespace_members(j + 1, end, full, full)
                    return
            elif s in ("using", "extern", "global"):
                i = self.to_end(i, end)
            else:
                i = max(i + 1, self.declaration(i, end, namespace, owner, None))

    def to_end(self, i: int, end: int) -> int:
        """After the next semicolon or body on this level."""
        while i < end:
            s = self.text(i)
            if s == ";":
                return i + 1
            if s == "{":
                return min(self.match.get(i, end), end) + 1
            i = self.match.get(i, i) + 1 if s in ("(", "[") else i + 1
        return end

    def declaration(self, i: int, end: int, namespace: str, owner: str, parent: Type | None) -> int:
        """One declaration that starts at i: a type with what it contains, or a member of parent."""
        start = i
        i = self.skip_attributes(i)
        i, modifiers = self.modifiers(i)
        i = self.skip_attributes(i)
        s = self.text(i)
        if s in _TYPES and (self.is_word(i + 1)) and not (s == "record" and self.text(i + 1) not in ("class", "struct") and self.text(i + 2) not in ("(", "{", ";", ":", "<") and self.text(i + 2) != "where"):
            return self.type(start, i, end, namespace, owner)
        if s == "delegate" and self.text(i + 1) != "*":
            return self.to_end(i, end)
        if parent is None:
            return self.top_level(i, end)
        return self.member(start, i, end, modifiers, parent)

    def top_level(self, i: int, end: int) -> int:
        """A statement outside of any type; it declares nothing."""
        return self.to_end(i, end)

    def type(self, start: int, i: int, end: int, namespace: str, owner: str) -> int:
        enum = self.text(i) == "enum"
        i += 1
        if self.text(i) in ("class", "struct"):
            i += 1
        name = self.text(i).lstrip("@")
        i += 1
        if self.text(i) == "<":
            depth, arity = 0, 1
            while i < end:
                s = self.text(i)
                depth += (s == "<") - (s.count(">") if set(s) == {">"} else 0)
                arity += s == "," and depth == 1
                i += 1
                if depth <= 0:
                    break
            name += f"`{arity}"
        while i < end and self.text(i) not in ("{", ";"):
            i = self.match.get(i, i) + 1 if self.text(i) in ("(", "[") else i + 1
        close = min(self.match.get(i, end), end) if self.text(i) == "{" else i
        last = min(close, len(self.t) - 1)
        if self.text(close + 1) == ";" and close + 1 < end and self.text(i) == "{":
            last = min(close + 1, len(self.t) - 1)
        qualified = f"{owner}.{name}" if owner else name
        lines = set()
        for t in self.t[start : last + 1]:
            lines.update(self.lexed.lines(t.start, t.end))
        found = Type(name, qualified, namespace, *self.span(start, last), len(lines))
        self.types.append(found)
        if self.text(i) == "{" and not enum:
            k = i + 1
            while k < close:
                k = k + 1 if self.text(k) == ";" else max(k + 1, self.declaration(k, close, namespace, qualified, found))
        return last + 1

    def span(self, first: int, last: int) -> tuple[int, int, int]:
        a, b = self.t[first].start, self.t[last].end
        line = self.lexed.line(a)
        return line, self.lexed.line(b), a - self.lexed.line_starts[line - 1] + 1

    def member(self, start: int, i: int, end: int, modifiers: set[str], parent: Type) -> int:
        header, parens, angle = i, None, 0
        operator_at = indexer_at = None
        while i < end:
            s = self.text(i)
            if s == "operator" and self.is_word(i):
                operator_at = i
                i += 1
                while i < end and self.text(i) != "(":
                    i += 1
                if self.text(i + 1) == ")" and self.text(i + 2) == "(":
                    i += 2  # operator ()
                continue
            if s == "this" and self.text(i + 1) == "[":
                indexer_at = i
                i = self.match.get(i + 1, end) + 1
                continue
            if s == "<":
                angle += 1
            elif s and set(s) == {">"}:
                angle = max(0, angle - len(s))
            elif s == "(" and angle == 0:
                before = self.text(i - 1)
                if parens is None and i > header and (self.is_word(i - 1) and before not in _MODIFIERS or before == ">" or operator_at is not None):
                    parens = i
                i = self.match.get(i, end) + 1
                continue
            elif s == "[":
                i = self.match.get(i, end) + 1
                continue
            elif s in ("{", ";", "=>", "="):
                break
            i += 1
        stop, close = self.text(i), i
        if stop == "{":
            close = min(self.match.get(i, end), end)
            if parens is None and self.text(close + 1) == "=" and close + 1 < end:
                close = self.semicolon(close + 1, end)
        elif stop in ("=>", "="):
            close = self.semicolon(i, end)
        close = min(close, end - 1, len(self.t) - 1)
        after = close + 1
        if "event" in modifiers or "const" in modifiers:
            return after
        head = self.t[header:i]
        count = 0
        if operator_at is not None:
            conversion = bool({"implicit", "explicit"} & modifiers) or self.text(operator_at - 1) in ("implicit", "explicit")
            upto = parens if parens is not None else operator_at + 2
            name = "operator " + "".join(t.text for t in self.t[operator_at + 1 : upto]) if not conversion else "operator " + " ".join(t.text for t in self.t[operator_at + 1 : upto])
            kind = "member_body"
        elif indexer_at is not None:
            name, kind, parens = "this[]", "property_body", indexer_at + 1
        elif head and head[0].text == "~":
            name, kind = "#dtor", "member_body"
        elif parens is not None:
            k = parens - 1
            if set(self.text(k)) == {">"}:
                depth = 0
                while k > header:
                    s = self.text(k)
                    depth += (s.count(">") if s and set(s) == {">"} else 0) - (s == "<")
                    k -= 1
                    if depth <= 0:
                        break
            name = self.text(k).lstrip("@")
            kind = "member_body"
            if k == header and name == parent.name.partition("`")[0]:
                name, kind = "#ctor", "constructor_body"
            elif k == header:
                return after  # no type in front: not a declaration
        elif stop in ("{", "=>") and len(head) >= 2 and head[-1].kind == WORD:
            name, kind = head[-1].text.lstrip("@"), "property_body"
        else:
            return after
        if parens is not None:
            count = self.parameters(parens)
        tokens = self.t[start : close + 1]
        parent.members.append(Member(name, kind, *self.span(start, close), count, stop != ";", control_flow(tokens)))
        return after

    def semicolon(self, i: int, end: int) -> int:
        while i < end and self.text(i) != ";":
            i = self.match.get(i, i) + 1 if self.text(i) in ("(", "[", "{") else i + 1
        return i

    def parameters(self, i: int) -> int:
        close = self.match.get(i, len(self.t))
        if close == i + 1:
            return 0
        count, angle, k = 1, 0, i + 1
        while k < close:
            s = self.text(k)
            if s in ("(", "[", "{"):
                k = self.match.get(k, close)
            elif s == "<":
                angle += 1
            elif s and set(s) == {">"}:
                angle = max(0, angle - len(s))
            elif s == "," and angle == 0 and self.t[k].kind == PUNCTUATION:
                count += 1
            k += 1
        return count


def parse_file(text: str) -> File:
    """Line counters, types and members of one file; text that isn't valid C# yields what can be told from its brackets."""
    text = text.removeprefix("﻿")
    lexed = lex(text)
    parser = _Parser(lexed)
    parser.namespace_members(0, len(lexed.tokens), "", "")
    return File(line_facts(text, lexed), parser.types)


def tokens_of(text: str) -> list[Token]:
    return lex(text).tokens
