"""Decisions, cognitive complexity and nesting of a member, from its tokens."""

from __future__ import annotations

from orefold.frontend.lexer import CHAR, NUMBER, PUNCTUATION, STRING, WORD, Token

_OPEN = {"(": ")", "[": "]", "{": "}"}
_PREDEFINED = frozenset("bool byte sbyte short ushort int uint long ulong float double decimal char string object nint nuint void dynamic".split())
_CONSTANTS = frozenset("null true false default".split())
_PATTERN_WORDS = frozenset(("and", "or", "not", "when"))
_LOOPS = frozenset(("for", "foreach", "while"))
_ENDS = frozenset(("&&", "||", "??", "?", ":", "=>", ",", ";", ")", "]", "}", "==", "!=", "="))


class Flow:
    """Walks statements and expressions once; every method returns the index after what it has read."""

    def __init__(self, tokens: list[Token]) -> None:
        self.t = tokens
        self.match = _brackets(tokens)
        self.decisions = self.cognitive = self.nesting = 0

    def text(self, i: int) -> str:
        return self.t[i].text if i < len(self.t) else ""

    def word(self, i: int) -> bool:
        return i < len(self.t) and self.t[i].kind == WORD

    def decide(self, depth: int | None = None) -> None:
        """One decision; a structural one also costs the depth it is at."""
        self.decisions += 1
        self.cognitive += 1 + (depth or 0)

    def deeper(self, depth: int) -> int:
        self.nesting = max(self.nesting, depth + 1)
        return depth + 1

    # statements

    def block(self, i: int, end: int, depth: int) -> None:
        while i < end:
            i = max(i + 1, self.statement(i, end, depth))

    def statement(self, i: int, end: int, depth: int) -> int:
        if i >= end:
            return end
        s = self.text(i)
        if s == "{":
            close = min(self.match.get(i, end), end)
            self.block(i + 1, close, depth)
            return close + 1
        if s == ";":
            return i + 1
        if s == "await" and self.text(i + 1) == "foreach":
            i, s = i + 1, "foreach"
        if s == "if":
            self.decide(depth)
            inner = self.deeper(depth)
            i = self.statement(self.header(i + 1, end, inner), end, inner)
            return self.statement(i + 1, end, inner) if i < end and self.text(i) == "else" else i
        if s in _LOOPS and self.text(i + 1) == "(":
            self.decide(depth)
            inner = self.deeper(depth)
            return self.statement(self.header(i + 1, end, inner), end, inner)
        if s == "do":
            self.decide(depth)
            inner = self.deeper(depth)
            i = self.statement(i + 1, end, inner)
            if self.text(i) == "while":
                i = self.header(i + 1, end, inner)
            return i + (self.text(i) == ";")
        if s == "switch" and self.text(i + 1) == "(":
            inner = self.deeper(depth)
            i = self.header(i + 1, end, inner)
            if self.text(i) == "{":
                close = min(self.match.get(i, end), end)
                self.sections(i + 1, close, inner)
                return close + 1
            return i
        if s == "catch":
            self.decide(depth)
            inner = self.deeper(depth)
            i += 1
            if self.text(i) == "(":
                i = self.match.get(i, end) + 1
            if self.text(i) == "when":
                self.decide()
                i = self.header(i + 1, end, inner)
            return self.statement(i, end, inner)
        if s in ("try", "finally", "else", "unsafe", "checked", "unchecked") and self.text(i + 1) == "{":
            return self.statement(i + 1, end, depth)
        if s in ("using", "lock", "fixed") and self.text(i + 1) == "(":
            return self.statement(self.header(i + 1, end, depth), end, depth)
        if self.word(i) and s not in ("case", "default") and self.text(i + 1) == ":" and self.text(i + 2) != ":":
            return self.statement(i + 2, end, depth)  # a label
        return self.until(i, end, depth, (";",)) + 1

    def header(self, i: int, end: int, depth: int) -> int:
        """A parenthesised part."""
        if self.text(i) != "(":
            return i
        close = min(self.match.get(i, end), end)
        self.expression(i + 1, close, depth)
        return close + 1

    def sections(self, i: int, end: int, depth: int) -> None:
        while i < end:
            s = self.text(i)
            if s == "case":
                self.decide(depth)
                i, _, _ = self.pattern(i + 1, end)
                if self.text(i) == "when":
                    self.decide()
                    i = self.until(i + 1, end, depth, (":",))
                elif self.text(i) != ":":
                    i = self.until(i, end, depth, (":",))
                i += 1
            elif s == "default" and self.text(i + 1) == ":":
                i += 2
            else:
                i = max(i + 1, self.statement(i, end, depth))

    # expressions

    def until(self, i: int, end: int, depth: int, stops: tuple[str, ...]) -> int:
        """Read an expression up to a stop on its own level; a body in braces that follows a parameter list also ends it."""
        start = i
        while i < end:
            s = self.text(i)
            if s in stops and self.t[i].kind == PUNCTUATION:
                return i
            if s == "{" and ";" in stops and i > start and self.text(i - 1) == ")" and self.is_block(i) and not self.lambda_before(i, start):
                close = self.match.get(i, end)
                self.block(i + 1, min(close, end), depth)  # a local function
                return close
            i = self.step(i, end, depth)
        return end

    def lambda_before(self, i: int, start: int) -> bool:
        return any(self.text(k) in ("=>", "=", "delegate", "new", "return") for k in range(start, i))

    def expression(self, i: int, end: int, depth: int) -> None:
        while i < end:
            i = self.step(i, end, depth)

    def step(self, i: int, end: int, depth: int) -> int:
        s, kind = self.text(i), self.t[i].kind
        if kind == PUNCTUATION:
            if s in ("&&", "||", "??"):
                self.decide()
            elif s == "?" and (colon := self.conditional(i, end)):
                self.decide(depth)
                inner = self.deeper(depth)
                self.expression(i + 1, colon, inner)
                stop = self.end_of_branch(colon + 1, end)
                self.expression(colon + 1, stop, inner)
                return stop
            elif s in _OPEN:
                close = min(self.match.get(i, end), end)
                (self.block if s == "{" and self.is_block(i) else self.expression)(i + 1, close, depth)
                return close + 1
            return i + 1
        if s == "is" and kind == WORD:
            j, telling, _ = self.pattern(i + 1, end)
            if telling:
                self.decide()
            return max(j, i + 1)
        if s == "switch" and kind == WORD and self.text(i + 1) == "{":
            inner = self.deeper(depth)
            close = min(self.match.get(i + 1, end), end)
            self.arms(i + 2, close, inner)
            return close + 1
        return i + 1

    def arms(self, i: int, end: int, depth: int) -> None:
        while i < end:
            if self.text(i) == ",":
                i += 1
                continue
            self.decide(depth)
            inner = self.deeper(depth)
            i, _, _ = self.pattern(i, end)
            if self.text(i) == "when":
                self.decide()
                i = self.until(i + 1, end, inner, ("=>",))
            elif self.text(i) != "=>":
                i = self.until(i, end, inner, ("=>",))
            i = self.until(i + 1, end, inner, (",",)) + 1

    def is_block(self, i: int) -> bool:
        """Whether braces hold statements rather than an initialiser: some semicolon on their level, or a leading statement."""
        close = self.match.get(i, len(self.t))
        k = i + 1
        while k < close:
            s = self.text(k)
            if s == ";" or s in ("if", "for", "foreach", "while", "do", "try", "lock", "using") and self.t[k].kind == WORD:
                return True
            k = self.match.get(k, k) + 1 if s in _OPEN else k + 1
        return False

    def conditional(self, i: int, end: int) -> int | None:
        """The colon of a conditional expression; None if the question mark belongs to a nullable type."""
        nxt = self.text(i + 1)
        if nxt in (")", ">", ",", ";", "=", "]", "}", "[", "?") and not (nxt == "[" and self.t[i].end < self.t[i + 1].start):
            return None
        if self.word(i + 1) and self.text(i + 2) in ("=", ";", ",", ")", "{", "=>") or self.word(i + 1) and self.text(i + 1) in ("in", "and", "or"):
            return None
        k, open_ = i + 1, 0
        while k < end:
            s = self.text(k)
            if self.t[k].kind == PUNCTUATION:
                if s in _OPEN:
                    k = self.match.get(k, end)
                elif s in (")", "]", "}", ";") or s == "," and open_ == 0:
                    return None
                elif s == "?" and (inner := self.conditional(k, end)):
                    k = inner
                elif s == ":":
                    return k
            k += 1
        return None

    def end_of_branch(self, i: int, end: int) -> int:
        while i < end:
            s = self.text(i)
            if self.t[i].kind == PUNCTUATION:
                if s in (",", ";", ")", "]", "}"):
                    return i
                if s == ":":
                    return i
                if s == "?" and (colon := self.conditional(i, end)):
                    i = colon
                elif s in _OPEN:
                    i = self.match.get(i, end)
            i += 1
        return end

    # patterns

    def pattern(self, i: int, end: int) -> tuple[int, bool, bool]:
        """(index after it, whether it holds a relational, type, declaration or recursive part, whether it is more than a constant)."""
        i, telling, more = self.primary_pattern(i, end)
        while i < end and self.text(i) in ("and", "or"):
            self.decide()
            i, t, _ = self.primary_pattern(i + 1, end)
            telling, more = telling or t, True
        return i, telling, more

    def primary_pattern(self, i: int, end: int) -> tuple[int, bool, bool]:
        if i >= end:
            return end, False, False
        s, kind = self.text(i), self.t[i].kind
        if s == "not" and kind == WORD:
            j, telling, _ = self.primary_pattern(i + 1, end)
            return j, telling, True
        if s in ("<", "<=", ">", ">="):
            return self.operand(i + 1, end), True, True
        if s == "(":
            close = min(self.match.get(i, end), end)
            telling, parts = self.subpatterns(i + 1, close)
            j, named = self.designator(close + 1, end)
            return j, telling or parts != 1 or named, True
        if s == "{":
            close = min(self.match.get(i, end), end)
            self.subpatterns(i + 1, close)
            return self.designator(close + 1, end)[0], True, True
        if s == "[":
            close = min(self.match.get(i, end), end)
            telling, _ = self.subpatterns(i + 1, close)
            return self.designator(close + 1, end)[0], telling, True
        if s == ".." :
            return self.primary_pattern(i + 1, end) if self.text(i + 1) not in (",", "]", "") else (i + 1, False, True)
        if s == "var" and kind == WORD and self.word(i + 1):
            return i + 2, False, True
        if kind in (STRING, NUMBER, CHAR) or s in ("-", "+", "~") or s in _CONSTANTS or s in ("typeof", "nameof", "sizeof"):
            return self.operand(i, end), False, False
        if kind == WORD:
            return self.type_pattern(i, end)
        return i, False, False

    def type_pattern(self, i: int, end: int) -> tuple[int, bool, bool]:
        plain = self.text(i) not in _PREDEFINED
        j = i + 1
        while j < end:
            s = self.text(j)
            if s in (".", "::") and self.word(j + 1):
                j += 2
            elif s == "<" and (k := self.generic(j, end)):
                j = k
            elif s == "[" and self.text(j + 1) in ("]", ","):
                j, plain = self.match.get(j, j) + 1, False
            elif s == "?" and self.text(j + 1) in (")", ";", "&&", "||", "and", "or"):
                j, plain = j + 1, False
            else:
                break
        s = self.text(j) if j < end else ""
        if s in ("{", "("):
            close = min(self.match.get(j, end), end)
            self.subpatterns(j + 1, close)
            j = close + 1
            if j < end and self.text(j) == "{":
                close = min(self.match.get(j, end), end)
                self.subpatterns(j + 1, close)
                j = close + 1
            return self.designator(j, end)[0], True, True
        after, named = self.designator(j, end)
        if named:
            return after, True, True
        if s and s not in _ENDS and s not in _PATTERN_WORDS:
            j = self.operand(j, end)  # a constant expression
        return j, not plain, not plain

    def designator(self, i: int, end: int) -> tuple[int, bool]:
        if i < end and self.word(i) and self.text(i) not in _PATTERN_WORDS and self.text(i) not in ("is", "as", "switch", "with"):
            return i + 1, True
        return i, False

    def generic(self, i: int, end: int) -> int | None:
        depth = 0
        for k in range(i, min(end, i + 64)):
            s = self.text(k)
            depth += (s == "<") - s.count(">") * (set(s) == {">"})
            if depth <= 0:
                return k + 1
            if not (self.word(k) or s in ("<", ">", ",", ".", "?", "[", "]", "(", ")", "::") or set(s) == {">"}):
                return None
        return None

    def subpatterns(self, i: int, end: int) -> tuple[bool, int]:
        telling, parts = False, 0
        while i < end:
            if self.text(i) == ",":
                i += 1
                continue
            parts += 1
            k = i  # Name.Name: pattern
            while self.word(k) and self.text(k + 1) == ".":
                k += 2
            if self.word(k) and self.text(k + 1) == ":":
                i = k + 2
            j, t, _ = self.pattern(i, end)
            telling = telling or t
            while j < end and self.text(j) != ",":
                j = self.match.get(j, j) + 1 if self.text(j) in _OPEN else j + 1
            i = max(j, i + 1)
        return telling, parts

    def operand(self, i: int, end: int) -> int:
        while i < end:
            s, kind = self.text(i), self.t[i].kind
            if kind == PUNCTUATION and s in _ENDS or kind == WORD and s in _PATTERN_WORDS:
                return i
            i = self.match.get(i, i) + 1 if s in _OPEN and kind == PUNCTUATION else i + 1
        return end


def _brackets(tokens: list[Token]) -> dict[int, int]:
    """Index of the closing bracket of each opening one; unclosed ones end with the tokens."""
    out: dict[int, int] = {}
    stack: list[int] = []
    for i, t in enumerate(tokens):
        if t.kind != PUNCTUATION:
            continue
        if t.text[0] == "{" or t.text in _OPEN:
            stack.append(i)
        elif t.text[0] == "}" or t.text in ")]":
            for k in range(len(stack) - 1, -1, -1):
                if _OPEN[tokens[stack[k]].text[0]] == t.text[0]:
                    for open_ in stack[k + 1 :]:
                        out[open_] = i
                    out[stack[k]] = i
                    del stack[k:]
                    break
    for i in stack:
        out[i] = len(tokens)
    return out


def control_flow(tokens: list[Token]) -> dict[str, int]:
    """The measures of one declaration, given as its tokens from the first modifier to the end of its body."""
    flow = Flow(tokens)
    i, end = 0, len(tokens)
    while i < end:  # header, then a body in braces, an expression body, or both accessors and an initialiser
        s = flow.text(i)
        if s == "{":
            close = flow.match.get(i, end)
            accessors(flow, i + 1, close)
            i = close + 1
        elif s == "[":
            i = flow.match.get(i, end) + 1
        elif s == "(":
            close = flow.match.get(i, end)
            flow.expression(i + 1, close, 0)
            i = close + 1
        elif s in ("=>", "="):
            flow.until(i + 1, end, 0, (";",))
            break
        else:
            i += 1
    return {
        "cyclomatic_complexity": 1 + flow.decisions,
        "decision_point_count": flow.decisions,
        "cognitive_complexity": flow.cognitive,
        "nesting_depth": flow.nesting,
    }


def accessors(flow: Flow, i: int, end: int) -> None:
    """Statements, or the bodies of get, set, init, add and remove."""
    while i < end:
        if flow.text(i) in ("get", "set", "init", "add", "remove", "private", "protected", "internal", "readonly") and flow.text(i + 1) in ("{", "=>", ";", "get", "set", "init", "internal", "protected"):
            if flow.text(i + 1) == "=>":
                i = flow.until(i + 2, end, 0, (";",)) + 1
            else:
                i += 1
        else:
            i = max(i + 1, flow.statement(i, end, 0))
