import pytest

from orefold.frontend.declarations import parse_file
from orefold.frontend.lexer import lex, line_facts


def flow_of(*lines):
    """Control flow of a method with these lines as its body."""
    inside = "\n".join(f"            {line}" for line in lines)
    parsed = parse_file(f"namespace Depot {{\n    static class Shelf {{\n        static object Sort(Box box, List<Box> boxes, string label) {{\n{inside}\n        }}\n    }}\n}}\n")
    (member,) = (m for t in parsed.types for m in t.members)
    return member.flow


# decisions that each snippet adds to the one way through a method
DECISIONS = {
    "return box;": 0,
    "if (box.IsOpen) return null; return box;": 1,
    "if (box.Weight > 40) Heavy(box); else if (box.Weight > 20) Medium(box); else Light(box);": 2,
    "for (var at = 0; at < boxes.Count; at += 2) Move(boxes[at]);": 1,
    "foreach (var other in boxes) Move(other);": 1,
    "foreach (var (key, crate) in Pairs()) Move(crate);": 1,
    "while (queue.TryPop(out var next)) Move(next);": 1,
    "do { box = box.Inner; } while (box.Inner is { } inner);": 2,
    'switch (label) { case "red": case "blue": Paint(); break; case "none": break; default: throw new LabelException(); }': 3,
    "switch (box) { case Crate { Wood: true } c when c.Age > 3: Burn(c); break; }": 2,
    'return box.Size switch { 0 => "none", < 5 => "small", _ => "large" };': 3,
    "try { Open(box); } catch (JammedException) { Force(box); } finally { Lock(box); }": 1,
    "try { Open(box); } catch (JammedException e) when (e.Tries < 3) { Force(box); }": 2,
    "var fits = box.Width < 3 && box.Height < 4 && !box.IsOpen;": 2,
    "var odd = box.IsOpen || boxes.Any();": 1,
    'var name = label ?? box.Name ?? "?";': 2,
    "var side = box.IsOpen ? Side.Top : Side.Bottom;": 1,
    "var middle = box.Weight is >= 10 and <= 20;": 2,
    "var extreme = box.Weight is < 10 or > 20;": 2,
    "var full = box is { Weight: 40 };": 1,
    "var either = box is Crate or Barrel;": 1,
    "var crate = box as Crate; var known = box is Crate; var held = box is not null; label ??= box?.Name; lock (boxes) { boxes.Clear(); }": 0,
    "Func<Box, bool> wide = b => { if (b.Width > 9) return true; return false; };": 1,
    "bool Wide(Box b) => b.Width > 9 || b.IsOpen; return Wide(box);": 1,
    'var text = $"{(box.IsOpen ? "open" : "shut")} {{ while }} {box.Weight:a?b:c}";': 1,
    'var raw = """ while (a || b) "x" """; var path = @"c:\\""if"" && d";': 0,
}


@pytest.mark.parametrize(("body", "decisions"), DECISIONS.items())
def test_decisions(body, decisions):
    flow = flow_of(body)
    assert (flow["cyclomatic_complexity"], flow["decision_point_count"]) == (decisions + 1, decisions)


def test_nesting():
    flow = flow_of("foreach (var b in boxes)", "{", "    if (b.IsOpen)", "    {", "        while (b.Weight > 5) b = b.Inner;", "    }", "}", "if (label is null) return null;", "return box;")
    assert flow == {"cyclomatic_complexity": 5, "decision_point_count": 4, "cognitive_complexity": 7, "nesting_depth": 3}


def facts(text):
    return line_facts(text, lex(text))


def test_line_categories():
    text = "\n".join(["// ordinary", "", "/// <summary>", "/// Docs.", "/// </summary>", "public class Sample // mixed", "{", "    public void M() { } /* mixed */", "}"])
    assert list(facts(text).values()) == [9, 4, 1, 4, 6, 2, 3]


def test_lines_of_directives_strings_and_ends():
    assert facts("")["lines_of_code"] == 1 and facts("a;\r\n")["lines_of_code"] == 2 and facts("a;\rb;")["lines_of_code"] == 2
    f = facts('#if NEVER\nint hidden;\n#else\nint seen;\n#endif\nvar s = @"one\n\nthree";\n/* a\n\n b */\n')
    assert (f["token_line_count"], f["commented_line_count"], f["blank_line_count"]) == (4, 3, 1)
    assert facts("//// not documentation\n/***/\n/** doc */\nint x; /// trailing")["documentation_comment_line_count"] == 1


def test_declarations():
    text = """
namespace A.B;
[Attr(1)] public partial class Outer<T, U> : Base where T : class
{
    private readonly int _x = 3, _y;
    public event EventHandler Changed;
    public Outer(int a) : this(a, 2) { }
    ~Outer() { }
    public static Outer<T, U> operator +(Outer<T, U> a, Outer<T, U> b) => a;
    public static implicit operator int(Outer<T, U> a) => 1;
    public int this[int i, string s] { get => i; set { } }
    public string Name { get; set; } = "n";
    public (int A, int B) Pair<V>(Dictionary<int, V> d, params int[] rest) where V : new() => (1, 2);
    partial void Hook();
    public delegate int D(int x);
    enum Kind { One, Two }
    record struct Point(int X, int Y);
    interface IThing { void Do(); }
}
"""
    types = {t.qualified: t for t in parse_file(text).types}
    assert set(types) == {"A.B.Outer`2", "A.B.Outer`2.Kind", "A.B.Outer`2.Point", "A.B.Outer`2.IThing"}
    members = [(m.name, m.kind, m.parameter_count, m.has_body) for m in types["A.B.Outer`2"].members]
    assert members == [
        ("#ctor", "constructor_body", 1, True), ("#dtor", "member_body", 0, True), ("operator +", "member_body", 2, True), ("operator int", "member_body", 1, True), ("this[]", "property_body", 2, True),
        ("Name", "property_body", 0, True), ("Pair", "member_body", 2, True), ("Hook", "member_body", 0, False),
    ]
    assert types["A.B.Outer`2.IThing"].members[0].has_body is False and types["A.B.Outer`2"].namespace == "A.B"


@pytest.mark.parametrize("text", ["class {", "class A { void M( { if (x ", 'var s = "open', "/* open", "}}}}", "class A { int P { get", "#if A\n#if B\n", "public", "switch { =>", '$"{a:', "@", "'", "﻿class A { }"])
def test_broken_text_never_fails(text):
    parse_file(text)
