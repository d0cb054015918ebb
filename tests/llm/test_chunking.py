import datetime as dt
import math
import random

from orefold.llm.chunking import bisect_text, split_oversized

SCHEMA = "chunk_id string, snapshot_no int, start_line int, end_line int, token_estimate int, text string, delivered_at timestamp, n_tokens string, chunk_kind string"


def units(s):
    return len(s.encode("utf-16-le")) // 2


def lines_of(text):
    return text.replace("\r\n", "\n").replace("\r", "\n").count("\n")


def check(text, limit=512):
    pieces = bisect_text(text, limit)
    assert pieces[0][0] == pieces[0][1] == 0 and pieces[-1][2] == len(text)
    for (s1, c1, e1, _), (s2, c2, e2, shared) in zip(pieces, pieces[1:]):
        assert e1 == c2 and c1 < c2 and s1 <= s2 < c2
        part = text[s2:c2]
        if shared:
            assert lines_of(part) == shared and text[c2 - 1] in "\r\n"
        else:
            assert units(part) <= 128
    for s, _, e, _ in pieces:
        assert math.ceil(units(text[s:e]) / 4) <= limit
        assert not (text[e - 1 : e + 1] == "\r\n" and e < len(text))
    assert "".join(text[c:e] for _, c, e, _ in pieces) == text
    return pieces


def test_texts_of_all_kinds():
    rng = random.Random(4)
    code = "".join(f"    int v{i} = {i};\n" + ("\n" if i % 9 == 0 else "") for i in range(900))
    for text in ("a", "", "x" * 2048, "x" * 2049, "x" * 50000, "😀" * 9000, "word " * 9000, code, code.replace("\n", "\r\n"), code.replace("\n", "\r"), "\n" * 9000, "\r\n" * 9000, ("y" * 1500 + "\n") * 9, ("z" * 5000 + "\n") * 3):
        check(text)
    for _ in range(150):
        check("".join(rng.choice(["a" * rng.randint(1, 40), "\n", "\r\n", "\n\n", "}\n", "; ", "😀", " "]) for _ in range(rng.randint(1, 400))), rng.choice([16, 64, 512]))


def test_cuts_are_at_blank_lines_and_share_two_lines():
    text = "".join("".join(f"line {b} {i} of a block of text;\n" for i in range(20)) + "}\n\n" for b in range(12))
    pieces = check(text)
    assert len(pieces) > 2
    for _, c, _, shared in pieces[1:]:
        assert text[:c].endswith("\n\n") and shared == 2


def test_two_lines_are_shared_whatever_their_length():
    for tokens, lines in ((40, 2), (100, 2), (150, 2), (170, 2), (200, 1), (250, 1), (300, 0), (479, 0)):
        text = "".join(f"{n:04d}" + "x" * (tokens * 4 - 5) + "\n" for n in range(40))
        pieces = check(text)
        assert all(c % (tokens * 4) == 0 for _, c, _, _ in pieces)  # no cut inside a line that fits
        assert {min(n, c // (tokens * 4), lines) for _, c, _, n in pieces[2:]} == {lines}, tokens
    assert all(shared == 0 for *_, shared in check(("x" * 2039 + "\n") * 9)[1:])  # single lines that are themselves too large


def test_cuts_are_after_whole_blocks():
    method = "    public int M{0}(int a)\n    {{\n        if (a > {0})\n        {{\n            a++;\n        }}\n\n        while (a < 9)\n        {{\n            a *= 2;\n        }}\n        return a;\n    }}\n\n"
    text = "public class Sample\n{\n" + "".join(method.format(n) for n in range(40)) + "}\n"
    for _, c, _, _ in check(text)[1:]:
        assert text[:c].endswith("    }\n\n") and text[c:].startswith(("    public", "}"))


def test_an_estimate_of_any_size(spark):
    out = rows(spark, [("wrong", 1, 1, 3, 200_000, None, None), ("many lines", 1, 1, 90_000, 600, None, None), ("long lines", 1, 1, 10, 2000, None, None)]).collect()
    for name, size in (("wrong", 200_000), ("many lines", 600), ("long lines", 2000)):
        own = sorted((r for r in out if r.chunk_id == name), key=lambda r: r.piece_no)
        assert sum(r.n_tokens - r.shared_tokens for r in own) == size and max(r.n_tokens for r in own) <= 512 and all(r.shared_tokens for r in own[1:])
    assert {r.shared_lines for r in out if r.chunk_id == "many lines" and r.piece_no} == {2}


def rows(spark, data):
    return split_oversized(spark.createDataFrame([(*d, None, "member_body") for d in data], SCHEMA))


def test_operator(spark):
    t1, t2 = dt.datetime(2031, 1, 1), dt.datetime(2031, 1, 2)
    long = "".join(f"line {i};\n" for i in range(600))
    data = [
        ("big", 1, 10, 609, 1, long, t1), ("big", 1, 10, 609, 1, long, t1), ("shrunk", 1, 1, 2, 9999, long, t1), ("shrunk", 1, 1, 2, 9999, "small", t2), ("edge", 1, 1, 1, 9999, "x" * 2048, t1), ("over", 1, 1, 1, None, "x" * 2049, t1),
        ("null", 1, 5, 104, 1500, None, t1), ("one line", 1, 5, None, 1500, None, t1), ("odd", 2, None, -3, 600, None, None), ("neither", 1, 1, 1, None, None, t1), ("empty", 1, 1, 1, 9999, "", t1), (None, 1, 1, 1, 600, None, t1),
    ]
    out = rows(spark, data).collect()
    by = {}
    for r in sorted(out, key=lambda r: (r.chunk_id or "", r.piece_no)):
        by.setdefault(r.chunk_id, []).append(r)
        assert 0 < r.n_tokens <= 512 and r.start_line <= r.end_line
    assert set(by) == {"big", "over", "null", "one line", "odd", None}
    big = by["big"]
    assert [r.piece_no for r in big] == list(range(big[0].n_pieces)) and big[0].start_line == 10 and big[-1].end_line == 609
    assert all(b.start_line == a.end_line - 1 and b.shared_lines == 2 for a, b in zip(big, big[1:]))
    assert all(r.text == "\n".join(long.split("\n")[r.start_line - 10 : r.end_line - 9]) + "\n" for r in big)
    assert all(b.start_line == a.end_line - 1 and b.shared_lines == 2 for a, b in zip(by["null"], by["null"][1:])) and by["null"][-1].end_line == 104
    assert all(r.chunk_kind == "member_body" for r in out)
    assert all(r.shared_tokens == 32 and r.start_line == 5 for r in by["one line"][1:])


def test_empty_table(spark):
    assert rows(spark, []).collect() == []
