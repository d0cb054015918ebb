import base64
import random

import pytest

from orefold.llm.tokenizer import TOKENIZER_DIR, VOCABULARY, Encoder, encode_column

tiktoken = pytest.importorskip("tiktoken")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@pytest.fixture(scope="module")
def both():
    path = f"{TOKENIZER_DIR}/{VOCABULARY}"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return Encoder(path), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def check(both, texts):
    own, other = both
    ids, counts = own.encode(texts)
    assert list(own.count(texts)) == list(counts)
    at = 0
    for text, n in zip(texts, counts):
        assert list(ids[at : at + n]) == other.encode_ordinary(text), repr(text[:80])
        assert own.decode(ids[at : at + n]) == text
        at += n
    assert at == len(ids)


def test_random_texts(both):
    rng = random.Random(1)
    alphabet = ["a", "b", "'", "s", "d", "t", "re", "ve", "m", "ll", " ", " ", "1", "\n", "\t", "é", "!", "漢", "😀", "\r\n", " ", "　", "​", "é", "Σ", "²", "<|endoftext|>", "\x00", "\x1c"]
    check(both, ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(8000)])


def test_edges_between_texts(both):
    check(both, ["", "a", "", "'s", "s", " ", " ", "x ", "'", "ll", "  ", "", "'ll", "\n", "a'", "re"])
    check(both, ["don't we're I'LL they'd 'tis ''s !'s 's's \n's 've", "a  b   c\n\n  d \t e  "])


def test_long_texts_without_breaks(both):
    check(both, ["x" * 30000, "漢字仮名" * 6000, "ab" * 20000, " " * 30000, "=" * 5000, "😀" * 4000])


def test_every_code_point(both):
    check(both, [f"a{chr(i)}1 {chr(i)}b" for i in range(0x110000) if not 0xD800 <= i < 0xE000 and (i < 0x3000 or i % 17 == 0)])


def test_cache_that_starts_anew(both, monkeypatch):
    monkeypatch.setattr("orefold.llm.tokenizer.CACHE_WORDS", 3)
    for n in range(4):
        check(both, [f"some words {n} and more words", "longer-than-seven-bytes words"])


def test_column(spark, both):
    data = [(1, "Hello world", "x"), (2, None, "y"), (3, "", None), (3, "", None), (None, "naïve 😀", "z")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, ids string")
    out = sorted(encode_column(df.drop("ids"), ["doc_id"]).collect(), key=str)
    want = [(d, both[1].encode_ordinary(t or "")) for d, t, _ in data]
    assert len(out) == 5
    assert {(r.doc_id, tuple(r.ids)) for r in out} == {(d, tuple(i)) for d, i in want}
    counts = encode_column(df, ["doc_id", "text"], ids=False).collect()
    assert {(r.doc_id, r.n_tokens) for r in counts} == {(d, len(i)) for d, i in want}
    assert encode_column(df.limit(0), ["doc_id"]).collect() == []
