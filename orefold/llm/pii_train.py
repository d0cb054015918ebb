"""Train the models of pii.py: python -m orefold.llm.pii_train OUT documents.parquet...

There are no hand-labelled rows. The models learn from two sources of equal weight: the sentences of pii_samples.py, whose items are known, and a
bounded sample of documents with labelling functions (strong formats for emails, numbers and addresses, and for names the given and family names that
phrases introduce several times). The labelling functions' names and formats are never features, and no word of the documents is kept in the models.

Three figures say what the models do on the unseen, each by end: sentences of the world `held`, which the shipped models never see; and documents whose
family names, or whose words before an item, were kept out of a fit of its own.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow.dataset as ds

from orefold.llm import boosting, pii, pii_samples

#: Documents that are looked at, at most; texts made; trees per kind.
SAMPLE_DOCS, SAMPLE_TEXTS, ROUNDS = 10_000, 20_000, 120

_INTRO = re.compile(
    r"(?:[Cc]omment left by|[Rr]eviewed-by:|[Ss]igned-off-by:|[Rr]eported by|[Pp]arcel for|[Oo]wner:|@author|[Pp]lease ask|[Tt]hanks to|[Tt]est user|[Bb]adge request for|[Gg]emeldet von|[Vv]oir avec|[Cc]onsultar con|[Ss]ignalé par|[Ll]o encontró|[Uu]mbau) "
    r"(?:(?:Dr|Prof|Ms|Mx|Mr|Mrs)\. )?([^\W\d_a-z][\w’']+(?:-[^\W\d_a-z][\w’']+)*) (?:[A-Z]\. )?(?:(?:van der|von|del|de la|af) )?([^\W\d_a-z][\w’']+(?:-[^\W\d_a-z][\w’']+)*)"
)

#: Formats of telephone and identity numbers in the documents, digits as 9 and capitals as A. Fixed values, for labels alone.
PHONE_SHAPES = frozenset((
    "+9 999 999 9999", "+99 99 99999 999", "+99 (9)9 999 999 99", "+99 9999 999999", "+99 9 99 99 99 99", "9999 9999 999999", "999 9999 9999", "(999) 999-9999", "(999) 999 9999",
    "+99999999999", "+999999999999", "999.999.9999", "999/99999-999", "9-999-999-9999", "999-999-9999", "+9 (999) 999-9999", "+9-999-999-9999", "+9.999.999.9999", "99 99 99 99 99", "+99 999 999 99 99",
))
ID_SHAPES = frozenset((
    "9 99 99 99 999 999 99", "999999999999999", "99 999 999 999", "99999999999", "99999999-9999", "999999-9999", "999 99 9999", "999-99-9999", "99999999-A", "99999999A", "99999999 A", "A9999999A", "A-9999999-A",
    "AA 99 99 99 A", "AA999999A", "AA9999999", "AA 9999999",
))
#: Words in front of numbers that are something else, and around numbers with a street's word.
NOT_PERSONAL = frozenset("bucket range sample span stamp build rev ticket hash run line zeile ligne línea offsets sprint fix at sha256".split())
NOT_STREET_BEFORE, NOT_STREET_AFTER = frozenset(("fix", "sprint", "covers", "address")), frozenset(("blocks", "map", "checks"))


def shape(body: str) -> str:
    """Digits as 9, capitals as A, separators as they are, wide ones and dashes unified."""
    out = re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", body))
    return re.sub(f"[{pii._DASH}]", "-", re.sub(pii._GAP, " ", out))


def _parts(word: str) -> list[str]:
    return [p for p in re.split(r"[-‐‑]", re.sub(r"['’]s\Z", "", word).casefold()) if p]


def vocabulary(texts: list[str]) -> tuple[set[str], set[str]]:
    """First and last names that people are introduced with several times."""
    first, last = Counter(), Counter()
    for t in texts:
        for m in _INTRO.finditer(t):
            first.update(_parts(m[1]))
            last[m[2].casefold()] += 1
    keep = lambda own, other: {w for w, c in own.items() if c >= 12 and c > 3 * other[w]}
    return keep(first, last), keep(last, first)


def label(text: str, cand: pii.Candidate, names: tuple[set[str], set[str]]) -> bool:
    """What the labelling functions say of a document's candidate."""
    kind, start, end, info = cand
    before, after, _ = pii.around(text, start, end)
    before, after = before.casefold(), after.casefold()
    if kind == "name":
        first, last = info["first"], info["last"]
        given = lambda w: len(w) == 1 or all(p in names[0] for p in _parts(w))
        straight = given(first) and last.casefold() in names[1]
        if info["form"] == 0:
            return straight or (given(last) and first.casefold() in names[1])
        if info["form"] in (3, 4) and straight:
            # family name first, unless it ends a name that starts before: "A B, C D"; a particle before belongs to it
            lead = re.search(r"([^\W\d_]+)\.? \Z", text[max(0, start - 25) : start])
            if lead and (lead[1].casefold() in names[0] or len(lead[1]) == 1):
                return False
            return bool(info.get("particle")) or not pii._PARTICLE_BEFORE.search(text, max(0, start - pii._LONGEST_PARTICLE), start)
        return straight
    if kind == "email":
        return re.fullmatch(r"[\w-]+(?:(?:\.|\s?[\[(]dot[\])]\s?|\sdot\s)[\w-]+)*(?:\.|\s?[\[(]dot[\])]\s?|\sdot\s)[A-Za-z]{2,}", info["domain"], re.I) is not None and re.search("[A-Za-z]", info["local"]) is not None
    if kind == "address":
        return info["words"] > 0 and after not in NOT_STREET_AFTER and before not in NOT_STREET_BEFORE
    if before in NOT_PERSONAL or (start and text[start - 1] in "-/."):
        return False
    return shape(info["body"]) in (PHONE_SHAPES if kind == "phone" else ID_SHAPES)


class Rows:
    """Candidates of one kind with their labels, where they are and what they are held out by."""

    def __init__(self) -> None:
        self.cands: list[tuple[str, pii.Candidate]] = []
        self.y: list[float] = []
        self.text: list[int] = []
        self.by: list[tuple[str, str]] = []
        self.made: list[bool] = []

    def add(self, n: int, text: str, cand: pii.Candidate, y: bool, made: bool) -> None:
        self.cands.append((text, cand))
        self.y.append(float(y))
        self.text.append(n)
        self.by.append((cand[3].get("last", "").casefold(), pii.around(text, cand[1], cand[2])[0].casefold()))
        self.made.append(made)


def collect(texts: list[str], samples: list[tuple[str, list]]) -> dict[str, Rows]:
    names = vocabulary(texts)
    rows: dict[str, Rows] = defaultdict(Rows)
    for n, t in enumerate(texts):
        for cand in pii.candidates(t):
            rows[cand[0]].add(n, t, cand, label(t, cand, names), False)
    for n, (t, items) in enumerate(samples, len(texts)):
        true = {(kind, at, at + len(item)) for at, kind, item in items}
        for cand in pii.candidates(t):
            rows[cand[0]].add(n, t, cand, (cand[0], cand[1], cand[2]) in true, True)
    return rows


def fit(rows: dict[str, Rows], use: dict[str, np.ndarray]) -> dict:
    """Models from the rows in use; a fifth of their texts calibrates and sets the thresholds."""
    lex = pii.lexicon()
    kinds = {}
    for kind in pii.KINDS:
        r = rows[kind]
        pick = np.flatnonzero(use[kind])
        x = np.asarray([pii.features(*r.cands[i], lex) for i in pick])
        y, made, text = (np.asarray(v)[pick] for v in (r.y, r.made, r.text))
        weight = np.where(made, 0.5 / max(made.mean(), 1e-9), 0.5 / max(1 - made.mean(), 1e-9))
        tune = text % 5 == 0
        trees = boosting.fit(x[~tune], y[~tune], weight[~tune], rounds=ROUNDS)
        score = boosting.raw_score(trees, x[tune])
        a, b = boosting.calibrate(score, y[tune])
        cut = boosting.best_threshold(1 / (1 + np.exp(-(a * score + b))), y[tune], weight[tune])
        kinds[kind] = {"trees": trees, "a": round(a, 4), "b": round(b, 4), "threshold": round(cut, 3)}
    return {"kinds": kinds}


def by_end(model: dict, texts: list[str], true: list[set[tuple[str, int]]], only=None) -> dict[str, tuple[float, float, int]]:
    """Precision, recall and true items per kind of whole texts, overlaps settled."""
    hit, found, there = Counter(), Counter(), Counter()
    for got, want in zip(pii.find(texts, model), true):
        have = {(kind, a) for a, _, kind, _ in got}
        for kind, _ in have:
            found[kind] += 1
        for kind, _ in want:
            there[kind] += 1
        for kind, _ in have & want:
            hit[kind] += 1
    return {k: (hit[k] / max(1, found[k]), hit[k] / max(1, there[k]), there[k]) for k in pii.KINDS}


def _held(word: str) -> bool:
    return zlib.crc32(word.encode()) % 5 == 0


def on_kept_out(rows: dict[str, Rows], which: int) -> dict[str, tuple[float, float, int]]:
    """The models of a fit without the documents' rows of some family names (which=0) or words before an item (which=1), on those rows."""
    out = {kind: np.asarray([not m and _held(by[which]) and by[which] != "" for m, by in zip(r.made, r.by)], bool) for kind, r in rows.items()}
    model = fit(rows, {kind: ~o for kind, o in out.items()})
    lex = pii.lexicon()
    result = {}
    for kind, r in rows.items():
        pick = np.flatnonzero(out[kind])
        if len(pick):
            m = model["kinds"][kind]
            x = np.asarray([pii.features(*r.cands[i], lex) for i in pick])
            hit = 1 / (1 + np.exp(-(m["a"] * boosting.raw_score(m["trees"], x) + m["b"]))) >= m["threshold"]
            y = np.asarray(r.y)[pick] > 0
            result[kind] = ((hit & y).sum() / max(1, hit.sum()), (hit & y).sum() / max(1, y.sum()), int(y.sum()))
    return result


def _show(what: str, figures: dict[str, tuple[float, float, int]]) -> None:
    for kind, (precision, recall, n) in figures.items():
        print(f"{what}: {kind}: precision {precision:.4f}, recall {recall:.4f} of {n}")


def main(out: str, paths: list[str]) -> None:
    texts = [t for t in ds.dataset(paths).head(SAMPLE_DOCS, columns=["text"]).column("text").to_pylist() if t]
    rows = collect(texts, list(pii_samples.sentences("train", SAMPLE_TEXTS, 1, pii.lexicon().words())))
    model = fit(rows, {kind: np.ones(len(r.y), bool) for kind, r in rows.items()})
    Path(out).write_text('{"kinds": {' + ",\n".join(json.dumps({k: m}, sort_keys=True)[1:-1] for k, m in model["kinds"].items()) + "}}\n")
    unseen = list(pii_samples.sentences("held", 4000, 2))
    _show("held sentences", by_end(model, [t for t, _ in unseen], [{(k, at) for at, k, _ in items} for _, items in unseen]))
    if "--quick" in sys.argv:
        return
    _show("held family names", on_kept_out(rows, 0))
    _show("held words before", on_kept_out(rows, 1))


if __name__ == "__main__":
    main(sys.argv[1], [p for p in sys.argv[2:] if p != "--quick"])
