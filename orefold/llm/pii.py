"""Personal information in free text: generated candidates, boosted trees, typed placeholders.

Generators of high recall propose overlapping spans of each kind; a boosted-tree model per kind scores them from
features of their format and context; spans above the kind's calibrated threshold are taken, best first, where they
don't overlap. The models are trained by pii_train.py and kept in pii_model.json. How usual a word is comes from the ranks of
public vocabularies, whose folder is a parameter; no list of people's names or of places is kept.
"""

from __future__ import annotations

import base64
import json
import math
import os
import re
from collections.abc import Iterator, Sequence
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from orefold.llm.boosting import raw_score
from orefold.llm.tokenizer import TOKENIZER_DIR

KINDS = ("name", "email", "phone", "idnum", "address")

FOUND_SCHEMA = "doc_id bigint, kind string, start_pos bigint, end_pos bigint, score double"

# words that the generators and features know; fixed values
PARTICLES = ("van der", "van den", "van", "von der", "von", "zu", "del", "de la", "de los", "de", "della", "di", "da", "dos", "af", "av", "ter", "ten", "le", "la", "bin", "al")
TITLES = frozenset("dr prof mr mrs ms mx miss sr sra srta herr frau m mme mlle sir dame ing madame monsieur señor señora don doña signor signora mevrouw meneer fru doctor professor lady lord".split())
STREETS_EN = frozenset("Street St Road Rd Lane Ln Avenue Ave Crescent Cres Terrace Ter Drive Dr Court Ct Place Pl Square Sq Way Close Boulevard Blvd Row Gardens Gdns Hill Walk Mews Parkway Pkwy Highway Hwy Green Grove".split())
STREETS_DE = "straße|strasse|str|weg|gasse|allee|platz|ring|ufer|damm|stieg|steig|hof|graben|markt|pfad|chaussee|wall|berg|brücke|tor|straat|gracht|laan|plein|gatan|vägen|gade|vej|veien"
DE_BEFORE = "Am|An der|An den|Im|In der|Zum|Zur|Auf der|Auf dem|Unter den|Hinter der|Vor dem|Alter|Alte|Neue"
STREETS_FR = "rue|chemin|avenue|allée|allee|impasse|place|quai|boulevard|route|square|cours|passage|sentier|ruelle|faubourg|montée|venelle"
STREETS_ES = "Calle|C/|Cl|Avda|Av|Avenida|Plaza|Pza|Paseo|P\\.º|Camino|Ronda|Travesía|Carretera|Callejón|Glorieta|Cuesta|Via|Viale|Piazza|Corso|Rua"
UNITS = "Flat|Apt|Apartment|Unit|Suite|Ste|Floor|Room|Wohnung|Appt|Appartement|Piso|Lgh"
ID_WORDS = frozenset(
    "ssn social security soc sec sécurité securite sociale ss nino ni national insurance dni nie documento steuer steuernummer tax tin personnummer personnumret pnr passport reisepass passeport pasaporte ausweis nif identity identification "
    "ident personal fiscal fiscale sozialversicherungsnummer versicherungsnummer bsn cpf cpr pesel nir ahv codice citizen pps ppsn sin tfn nhs aadhaar".split()
)
PHONE_WORDS = frozenset(
    "call phone telephone tel telefon telefoon téléphone teléfono mobile mobil cell handy fax ring dial text sms whatsapp reach reached appeler appelez joindre llamar llame anrufen erreichbar backup on-call hotline phoned ruf rufen number numéro número nummer contact".split()
)
OTHER_NUMBER_WORDS = frozenset(
    "order ticket issue build commit version invoice bucket sample span rev revision hash line lines row run stamp timestamp release tracking parcel part serial isbn batch job port offset sku account bestellung auftrag rechnung commande facture pedido "
    "factura id uuid case range sprint patch pr byte bytes size total count sum build-nr".split()
)
ADDRESS_WORDS = frozenset("address addresses ship shipped send sent deliver delivered delivery live lives lived living located reside resides moved mail parcel invoice office home house anschrift adresse wohnt wohnhaft envoyer livrer habite dirección enviar entregar vive domicilio indirizzo".split())

_GAP = "[ \u00a0\u2007\u2009\u202f]"
_DASH = "\\-\u2010\u2011\u2012\u2013"
_CAP = re.compile(r"[^\W\d_a-zß-öø-ÿ][\w'’]*(?:[-‐‑][^\W\d_a-zß-öø-ÿ][\w'’]*)*")
_PARTICLE_GAP = re.compile(rf"{_GAP}(?:{'|'.join(PARTICLES)}){_GAP}\Z")
_PARTICLE_BEFORE = re.compile(rf"(?<!\w)(?:{'|'.join(PARTICLES)}){_GAP}\Z")
_LONGEST_PARTICLE = max(map(len, PARTICLES)) + 2
_SPACE_GAP = re.compile(rf"(?:{_GAP}|{_GAP}?\r?\n[ \t>/*#-]*)\Z")
_COMMA_GAP = re.compile(rf",(?:{_GAP}|\r?\n)\Z")
_DOT_GAP = re.compile(rf"\.(?:{_GAP}|\r?\n)?\Z")
_AT = re.compile(r"[@＠\[({<](?:(?<=[@＠])|\s?[aA][tT]\s?[\])}>])")
_AT_WORD = re.compile(r"\sat\s(?=[\w-]+\s?[\[({]?\s?dot\b)", re.I)
_DOMAIN = re.compile(r"\s?[\w-]+(?:(?:\.|\s?[\[({<]\s?dot\s?[\])}>]\s?|\sdot\s)[\w-]*[^\W_])+", re.I)
_TOP = re.compile(r"[^\w-]+")
_START = rf"[\w@.#$€£/\\{_DASH}]"
_NUM = re.compile(
    rf"[+(\d](?<!{_START}[+(\d])(?<!\w\([+(\d])(?:(?<=\+){_GAP}?\d|(?<=\()\+{_GAP}?\d|(?<=\()\d(?=\d{{1,4}}\))|(?<=\d))"
    rf"(?:(?:{_GAP}|[/.{_DASH}]|{_GAP}?\(|\){_GAP}?)?\d){{6,}}(?:[ {_DASH}]?[A-Z]{{1,2}})?(?!\w)"
)
_LETTER_ID = re.compile(rf"[A-Z](?<![\w{_DASH}][A-Z])(?:[A-Z]{{0,2}}[ {_DASH}]?\d(?:[ {_DASH}]?\d){{4,9}}(?:[ {_DASH}]?[A-Z])?|(?=(?:[A-Z]*\d){{4}})[A-Z\d]{{7,17}})(?![\w{_DASH}])")
_CITY = "[^\\W\\d_a-z]"
# parts of an address before or after the word that names the kind of street
_HOUSE = re.compile(rf"(?<![\w.])(?:(?:{UNITS})\.?\s?(?:no\.?\s?)?\d+[A-Za-z]?,\s{{1,2}})?\d{{1,5}}(?:[A-Za-z]|[-/]\d+)?,?\s(?:(?:[NSEW]|NE|NW|SE|SW)\.?\s)?\Z")
_HOUSE_LONGEST = 60  # of a number with unit and direction, at most
_DE_HIT = re.compile(rf"(?:{STREETS_DE})\Z")
_DE_NUMBER = re.compile(r"\.? \d{1,4}(?: ?[a-z])?(?!\w)")
_DE_WORDS = re.compile(rf"(?<![\w.])(?:{_CITY}\w*(?:e|er|es|en) ){{1,2}}\Z")
_DE_PHRASE = re.compile(rf"(?:{DE_BEFORE}) {_CITY}\w+ \d{{1,4}}(?: ?[a-z])?(?!\w)")
_FR = re.compile(rf"(?:{STREETS_FR})\s(?:de la |de l['’]|du |des |de |d['’])?{_CITY}[\w'’-]*")
_FR_NUMBER = re.compile(r"(?<![\w.])\d{1,4}(?:\s?(?:bis|ter|quater)|[A-Za-z])?,?\s\Z")
_FR_HINT = re.compile(rf" (?=(?:{STREETS_FR}) )")
_ES = re.compile(rf"(?:{STREETS_ES})\.?\s?(?:de la |de las |de los |della |del |dei |de |di )?{_CITY}[\w'’-]*(?:\s{_CITY}[\w'’-]*){{0,2}},?\s(?:n[º°o.]+\s?)?\d{{1,4}}")
_ES_FIRST = frozenset(w.split("\\")[0].split("/")[0] for w in STREETS_ES.split("|"))
_DE_FIRST = frozenset(w.split()[0] for w in DE_BEFORE.split("|"))
_POSTAL = re.compile(r"[,.]?\s{1,2}(?:\d{4,5}\s)?[^\W\d_a-z]|,\s(?:Apt|\d)")
_EXTENSION = re.compile(r"\s?(?:ext|x|app|durchwahl)\b", re.I)
_DATE = re.compile(r"(?:19|20)\d\d([-/. ]?)[01]\d\1[0-3]\d(?!\d)")
_DIGITS = re.compile(r"\d+")

Candidate = tuple[str, int, int, dict]


def capitals(text: str) -> list[tuple[int, int]]:
    """Spans of words that start with a capital letter."""
    return [m.span() for m in _CAP.finditer(text)]


def _with_particle(text: str, start: int, end: int, info: dict) -> Iterator[Candidate]:
    """The span itself and, where a particle stands before it, also the one with the particle."""
    yield "name", start, end, info
    before = _PARTICLE_BEFORE.search(text, max(0, start - _LONGEST_PARTICLE), start)
    if before:
        yield "name", before.start(), end, info | {"particle": 1}


def name_candidates(text: str, tokens: Sequence[tuple[int, int]] | None = None) -> Iterator[Candidate]:
    """Two capitalised words, or an initial and one, in either order, with middle initials and particles."""
    tokens = capitals(text) if tokens is None else tokens
    last = len(tokens) - 1
    for i in range(last):
        s1, e1 = tokens[i]
        s2, e2 = tokens[i + 1]
        gap = text[e1]
        if gap.isalpha() or gap not in " \u00a0\u2007\u2009\u202f.,\r\n":
            continue
        if e1 - s1 > 1 and text[s1:e1].casefold() in TITLES:
            continue
        if e1 - s1 == 1:
            if gap == "." and e2 - s2 > 1:
                if _DOT_GAP.match(text, e1, s2):
                    yield "name", s1, e2, {"form": 2, "first": text[s1:e1], "last": text[s2:e2]}
                elif _PARTICLE_GAP.match(text, e1 + 1, s2):
                    yield "name", s1, e2, {"form": 2, "first": text[s1:e1], "last": text[s2:e2], "particle": 1}
            continue
        if gap == ".":
            continue
        if e2 - s2 == 1:
            if i + 1 < last and text[e2 : e2 + 1] == "." and _SPACE_GAP.match(text, e1, s2):
                s3, e3 = tokens[i + 2]
                if e3 - s3 > 1 and (_DOT_GAP.match(text, e2, s3) or _PARTICLE_GAP.match(text, e2 + 1, s3)):
                    yield "name", s1, e3, {"form": 1, "first": text[s1:e1], "last": text[s3:e3], "middle": 1}
            if text[e2 : e2 + 1] == "." and _COMMA_GAP.match(text, e1, s2):
                yield from _with_particle(text, s1, e2 + 1, {"form": 4, "first": text[s2:e2], "last": text[s1:e1]})
            continue
        if s2 == e1 + 1 and gap != "," or _SPACE_GAP.match(text, e1, s2):
            yield "name", s1, e2, {"form": 0, "first": text[s1:e1], "last": text[s2:e2]}
        elif gap == ",":
            if _COMMA_GAP.match(text, e1, s2):
                yield from _with_particle(text, s1, e2, {"form": 3, "first": text[s2:e2], "last": text[s1:e1]})
        elif _PARTICLE_GAP.match(text, e1, s2):
            yield "name", s1, e2, {"form": 0, "first": text[s1:e1], "last": text[s2:e2], "particle": 1}


def _local(ch: str) -> bool:
    return ch.isalnum() or ch in "._+%-"


def email_candidates(text: str) -> Iterator[Candidate]:
    """A local part, an at in any writing, and a domain of two labels or more."""
    marks = list(_AT.finditer(text))
    if " dot " in text or " DOT " in text:
        marks += _AT_WORD.finditer(text)
    for m in marks:
        end = m.start()
        if end and text[end - 1] in " \u00a0":
            end -= 1
        start = end
        while start and _local(text[start - 1]):
            start -= 1
        while start < end and not text[start].isalnum():
            start += 1
        after = _DOMAIN.match(text, m.end()) if start < end else None
        if after:
            yield "email", start, after.end(), {"at": m[0], "local": text[start:end], "domain": after[0].strip()}


def number_candidates(text: str) -> Iterator[Candidate]:
    """Long numbers with separators, and numbers with letters; each may be a phone or an identity number."""
    for m in _NUM.finditer(text):
        start, end = m.span()
        body = text[start:end]
        if body[0] == "(" and body[1:2] == "+" and ")" not in body.replace("(0)", ""):
            start += 1  # the sentence's parenthesis
            body = body[1:]
        info = {"body": body}
        yield "phone", start, end, info
        yield "idnum", start, end, info
    for m in _LETTER_ID.finditer(text):
        yield "idnum", m.start(), m.end(), {"body": m[0]}


def address_candidates(text: str, tokens: Sequence[tuple[int, int]] | None = None) -> Iterator[Candidate]:
    """A house or flat number with a street, in the order of several languages; each starts from the word that names the kind of street."""
    tokens = capitals(text) if tokens is None else tokens
    for i, (a, b) in enumerate(tokens):
        word = text[a:b]
        if word in STREETS_EN:
            k = i
            while k and tokens[k - 1][1] + 1 == tokens[k][0] and text[tokens[k - 1][1]].isspace():
                k -= 1  # the words of the street's name
            for j in range(k, i + 1):
                house = _HOUSE.search(text, max(0, tokens[j][0] - _HOUSE_LONGEST), tokens[j][0])
                if house:
                    yield "address", house.start(), b, {"order": 0, "words": i - j, "type": word, "street": text[tokens[j][0] : max(tokens[j][0], a - 1)]}
                    break
        if word in _ES_FIRST and (m := _ES.match(text, a)):
            yield "address", a, m.end(), {"order": 3, "words": len(m[0].split()) - 1, "type": word, "street": m[0][len(word) :]}
        if word in _DE_FIRST and (m := _DE_PHRASE.match(text, a)):
            yield "address", a, m.end(), {"order": 2, "words": 2, "type": word, "street": m[0]}
        elif text[b : b + 1] in (" ", ".") and _DE_HIT.search(word) and (m := _DE_NUMBER.match(text, b)):
            lead = _DE_WORDS.search(text, max(0, tokens[i - 2][0] if i > 1 else 0), a) if i else None
            yield "address", lead.start() if lead else a, m.end(), {"order": 1, "words": 1 + (lead is not None), "type": word, "street": word}
    for hint in _FR_HINT.finditer(text):
        m = _FR.match(text, hint.end())
        house = _FR_NUMBER.search(text, max(0, hint.end() - 16), hint.end()) if m else None
        if house:
            yield "address", house.start(), m.end(), {"order": 4, "words": 1, "type": m[0].split()[0], "street": m[0]}


def candidates(text: str) -> Iterator[Candidate]:
    tokens = capitals(text)
    yield from name_candidates(text, tokens)
    yield from email_candidates(text)
    yield from number_candidates(text)
    yield from address_candidates(text, tokens)


# how usual words are


class Lexicon:
    """How usual a word is in lower case and capitalised, from 0 (no entry of its own) to 1, by its rank in public vocabularies."""

    def __init__(self, folder: str) -> None:
        self.scores: dict[bytes, float] = {}
        for name in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"):
            with open(os.path.join(folder, name), "rb") as f:
                for line in f:
                    word, _, rank = line.partition(b" ")
                    if rank.strip():
                        token = base64.b64decode(word)
                        if token[:1] == b" ":
                            self.scores[token] = max(self.scores.get(token, 0.0), 1 - math.log(int(rank) + 1) / 11)
        self.known: dict[str, tuple[float, ...]] = {}

    def words(self) -> list[str]:
        """Lower-case words of the vocabularies of four letters or more, in order."""
        return sorted(w for t in self.scores if (w := t[1:].decode("utf-8", "ignore")).isalpha() and w.islower() and len(w) > 3)

    def of(self, word: str) -> float:
        return self.scores.get(b" " + word.encode("utf-8", "surrogatepass"), 0.0)

    def word(self, word: str) -> tuple[float, ...]:
        """(usual in lower case, usual capitalised, length, case, odd characters) of a word; of several parts the most usual counts."""
        found = self.known.get(word)
        if found is None:
            parts = [p for p in re.split(r"[-‐‑'’]", re.sub(r"['’]s\Z", "", word)) if p] or [word]
            low = max(self.of(p.lower()) for p in parts)
            cap = max(self.of(p.capitalize()) for p in parts)
            camel = any(any(c.isupper() for c in p[1:]) and not p.isupper() for p in parts)
            found = (low, cap, float(len(word)), float(word.isupper()), float(camel), float(any(c.isdigit() or c == "_" for c in word)), float(len(parts)))
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[word] = found
        return found


_lexicons: dict[str, Lexicon] = {}


def lexicon(folder: str = TOKENIZER_DIR) -> Lexicon:
    """The process's lexicon of a folder, loaded once."""
    if folder not in _lexicons:
        _lexicons[folder] = Lexicon(folder)
    return _lexicons[folder]


# features


def words_before(text: str, at: int, n: int) -> list[str]:
    """The n words before a position on its line, the nearest first."""
    out = []
    while len(out) < n:
        e = at
        while e and not text[e - 1].isalnum():
            if text[e - 1] == "\n":
                return out
            e -= 1
        s = e
        while s and (text[s - 1].isalnum() or text[s - 1] in "'’.+" and s > 1 and text[s - 2].isalnum()):
            s -= 1
        if s == e:
            return out
        out.append(text[s:e])
        at = s
    return out


def words_after(text: str, at: int, n: int) -> list[str]:
    """The n words after a position on its line, the nearest first."""
    out, end = [], len(text)
    while len(out) < n:
        s = at
        while s < end and not text[s].isalnum():
            if text[s] == "\n":
                return out
            s += 1
        e = s
        while e < end and (text[e].isalnum() or text[e] in "'’"):
            e += 1
        if s == e:
            return out
        out.append(text[s:e])
        at = e
    return out


def around(text: str, start: int, end: int) -> tuple[str, str, bool]:
    """The word before (titles skipped) and the word after as written, '' at a line's edge, and whether a title was skipped."""
    left = words_before(text, start, 2)
    title = bool(left) and left[0].casefold() in TITLES
    left = left[1:] if title else left
    right = words_after(text, end, 1)
    return left[0] if left else "", right[0] if right else "", title


_CLASSES = {"": 0.0, " ": 1.0, "\n": 2.0, "\r": 2.0, "\t": 1.0, ".": 3.0, ",": 4.0, ":": 5.0, ";": 5.0, "(": 6.0, ")": 6.0, "<": 6.0, ">": 6.0, '"': 7.0, "'": 7.0, "’": 7.0, "`": 8.0, "/": 9.0, "_": 9.0, "=": 9.0, "#": 9.0, "\\": 9.0, "-": 10.0, "|": 11.0}


def _class(ch: str) -> float:
    return _CLASSES.get(ch, 12.0 if ch.isalnum() else 13.0)


def _nearest(words: Sequence[str], cues: frozenset[str]) -> float:
    """How many words away the nearest cue is; 9 if none is near."""
    return next((float(n) for n, w in enumerate(words) if w in cues), 9.0)


def features(text: str, cand: Candidate, lex: Lexicon) -> list[float]:
    kind, start, end, info = cand
    before, after, title = around(text, start, end)
    low_before, low_after = lex.word(before), lex.word(after)
    common = [
        float(not before), float(not after), _class(text[start - 1 : start]), _class(text[end : end + 1]), float(before[:1].isupper()), low_before[0], float(after[:1].isupper()), low_after[0],
    ]
    if kind == "name":
        first, last = lex.word(info["first"]), lex.word(info["last"])
        near = text[start - 2 : start] if start > 1 else ""
        return common + [
            *first, *last, float(len(info["first"]) == 1), float(info["form"]), float(info.get("particle", 0)), float(info.get("middle", 0)), float(title), first[1] - first[0], last[1] - last[0],
            float(near[1:] == " " and near[:1].isalnum()), max(first[0], last[0]), low_after[1] - low_after[0], float(text[end : end + 1] == " "), low_before[1] - low_before[0],
        ]
    if kind == "email":
        domain = info["domain"]
        top = _TOP.split(domain)[-1]
        return common + [
            float(len(info["local"])), float(top.isalpha()), float(len(top)), float(sum(c.isalpha() for c in domain) / len(domain)), float(any(c.isalpha() for c in info["local"])), float(info["at"] in "@＠"),
            float(info["at"].strip()[0] in "[({<"), float(len(domain)), float(any(c.isdigit() for c in domain)), lex.of(info["local"].lower()), float("_" in info["local"]), float(domain[0].isdigit()),
        ]
    near = [w.casefold().strip(".") for w in words_before(text, start, 5)]
    if kind == "address":
        street = [lex.word(w) for w in info["street"].split()] or [lex.word("")]
        kind_of = lex.word(info["type"])
        return common + [
            float(info["order"]), float(info["words"]), float(text[start].isdigit()), float(len(street)), max(w[0] for w in street), min(w[0] for w in street), max(w[1] - w[0] for w in street), kind_of[0], kind_of[1],
            _nearest(near, ADDRESS_WORDS), _nearest(near, OTHER_NUMBER_WORDS), float(_POSTAL.match(text, end) is not None), float(end - start), float(bool(words_after(text, end, 1)) and after[:1].islower() and text[end : end + 1] == " "),
            float(after.isdigit()),
        ]
    body = info["body"]
    groups = [len(g) for g in _DIGITS.findall(body)]
    digits = "".join(_DIGITS.findall(body))
    letters = sum(c.isalpha() for c in body)
    head = len(body) - len(body.lstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    dashes = sum(c in "-‐‑‒–" for c in body)
    return common[:4] + [
        *[float(g) for g in (groups + [0] * 6)[:6]], float(len(groups)), float(groups[-1]), float(len(digits)), float(body[0] == "+"), float("(" in body), float(body.startswith("00")), float(body[0] == "0"), float("." in body),
        float(dashes), float(sum(c in " \u00a0\u2007\u2009\u202f" for c in body)), float("/" in body), float(letters), float(head), float(body[-1].isalpha()), _nearest(near, ID_WORDS), _nearest(near, PHONE_WORDS),
        _nearest(near, OTHER_NUMBER_WORDS), float(_EXTENSION.match(text, end) is not None), float(_DATE.match(body) is not None),
    ]


@cache
def load_model(path: str = "") -> dict:
    return json.loads(Path(path or Path(__file__).with_name("pii_model.json")).read_text())


def _widest(spans: list[tuple[int, float, int, int, str]]) -> list[tuple[int, float, int, int, str]]:
    """The spans (text, minus the probability, start, end, kind) without those that lie inside another one of their kind that is about as likely."""
    kept: list[tuple[int, float, int, int, str]] = []
    for x in sorted(spans, key=lambda x: (x[4], x[0], x[2], -x[3])):
        if not (kept and kept[-1][4] == x[4] and kept[-1][0] == x[0] and x[3] <= kept[-1][3] and kept[-1][1] <= x[1] + 0.1):
            kept.append(x)
    return kept


def find(texts: Sequence[str | None], model: dict, folder: str = TOKENIZER_DIR) -> list[list[tuple[int, int, str, float]]]:
    """For each text its items as (start, end, kind, probability), in order, without overlaps."""
    lex = lexicon(folder)
    spans: dict[str, list[tuple[int, int, int]]] = {k: [] for k in KINDS}
    rows: dict[str, list[list[float]]] = {k: [] for k in KINDS}
    for d, text in enumerate(texts):
        for cand in candidates(text) if text else ():
            rows[cand[0]].append(features(text, cand, lex))
            spans[cand[0]].append((d, cand[1], cand[2]))
    likely: list[tuple[int, float, int, int, str]] = []
    for kind in KINDS:
        if rows[kind]:
            m = model["kinds"][kind]
            p = 1 / (1 + np.exp(-(m["a"] * raw_score(m["trees"], np.asarray(rows[kind])) + m["b"])))
            for i in np.flatnonzero(p >= m["threshold"]):
                d, a, b = spans[kind][i]
                likely.append((d, -float(p[i]), a, b, kind))
    out: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
    for d, p, a, b, kind in sorted(_widest(likely), key=lambda x: (x[0], x[1], -(x[3] - x[2]), x[2], x[4])):
        if all(b <= s or a >= e for s, e, _, _ in out[d]):
            out[d].append((a, b, kind, -p))
    for items in out:
        items.sort()
    return out


def redact(text: str, items: list[tuple[int, int, str, float]]) -> str:
    """The text with [NAME], [EMAIL], [PHONE], [IDNUM] and [ADDRESS] in place of the items and nothing else changed."""
    out, at = [], 0
    for a, b, kind, _ in items:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def _texts(batches: Iterator[pa.RecordBatch], model: dict, folder: str, block: int = 1000) -> Iterator[tuple[list, list, list]]:
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i in range(0, len(texts), block):
            yield ids[i : i + block], texts[i : i + block], find(texts[i : i + block], model, folder)


def find_items(docs: DataFrame, doc: str = "doc_id", text: str = "text", model_path: str = "", folder: str = TOKENIZER_DIR) -> DataFrame:
    """Every mention as a row of FOUND_SCHEMA; positions are code points of the text from 0, the end is exclusive.

    Null and empty texts have no items; repeated texts have theirs each; nothing is shuffled and other columns are ignored.
    """
    model = load_model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, found in _texts(batches, model, folder):
            flat = [(i, kind, a, b, p) for i, items in zip(ids, found) for a, b, kind, p in items]
            cols = list(zip(*flat)) or [(), (), (), (), ()]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "kind", "start_pos", "end_pos", "score"])

    return docs.select(docs[doc].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, FOUND_SCHEMA)


def redact_documents(docs: DataFrame, doc: str = "doc_id", text: str = "text", model_path: str = "", folder: str = TOKENIZER_DIR) -> DataFrame:
    """doc_id, the redacted text (null stays null, empty stays empty) and n_items of every row."""
    model = load_model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, found in _texts(batches, model, folder):
            clean = [None if t is None else redact(t, items) for t, items in zip(texts, found)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(clean, pa.string()), pa.array([len(x) for x in found], pa.int32())], names=["doc_id", "text", "n_items"])

    return docs.select(docs[doc].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, "doc_id bigint, text string, n_items int")
