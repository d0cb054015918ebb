"""Sentences by hand that were written after the models and the features were fixed; nothing was changed for them."""

import re
from collections import Counter

from orefold.llm import pii

TEXTS = """
The minutes were taken by {name:Ottilie Brandauer} and sent round on Friday.
{name:Marcus Whitfield} owns this queue now, ask {name:Ngaio Tamihana} for access.
Ticket 5512098 was closed by {name:Sunita Raghavan} after build 20.4.1177.
Please forward it to {email:s.raghavan@tidewater.example} or ring {phone:+64 21 555 0182}.
{name:Brandauer, Ottilie} is listed twice in the directory.
Our landlord, Mr {name:Desmond Achebe}, lives at {address:14 Larkspur Crescent}, Dundee.
Send the router back to {address:Unit 7, 92 Foundry Road}, Cardiff.
Die Akte von {name:Roswitha Engelhardt} liegt in der {address:Lindenallee 23}.
Bitte um Rückruf unter {phone:0711 4829371}.
Le dossier de {name:Thibault Garnier} est au {address:12 rue des Peupliers}, Rennes.
La factura de {name:Mercedes Villalobos} va a {address:Calle Olmo, 18}.
He typed his social security number, {idnum:219-09-4417}, into the chat.
Passport number {idnum:K7730192} belongs to {name:Ayumi Kitagawa}.
Order 7719-2280-11 contains forty Blue Steel Hinges.
The Northern Lights dashboard and the Harvest Moon release are late.
Version 4.19.220 of the Tidewater Client supports Windows Server.
{name:P. Lindholm} and {name:J. R. Oduya} reviewed section 12.
Batch 881203 ran on host 10.2.33.41 for 5400 seconds.
Mail {email:ops+alerts@relay.example} bounced twice today.
Call our desk on {phone:(503) 555-0144} before noon.
Thank you, {name:Fiadh Gallagher}
Insurance number {idnum:QQ 12 34 56 C} appears in plain text.
Three Oak Street cafes closed; 12 Main Street events were moved.
My tax id is {idnum:48 392 117 605}, and my mobile is {phone:+49 171 5550123}.
{name:Wojciech Zarzycki} pushed commit 99120457 to the release branch.
Contact: {name:Amara Diallo}, {phone:+221 33 555 01 22}, {email:amara_diallo[at]kora[dot]example}
Python Software Foundation and Free Software Directory host mirrors.
The witness {name:Hamish MacAllister} saw {name:Yevgenia Dorokhova} leave {address:221 Kestrel Way}.
Row 18 holds 440 000 000 entries, column 7 holds 12.
Ask {name:Leilani Kahananui} whether Sprint 9 Review is still on.
""".strip().splitlines()

_ITEM = re.compile(r"\{(\w+):([^}]*)\}")


def test_fresh_sentences():
    hit, found, there = Counter(), Counter(), Counter()
    for marked in TEXTS:
        want, text, at = set(), "", 0
        for m in _ITEM.finditer(marked):
            text += marked[at : m.start()]
            want.add((m[1], len(text)))
            text += m[2]
            at = m.end()
        text += marked[at:]
        have = {(kind, a) for a, _, kind, _ in pii.find([text], pii.load_model())[0]}
        for kind in pii.KINDS:
            of = lambda s: {x for x in s if x[0] == kind}  # noqa: E731, B023
            hit[kind] += len(of(have & want))
            found[kind] += len(of(have))
            there[kind] += len(of(want))
        if have != want:
            print(text, "missed", sorted(want - have), "false", sorted(have - want))
    print({k: (hit[k], found[k], there[k]) for k in pii.KINDS})
    assert sum(hit.values()) >= 0.8 * sum(there.values()) and sum(hit.values()) >= 0.8 * sum(found.values())
