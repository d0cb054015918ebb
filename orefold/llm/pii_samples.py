"""Labelled sentences for the models of pii.py, made by rule: people, formats and sentence patterns of our own.

There are two worlds, `train` and `held`. They share no name, no street, no number format and no sentence, so that figures on `held` tell how the
models do on people and sentences they have never seen. Every sentence comes with its true items.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator, Sequence

GIVEN = {
    "train": "James Mary Robert Linda Michael Susan David Karen Thomas Nancy Daniel Lisa Matthew Emily Mark Sandra Paul Ashley Kevin Laura Hans Greta Jürgen Ursula Klaus Heike Pierre Amélie Jean Chloé Luc Manon Carlos Lucía Javier Elena Diego Pilar "
    "Giulia Marco Paolo Chiara Sven Astrid Björn Ingrid Anders Freja Piotr Agnieszka Tomasz Katarzyna Ivan Olga Dmitri Svetlana Rajesh Priya Amit Deepa Wei Mei Hiroshi Yuki Minh Linh Ahmed Fatima Omar Layla Yusuf Aisha Kwame Ama Tunde Ngozi Joana Tiago".split(),
    "held": "John Patricia William Barbara Richard Jessica Andrew Megan Brian Hannah Fritz Annelise Uwe Sabine Michel Élodie Antoine Margaux Pablo Carmen Andrés Inés Luca Francesca Lars Karin Mikkel Signe Jakub Zofia Oleg Natalia Vikram Anjali Chen Xiu "
    "Kenji Haruka Duc Thuy Hassan Mariam Karim Salma Chidi Adaeze Kofi Efua Rui Beatriz".split(),
}
FAMILY = {
    "train": "Johnson Williams Jones Miller Davis Anderson Taylor Moore Jackson White Harris Clark Lewis Walker Hall Young King Wright Hill Scott Green Adams Baker Nelson Carter Müller Schneider Fischer Weber Wagner Becker Hoffmann Schulz Dupont Moreau Lefèvre "
    "Girard Roux Fontaine García Fernández López Sánchez Romero Navarro Rossi Ferrari Esposito Bianchi Johansson Nilsson Lindgren Hansen Nielsen Kowalski Wójcik Nowak Ivanov Smirnov Volkov Sharma Patel Gupta Singh Wang Zhang Tanaka Suzuki Nguyen Tran Khan "
    "Hussein Mansour Mensah Owusu Adeyemi Balogun Silva Pereira O'Brien McCarthy Smith-Rowe".split(),
    "held": "Smith Brown Wilson Thompson Martin Lee Robinson Rodriguez Allen Cook Bell Ward Schmidt Zimmermann Krause Vogel Bernard Lambert Mercier Ortega Delgado Castro Ricci Conti Eriksson Lundqvist Sørensen Zieliński Petrov Sokolov Iyer Kapoor Li Chen "
    "Yamamoto Pham Rahman Haddad Okafor Boateng Oliveira Santos O'Connor MacLeod Jones-Parker".split(),
}
#: Syllables of invented names.
SYLLABLES = {
    "train": ("bra tor mel vin sa ril dor ken ul fa pen gor tis lan ve mir ost hal rim bel cor du".split(), "dan mar wyn ric sel lund feld berg ton ova eti ssen quist rand mond vell stra nic thal gren".split()),
    "held": ("ka jor zil pra het ny lo vas ter quo ebb stam fi gri wen or tal ush".split(), "ford aru hild vik ander zyn elka mott ruck isch ano eff tov lay bruk sten".split()),
}
STREETS = {
    "train": "Maple Oak Cedar Church Station Victoria Chester Kingston Harbour Willow Mill Park Orchard Queens Bridge Lincoln Franklin Madison Sunset Ridge Elm Market".split(),
    "held": "Birch Chestnut High London Windsor Pine Walnut Jefferson Monroe Prince Abbey Castle Garden Meadow Baker Downing Pennsylvania Lombard".split(),
}
TOWNS = {"train": "Springfield Leeds Hamburg Lyon Sevilla Bristol Dayton Graz Malmö Porto".split(), "held": "Oxford Kassel Nantes Bilbao Tampa Utrecht Bern Cork Aarhus".split()}
#: Street types by language: what stands before and after the name, or joined with it.
ENGLISH_TYPES = {"train": "Street Road Lane Avenue Court Drive Terrace St Ave Close Crescent".split(), "held": "Place Square Way Boulevard Rd Blvd Gardens Row Grove Hill".split()}
OTHER_STREETS = {
    "train": ["{G}straße #", "{G}weg ##", "Am {G} #", "{G}gasse ##a", "## rue de {F}", "##, avenue {F}", "# bis, rue des {F}", "Calle {F}, ##", "Avenida de {F} ##", "Plaza {F}, #", "Via {F} ##", "{G}gatan #"],
    "held": ["{G}allee ##", "{G}platz #", "An der {G} #", "{G}ring ##", "##, boulevard {F}", "# place de la {F}", "## ter, chemin du {F}", "Paseo de {F}, ##", "Camino de {F} #", "Carretera {F}, ###", "{G}straat ##", "Viale {F} #"],
}
#: Digits for #, capital letters for A; d stands for 1 to 9.
PHONES = {
    "train": ["+1 d## ### ####", "(d##) ###-####", "d##-###-####", "+44 #### ######", "0d### ######", "+49 ## ########", "+33 d ## ## ## ##", "0d ## ## ## ##", "+34 d## ### ###", "+46 d# ### ## ##", "+31 6 ########", "+91 ##### #####", "+81 ## #### ####", "+55 ## ##### ####",
              "00## d ## ## ## ##", "+###########", "0##/######", "d##.###.####", "1-d##-###-####", "+46 (0)d ### ### ##", "+49 (0)## #######", "0## #### ####", "0##/#####-###", "+49 ## ##### ###", "+1d#########", "00## #### ######", "(d##) ### ####"],
    "held": ["+47 ## ## ## ##", "+45 #### ####", "+39 ### ### ####", "+48 ### ### ###", "+351 d## ### ###", "+27 ## ### ####", "+7 d## ###-##-##", "+1 (d##) ###-####", "(0##) #### ####", "+41 ## ### ## ##", "1-800-###-####", "+353 d ### ####", "0### #######", "+61 d #### ####", "+1-d##-###-####"],
}
IDS = {
    "train": [("###-##-####", "SSN|social security number|soc. sec. no."), ("### ## ####", "SSN|social security number"), ("AA ## ## ## A", "NINO|NI number|national insurance number"), ("AA######A", "NI number|NINO:"), ("########A", "DNI|NIF|documento"), ("########-A", "DNI|documento nº"),
              ("X#######A", "NIE"), ("## ### ### ###", "Steuer-ID|tax id|Steuernummer"), ("d ## ## ## ### ### ##", "n° SS|numéro de sécurité sociale"), ("d##############", "n° SS|NIR"), ("######-####", "personnummer|pnr"), ("19######-####", "personnummer|pnr"), ("AA#######", "passport|passport no.|Reisepass Nr.|passeport"),
              ("A########", "passport number|passport no.|pasaporte"), ("#########", "BSN|passport no."), ("756.####.####.##", "AHV-Nr.|AHV"), ("###########", "PESEL|tax id|Steuer-ID"), ("AA #######", "passport|Reisepass")],
    "held": [("###.###.###-##", "CPF"), ("AAAAAA##A##A###A", "codice fiscale"), ("### ### ###", "social insurance number|tax file number|TIN"), ("######-####", "CPR|CPR number"), ("###### #####", "national identity number|personal number"), ("#### #### ####", "national identification number|identity number"),
             ("#######AA", "PPS number|tax id"), ("A#######", "passport no|passport"), ("C########", "Reisepassnummer|passport"), ("##/#######", "tax number|Steuernummer"), ("########", "national insurance no|identity card")],
}
HOSTS = {"train": "acme.example mail.orbit.test blue-yard.example corp.lumen.invalid web.de.example post.north.test".split(), "held": "harbor.test dept.vertex.example tall-pine.invalid inbox.delta.example kontor.invalid".split()}
SENTENCES = {
    "train": [
        "Please contact {name} about the invoice.", "The report was written by {name} and reviewed by {name}.", "{name} joined the team last spring.", "Yesterday {name} said the build was fine.", "Thanks, {name}", "Owner: {name}, phone {phone}, mail {email}.", "Send it to {name}, {address}, {town}.",
        "Best regards,\n{name}\n{address}\n{town}", "Dr. {name} will see you at nine.", "cc {name} and {name}", "According to {name}, the cache is wrong.", "Assigned to {name} ({email})", "Call {phone} or write to {email}.", "My number is {phone}, call after six.", "Phone: {phone}", "Fax {phone} / Tel. {phone}",
        "You can reach {name} at {phone} ext. 12.", "Her {label} is {id}.", "The form shows {label} {id} in plain text.", "{label}: {id}", "He gave his {label}, {id}, over the phone.", "The customer {name} has {label} {id} and lives at {address}.", "Our new office is at {address}, {town}.", "Deliver to {address}\n{town}",
        "He moved from {address} to {address} in May.", "Address: {address}, 12345 {town}", "Bitte {name} anrufen: {phone}.", "Herr {name} wohnt in der {address}.", "Gemeldet von {name} am Montag.", "Die Steuer-ID {taxid} gehört {name}.", "Merci de contacter {name} au {phone}.", "M. {name} habite {address}.",
        "Le colis part au {address}, {town}.", "Escribe a {name} o llama al {phone}.", "La señora {name} vive en {address}.", "Su {label} es {id}.", "Reviewed-by: {name} <{email}>", "Signed-off-by: {name} <{email}>", "@author {name}", "// TODO({name}): remove this", "| {name} | {phone} | {email} |",
        "{name} can be reached at {email} for questions.", "mailto:{email}", "Write to {email} or to {email}.", "Interview with {name}: what went wrong", "As {name} said on the call, it works.", "{name}; {name}; {name}", "Ask {name} before merging.", "{email} bounced, try {phone}.", "In memory of {name}, our first maintainer.",
        "found {phone} hard coded in the config", "test row: {label} {id}, {address}", "Do not log {id}, it is a {label}.", "Visit us: {address}.", "ping {name}!", "Did {name} sign off on this?", "She asked for {name}.", "The keys are with {name} in {town}.", "Meet {name} and Mrs {name} at {address}.",
        "Backup {phone}.", "Señor {name} llegó tarde.", "Signora {name} abita in {address}.", "Mevrouw {name} belde op {phone}.", "My identity card number is {id}.", "personal number {id} was leaked", "tax number: {id}", "The house at {address} is for sale.", "We met near {address} and walked.", "{address} is closed for repairs.", "desk phone {phone}", "Tel:{phone}", "{phone}", "{name}, {address}, {town}", "Parcel for {name}, {address}", "name = \"{name}\"; phone = \"{phone}\"",
    ],
    "held": [
        "We hired {name} for the night shift.", "{name} and {name} disagree on the design.", "A patch from {name} fixed the leak.", "Kind wishes from {name}.", "Escalate to {name} on weekends.", "Is {name} still on holiday?", "Written with help from {name}, who knows the parser.", "Prof. {name} teaches compilers.",
        "Then {name} restarted the server.", "If it fails, phone {phone}.", "mobile {phone}", "Our hotline: {phone} (weekdays)", "Text me on {phone} please.", "Leave a message at {phone}, then hang up.", "My {label} is {id}, please delete it.", "Enter {label} {id} twice.", "Leaked: {label} {id}", "her {label} ({id}) was in the dump",
        "They live at {address} in {town}.", "The parcel went to {address}, {town}.", "Meeting place: {address}.", "I used to rent a flat at {address}, near the river.", "Postal address\n{address}\n{town}", "Drop me a line: {email}", "Forwarded from {email} to {email}", "The alias {email} is gone.", "Frau {name} ist erreichbar unter {phone}.",
        "Bitte senden Sie es an {address}, {town}.", "Madame {name} a signé hier.", "Envoyez le dossier au {address}.", "Hablé con {name} ayer.", "El paquete llegó a {address}.", "Maintainers: {name}, {name}", "* {name} - initial version", "Photo by {name}", "The witness, {name}, saw nothing.", "{name} wrote:", "Dear {name},",
        "From: {name} <{email}>", "contact={email};tel={phone}",
    ],
}
#: Sentences without any item; {n} is a number, {W} a capitalised word, {X} an invented one.
PLAIN = {
    "train": [
        "Sprint {n} Green Street tasks are done.", "Fix {n} Road blocks before the freeze.", "Sprint {n} Road map review.", "Ticket ABC-{n} covers {n} Lane checks.", "We found {n} Dead Code Paths in the module.", "Order number {order} was shipped.", "See ticket {order} and build {ver}.", "Commit {hash} broke it.", "The invoice {order} is open.",
        "Bucket 415-5550-16 holds {n} spans.", "Span 120-450-993 is past the end.", "Sample 984-31-457 failed.", "Rev 000-1234-56 of the board.", "Build {n}.0203.4471-17 is out.", "Stamp 20310203-020704 in the log.", "The timestamp was 2024-05-17 10:22:31.", "Range {n}-{n} of file {n}.", "It took {n} 000 000 cycles.", "Total: {order} bytes",
        "{X} Systems shipped an older build.", "The {X} Index is a dashboard.", "{X} Score and {X} Pipeline are tools.", "Null Object and Strategy Pattern keep it simple.", "Quality Gate Amber since the North Harbour train.", "New York and Los Angeles are far.", "Happy Birthday to all.", "Visual Studio Code on Windows Server.", "See Open Source Summit {n}.",
        "The Data Access Layer uses Entity Framework.", "Monday Morning Meeting at Central Park.", "Pull Request {n} is ready.", "Table {n} Row {n} holds the value.", "Address {n} in the symbol table.", "Version {ver} of {X}.Core", "cognitive_complexity@0.1.0", "Pinned pkg.spans@2.3.1 here.", "[Inject] and @param stay.", "user@localhost is no address.",
        "Der Neue Markt {n} Punkte höher.", "Größere Änderung in Zeile {n}.", "La Ronda {n} empieza hoy.", "Place {n} items into the cache.", "Court {n} is free, Drive {n} is full.", "At (lines) dot (columns).", "IPv4 192.168.10.25 is local.", "Tracking 1Z999AA10123456784 arrived.", "ISBN 978-3-16-148410-0", "error CS8602: Possible dereference",
        "API Gateway and Load Balancer", "Lake {X} and Mount {X} are places.", "{X} Group bought {X} Media.", "The Red Queen and the White Rabbit", "In {town}, Central Station was closed.", "{X} Labs, {X} Software and {X} University", "{n} High Priority Items remain.", "Rank {n} of {n}, score 0.{n}", "Check {n} West Side cases.", "Las Vegas and New Delhi", "Costa Rica joined Sri Lanka.", "Buenos Aires or Rio Grande", "Happy New Year, everyone.", "Easter Monday is free.", "{n} Short Street names changed.", "{n} Wrong Way warnings", "Only {n} Quick Drive formats left.", "Sprint {n} Wide Avenue board is full.", "Phase {n} Small Court cases were dropped.", "{n} Good Place holders", "Reference {order} was booked.", "ID {order} in the table", "serial 4432-1190-77",
    ],
    "held": [
        "Sprint {n} Blue Lane backlog is empty.", "{n} Long Way loops remain.", "{n} Fast Lane check passed.", "Batch {n} Main Road rules apply.", "We closed {n} Old Square bugs.", "Case number {order} is closed.", "Your order {order} is on its way.", "Merged commit {hash} into main.", "Account {order} has no balance.", "Job {order} failed on node {n}.",
        "Release {ver} fixes {n} issues.", "On 2023-11-02 at 08:15:00 it rained.", "Lines {n}-{n} are dead.", "{X} Analytics sells reports.", "The {X} Engine is fast.", "Use Dependency Injection and Unit Tests.", "San Francisco and Hong Kong were first.", "Merry Christmas everyone.", "Google Cloud and Amazon Web Services", "The Style Guide says so.",
        "Main Street closed at nine.", "Step {n} Run Build", "Level {n} Boss Fight", "decorated with @override and @deprecated", "pip install tool@1.4.2", "10.0.0.{n} is the gateway", "Part 7781-2290-13 is missing.", "Checksum 8841290371 does not match.", "Garbage Collection and Thread Pool", "{X} Airlines lost my bag.", "The Black Forest is dark.", "Second Quarter Results",
        "{n} Square meters", "Grand Hotel and Royal Palace", "{X} Street Journal", "row {n}: 7712889 ok",
    ],
}
#: Cues of the loose lines.
CUES = {
    "idnum": ["SSN", "passport", "tax id", "tax number", "identity number", "personal number", "insurance number", "identity card", "DNI", "Steuernummer", "passport number", "social security number", "national id", "Ausweis", "Personalausweis", "NIF", "PESEL", "BSN", "fiscal number", "citizen number", "SSN", "documento"],
    "link": [" ", " ", " ", ": ", " is ", " (", " no. "],
    "phone": ["call", "phone", "tel.", "Tel:", "mobile", "fax", "ring", "telephone", "phone number", "anrufen:", "llamar al", "cell"],
    "other": ["order", "ticket", "invoice", "build", "tracking", "account", "serial", "part", "batch", "case", "reference", "ISBN", "revision", "sample", "order number", "article", "item", "article", "size", "count"],
}
_UPPER = string.ascii_uppercase
_SLOT = re.compile(r"\{(\w+)\}")


def _digits(rng: random.Random, pattern: str) -> str:
    """A number by its pattern; of letters only those that the pattern leaves open are drawn."""
    draw = {"#": lambda: str(rng.randrange(10)), "d": lambda: str(rng.randrange(1, 10)), "A": lambda: rng.choice(_UPPER)}
    return "".join(draw[c]() if c in draw else c for c in pattern)


def invented(rng: random.Random, world: str) -> str:
    """A word made of the world's syllables."""
    heads, tails = SYLLABLES[world]
    return "".join([*rng.choices(heads, k=rng.choice((1, 1, 2))), rng.choice(tails)]).capitalize()


def person(rng: random.Random, world: str) -> str:
    given = rng.choice(GIVEN[world]) if rng.random() < 0.5 else invented(rng, world)
    family = rng.choice(FAMILY[world]) if rng.random() < 0.5 else invented(rng, world)
    if rng.random() < 0.06:
        family = f"{family}-{rng.choice(FAMILY[world])}"
    if rng.random() < 0.06:
        given = f"{given}-{rng.choice(GIVEN[world])}"
    if rng.random() < 0.1:
        family = rng.choice(("van ", "van der ", "von ", "de ", "del ", "de la ", "di ", "af ")) + family
    form = rng.random()
    if form < 0.08:
        return f"{family}, {given}"
    if form < 0.16:
        return f"{given[0]}. {family}"
    if form < 0.2:
        return f"{family}, {given[0]}."
    if form < 0.28:
        return f"{given} {rng.choice(_UPPER)}. {family}"
    if form < 0.33:
        return f"{given.upper()} {family.upper()}"
    if form < 0.36:
        return f"{given} {family.upper()}"
    return f"{given} {family}"


def street(rng: random.Random, world: str) -> str:
    if rng.random() < 0.5:
        name = rng.choice(STREETS[world]) if rng.random() < 0.6 else invented(rng, world)
        unit = rng.choice(("", "", "", f"Flat {rng.randrange(1, 40)}, ", f"Apt {rng.randrange(1, 40)}B, ", f"Unit {rng.randrange(1, 40)}, "))
        return f"{unit}{rng.randrange(1, 900)}{rng.choice(('', '', '', 'A', 'C'))} {rng.choice(('', '', '', '', 'N ', 'West ', 'Old '))}{name} {rng.choice(ENGLISH_TYPES[world])}"
    pattern = rng.choice(OTHER_STREETS[world])
    number = "".join(str(rng.randrange(1, 10)) if c == "#" else c for c in pattern)
    return number.replace("{G}", invented(rng, world)).replace("{F}", rng.choice([*STREETS[world], invented(rng, world)]))


def mail(rng: random.Random, world: str) -> str:
    given, family = (rng.choice(t[world]).lower().replace("'", "") for t in (GIVEN, FAMILY))
    local = rng.choice((f"{given}.{family}", f"{given[0]}{family}", f"{given}_{family}", f"{family}{rng.randrange(100)}", f"{given}+news"))
    host = rng.choice(HOSTS[world])
    how = rng.random()
    if how < 0.08:
        return f"{local}[at]{host.replace('.', '[dot]')}"
    if how < 0.16:
        return f"{local} (at) {host.replace('.', ' dot ')}"
    if how < 0.22:
        return f"{local} @ {host}"
    return f"{local}@{host}".upper() if how < 0.26 else f"{local}@{host}"


def loose(rng: random.Random, words: Sequence[str]) -> list[tuple[str | None, str]]:
    """A line of random words around one item, or around something that only looks like one: what the item is shows in itself and in its cue alone."""
    some = lambda k: [rng.choice(words) for _ in range(k)]
    cap = lambda: rng.choice(words).capitalize()
    number = lambda: rng.choice((" ", " ", "-", ".", "/")).join("".join(str(rng.randrange(10)) for _ in range(rng.choice((2, 3, 3, 4)))) for _ in range(rng.choice((3, 3, 4, 5))))
    digits = lambda k: "".join(rng.choices(string.digits, k=k))
    capitals = lambda k: "".join(rng.choices(_UPPER, k=k))
    letters = lambda: rng.choice((capitals(rng.choice((1, 2))) + rng.choice(("", "", " ")) + digits(rng.choice((6, 7, 8, 9))), digits(rng.choice((7, 8, 9))) + rng.choice(("", "-", "")) + capitals(rng.choice((1, 2))), "".join(capitals(3) + digits(2) for _ in range(3)) + capitals(1)))
    several = lambda join: [("name", person(rng, "train")), (None, join), ("name", person(rng, "train"))]
    plain = lambda: digits(rng.randrange(6, 13))

    def cued(kind: str, body: str) -> list[tuple[str | None, str]]:
        link = rng.choice(CUES["link"])
        return [(None, rng.choice(CUES[kind]) + link), (kind if kind != "other" else None, body), (None, ")" * (link == " ("))]

    numbers = (
        lambda: cued("idnum", rng.choice((number, letters, plain))()), lambda: cued("phone", rng.choice(("", "", "+", "0")) + rng.choice((number, number, plain))()), lambda: cued("other", rng.choice((number, letters, plain))()), lambda: [("phone", "+" + number())],
        lambda: [(None, f"{rng.choice(CUES['idnum']).capitalize()} "), (None, cap())],
    )
    words_only = (
        lambda: [("name", person(rng, "train"))], lambda: [("name", person(rng, "train"))], lambda: [("name", person(rng, "train"))], lambda: several(rng.choice((" and ", " und ", " et ", " y ", ", ", "; ", " & "))), lambda: [("address", street(rng, "train"))],
        lambda: [(None, f"{cap()} {cap()}")], lambda: [(None, f"{invented(rng, 'train')} {cap()}")], lambda: [(None, f"{cap()} {cap()} {cap()}")], lambda: [(None, f"{rng.randrange(1, 900)} {cap()} {rng.choice(ENGLISH_TYPES['train'])} {rng.choice(words)}")],
    )
    item: list[tuple[str | None, str]] = rng.choice(numbers if rng.random() < 0.5 else words_only)()
    before, after = some(rng.randrange(4)), some(rng.randrange(4))
    if before and rng.random() < 0.6:
        before[0] = before[0].capitalize()
    return [(None, " ".join(before) + " " * bool(before)), *item, (None, rng.choice(("", " ", " ", ", ", ": ", " - ")) + " ".join(after) + rng.choice(("", ".", "!", "?", ";")))]


def sentences(world: str, count: int, seed: int, words: Sequence[str] = ()) -> Iterator[tuple[str, list[tuple[int, str, str]]]]:
    """`count` texts, each with its true items as (start, kind, item); with `words`, half of the sentences are loose ones of these words."""
    rng = random.Random(f"{world}-{seed}")
    for _ in range(count):
        parts: list[tuple[str | None, str]] = []
        for _ in range(rng.choice((1, 1, 2, 3))):
            parts += loose(rng, words) if words and rng.random() < 0.5 else _sentence(rng, world, rng.random() < 0.45)
            parts.append((None, rng.choice((" ", " ", "\n", "\n\n"))))
        text, items = "", []
        for kind, piece in parts:
            if kind:
                items.append((len(text), kind, piece))
            text += piece
        yield text, items


def _sentence(rng: random.Random, world: str, plain: bool) -> list[tuple[str | None, str]]:
    template = rng.choice((PLAIN if plain else SENTENCES)[world])
    pattern, labels = rng.choice(IDS[world])
    label = rng.choice(labels.split("|"))
    make = {
        "name": lambda: ("name", person(rng, world)), "email": lambda: ("email", mail(rng, world)), "phone": lambda: ("phone", _digits(rng, rng.choice(PHONES[world]))), "address": lambda: ("address", street(rng, world)),
        "id": lambda: ("idnum", _digits(rng, pattern)), "taxid": lambda: ("idnum", _digits(rng, "## ### ### ###")), "label": lambda: (None, label), "town": lambda: (None, rng.choice(TOWNS[world])), "n": lambda: (None, str(rng.randrange(1, 999))),
        "order": lambda: (None, _digits(rng, rng.choice(("d######", "d########", "d###-####-##", "d#########", "d##-#######", "d#### ####")))), "ver": lambda: (None, f"{rng.randrange(9)}.{rng.randrange(30)}.{rng.randrange(1000)}"),
        "hash": lambda: (None, "".join(rng.choices("0123456789abcdef", k=10))), "X": lambda: (None, invented(rng, world)), "W": lambda: (None, rng.choice(STREETS[world])),
    }
    return [(None, literal) if i % 2 == 0 else make[literal]() for i, literal in enumerate(_SLOT.split(template)) if literal]
