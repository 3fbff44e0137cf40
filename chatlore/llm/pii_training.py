"""Labelled sentences for the segment model, composed at random from a fixed seed.

Names are invented from syllables, numbers follow public formats, and hard negatives count things in
the same formats. Each sentence comes with a lexicon that knows most of its names, so that the model
learns how far to trust it. The sentences around them are of everyday office talk, invented for this
purpose; a test holds that none of their fixed phrases stands in the archive.
"""

from __future__ import annotations

import random

from chatlore.llm.pii import WORD, Lexicon

SEED, N = 20010205, 3600

_ON = "b c d f g h j k l m n p r s t v w z br dr fr gr kl pr st tr th sch".split()
_VO = "a e i o u ie ei ou á é ö ü".split()
_CO = "n r l s t m nd rt x ck ne la".split()


def _stem(r: random.Random, lo: int, hi: int) -> str:
    return "".join(r.choice(_ON) + r.choice(_VO[:6] if r.random() < 0.8 else _VO) for _ in range(r.randint(lo, hi))) + r.choice(_CO)


FILL = [
    "Lunch moved to one o'clock.", "Did you see the game last night?", "I forgot my umbrella again.", "Nobody likes {w} in the rain.", "My tea went cold while {w} was loading.",
    "Wir haben gestern lange gewartet.", "Le café du coin est fermé.", "Mañana hay mercado en la plaza.", "If {w} breaks we go home, and if {w} holds we stay.", "ok", "sure", "Updated {w} to {n}, all good now.",
    "@{w} we counted {n} apples in {w}.", "Does {w} need a lid?", "Which of these belongs to {w}, and should {w} stay?", "", "Green tea or black coffee?", "It snowed all weekend.", "The Long Winter was a dull film.", "Half of {w} burnt, the other half did not.",
]
NAME_CTX = [
    "{X}", "— {X}", "-- {X}", "– {X}", "cheers, {X}", "{X} (evenings)", "{X}, front desk", "go and see {X}", "have you met {X} yet?", "{X} sang at the party", "I sat next to {X} on the train",
    "could {X} bring the cake?", "{X} owes me a coffee", "ask {X}", "is {X} coming to dinner?", "grüß {X} recht schön", "c'est {X} qui chante", "saluda a {X} de mi parte", "was it {X} or someone else", "{X} → kitchen duty", "cc {X}", "merci {X}", "danke {X}", "mil gracias {X}",
    "{X} painted the fence", "photo by {X}", "sincerely, {X}", "{X} won the raffle", "from {X}", "{X} is my neighbour", "well done {X}!", "according to {X}, we are late", "{X}: sorry for the noise", "by {X}", "to {X}", "with {X}", "for {X}", "{X} says hello",
    "the new teacher is called {X}", "we all miss {X}", "it was {X}, not me", "the parcel is for {X}", "invite {X} too", "{X} and I went home", "Herr Ober fragt nach {X}", "avec {X}", "con {X}", "mit {X}", "de {X}", "any news from {X}?", "tell {X} that dinner is cold", "blame {X}",
]
PHONE_CTX = ["{X}", "tel {X}", "tel. {X}", "tel: {X}", "fax {X}", "fax: {X}", "pager {X}", "phone {X}", "mobile {X}", "dial {X} for the bakery", "the florist's number is {X}", "you can ring {X} any evening", "sms {X} when you land", "Anruf an {X} genügt", "telefonisch unter {X}",
             "appelez le {X} avant midi", "mi móvil: {X}", "marca {X} desde casa", "{X} is my cell", "{X} or {X2} after work", "my landline became {X}", "voicemail at {X}", "{X} (ring twice)", "reach grandma on {X}", "hotline {X}", "{X} rings but nobody picks up", "wähl {X}", "cell: {X}",
             "try {X} instead", "leave a voicemail on {X} if you can", "the fax machine is at {X}"]
EMAIL_CTX = ["{X}", "cc {X}", "mail the recipe to {X}", "{X} wants the photos", "my inbox is {X}", "subscribe with {X} for the choir", "got it from {X} on Sunday", "{X} is full again", "schreib an {X}", "envoyez la photo à {X}", "<{X}>", "({X})", "correo: {X}", "e-mail: {X}",
             "was {X} a typo?", "rsvp to {X} by noon", "{X}, {X2}", "drop {X} a note"]
ID_CTX = ["passport-no {X}", "passport# {X}", "SSN {X}", "ssn: {X}", "nat. id card {X}", "DNI {X}", "NIE: {X}", "Steuer-Id. {X}", "Steuernummer: {X}", "driver licence {X}", "driving licence no. {X}", "tax id {X}", "social security {X}", "id card {X}", "my id is {X}",
          "the bank asked for an id, so I gave {X}", "the visa form shows passport-no {X}", "identity card {X} got lost on the ferry", "visitor badge for {N}: {X}", "{N}, id {X}, arrives by train", "numéro fiscal {X}", "sécurité sociale : {X}", "Reisepass {X}", "Personalausweis {X}", "Führerschein {X}",
          "pasaporte {X}", "permis de conduire {X}", "carné {X}", "why is {X} printed on my mug?", "someone wrote {X} on the wall", "delete {X} from the form, it is mine", "{N} / {X}", "I typed {X} by pure chance", "NINO {X}", "{X} belongs to {N}"]
ADDRESS_CTX = ["{X}", "pick me up at {X}", "the shop moved to {X}", "party at {X} on Sunday", "send flowers to {X}", "the bus stops near {X}", "{X} has a red door", "rendez-vous au {X}", "she grew up at {X}", "Treffpunkt: {X}", "nos vemos en {X}", "{N}\n{X}\ntel {P}\n{E}", "{N}\n{X}", "{N}, {X}",
               "{X}\ntel {P}", "deliver the sofa to {X}", "at {X}", "our address: {X}", "is {X} far from the station?", "meet in front of {X} at noon", "for {N}: {X}", "the letter for {N} reached {X} last week"]
THING = [
    "part {d3}-{d2}-{d4} fits the old lamp", "serial {d3}-{d2}-{d4} of the kettle", "version {d3}.{d3}.{d4} runs warmer than {d1}.{d2}", "size {d9} at offset {d4}", "epoch {e10} was a Sunday", "the server at 10.{d3}.{d3}.{d3} port {d4}", "we sent {d3}.{d3}.{d4} bytes within {d2} hours",
    "ticket AB-{d4}-{d2} from 20{d2}-0{d1}-1{d1}", "letter {d8} is a joke", "record {d8} shows a cat", "logo@{d1}x.png looks odd", "coffee: {d2} @ {d1}.20 a cup, row {d2} of the hall", "{d3}-{d3} plates washed, {d2} in the sink", "item {d3}-{d2}-{d4} on the shelf",
    "goal keeper of the {d1}.{d2} league", "@{w} / table {d3}", "seat {w}@{d2} is upstairs", "Silver Moon was the title of song {d1}", "Red Lion beats Old Oak by {d1} to {d1} in the Sunday League", "checksum {d8} holds", "hash {d4}a{d6} differs", "commit {d4}e{d6} by the bot", "route {d2}, the scenic one", "{d2} laps this week on the inner track",
    "{d3}, the quiet side", "{d1} of the tall trees", "barcode {d7}c", "order {d3}.{d3}.{d4} of beans", "parts {d3}-{d3}-{d4} and {d3}-{d3}-{d4} are blue", "chapter {d3} page {d4}", "The Third Door by the Green River", "From {d2}:{d2} till {d2}:{d2} the shop sleeps", "Golden Gate is closed", "Weekly Menu for Red Lion",
    "model {d3}-{d2}-{d4} of the toaster", "lot {d8} out of bin {d6}", "invoice {d8} is paid", "{d4} stamps in {d2} albums", "it weighs {d3} {d4} {d3} grams", "isbn {d3}-{d1}-{d4}-{d4}", "score {d3}-{d2}", "{d3}-{d2}-{d4} pieces in the puzzle of the cat", "{d3}.{d3}.{d4} times around the lake", "sku {d3} {d2} {d4}",
    "{d3} {d3} {d4} is the sum of the votes", "{d10} bytes free", "timestamp {e10}", "{d8} rows in the ledger", "bug {d6}-{d4} is old", "{d3}-{d2}-{d4} of the drill", "2001-0{d1}-1{d1} {d2}:{d2}:{d2}", "{d1}.{d1}.{d1}-{d2}", "New Year starts on Monday", "Lost Bottle Green Hat", "North Wind and Cold Soup", "Big Table, Small Chair", "please bring Brown Bread and White Wine",
    "on Monday Morning or Friday Evening", "User Guide for Blue Box", "Open Source Tea Club", "{w}@{w} is a tag, not mail", "@{w} wrote {d2} poems", "the {d2} way road", "{d2} long lane songs", "{d1} place mats and a square", "{d3} drive letters",
]


def _digits(r: random.Random, n: int) -> str:
    return str(r.randint(1, 9)) + "".join(str(r.randint(0, 9)) for _ in range(n - 1))


def _phone(r: random.Random) -> str:
    d = lambda n: _digits(r, n)
    return r.choice([
        f"{d(3)}-555-01{d(2)}", f"({d(3)}) 555-01{d(2)}", f"{d(3)}.555.01{d(2)}", f"+1 {d(3)} 555 01{d(2)}", f"001{d(3)}55501{d(2)}", f"{d(3)} / 555 / 01{d(2)}", f"{d(3)}-{d(3)}-{d(4)} x{d(2)}",
        f"+44 20 7946 0{d(3)}", f"020 7946 0{d(3)}", f"+49 (0)30 23125-{d(3)}", f"030 {d(5)}-{d(2)}", f"01 99 00 {d(2)} {d(2)}", f"+33 1 99 00 {d(2)} {d(2)}", f"+34 {d(3)} {d(3)} {d(3)}", f"0{d(4)} {d(6)}", f"+{d(2)} {d(3)} {d(7)}",
        f"1-{d(3)}-{d(3)}-{d(4)}", f"+1-{d(3)}-{d(3)}-{d(4)}", f"{d(3)} {d(3)} {d(4)}",
    ])


def _email(r: random.Random) -> str:
    local = r.choice([_stem(r, 1, 2), f"{_stem(r, 1, 2)}.{_stem(r, 1, 2)}", f"{_stem(r, 1, 2)}_{_stem(r, 1, 2)}", f"{_stem(r, 1, 1)}-{_stem(r, 1, 1)}", f"{_stem(r, 1, 2)}{r.randint(1, 99)}", f"{_stem(r, 1, 1)}+news"])
    domain = r.choice(["example.org", "example.com", "mail.example", "lists.example.net", "corp.test", "inbox.invalid", "post.example"])
    local = local.translate(str.maketrans("áéöü", "aeou"))
    x = r.choice([f"{local}@{domain}"] * 4 + [f"{local} (at) {domain.replace('.', ' (dot) ')}", f"{local} [at] {domain}", f"{local} @ {domain}", f"{local} (at) {domain}"])
    return x.upper() if r.random() < 0.12 else x


def _id(r: random.Random) -> str:
    d = lambda n: _digits(r, n)
    c = lambda: r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ")
    return r.choice([f"9{d(2)}-{d(2)}-{d(4)}", f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", f"{c()}{d(7)}", f"{d(8)}{c()}", f"{d(2)} {d(3)} {d(3)} {d(3)}", f"{c()}{d(3)}-{d(4)}-{d(2)}", f"{d(6)}-{d(4)}", f"{c()}{c()}{d(6)}{c()}", f"{c()}{d(8)}"])


def _address(r: random.Random) -> str:
    t = lambda: _stem(r, 1, 2).title()
    n = r.randint(1, 1999)
    street = r.choice(["Street", "Avenue", "Road", "Lane", "Drive", "Court", "Way", "Blvd.", "Row", "St", "Hill Road", "Place"])
    x = r.choice([
        f"{n} {t()} {street}", f"{n} {t()} {t()} {street}", f"{n} North {t()} {street}", f"{n} {t()}'s Row", f"{t()}weg {n % 200}", f"{t()}str. {n % 200}a", f"{t()}platz {n % 90}", f"Am {t()} {t()} {n % 50}b",
        f"Calle {t()} {n % 90}, {n % 5 + 1}º A", f"C/ {t()} {n % 90}", f"Plaza del {t()} {n % 90}", f"{n % 90} rue de la {t()}", f"{n % 90} place des {t()}-{t()}", f"{n % 60} bis chemin du {t()}", f"P.O. Box {n}", f"Postfach {n}", f"Apartado {n}",
    ])
    x += r.choice(["", "", f", {t()}", f", Apt {n % 40}, {t()}", f", 0{r.randint(1000, 9999)} {t()}", f"\n{t()} A{n % 9} {n % 9}XZ"])
    return x


def sentences(n: int = N, seed: int = SEED) -> list[tuple[str, list[tuple[int, int, str]], Lexicon]]:
    r = random.Random(seed)
    out = []
    for _ in range(n):
        given: set[str] = set()
        family: set[str] = set()

        def name() -> tuple[str, str]:
            g, f = _stem(r, 1, 2), _stem(r, 2, 3)
            if r.random() < 0.9:
                given.add(g)
            if r.random() < 0.9:
                family.add(f)
            G, Fa = g.title(), f.title()
            if r.random() < 0.12:
                Fa += "-" + _stem(r, 1, 2).title()
            x = r.choice([f"{G} {Fa}"] * 5 + [f"{G[0]}. {Fa}", f"{G} {r.choice('ABCDEJ')}. {Fa}", f"{Fa}, {G}"])
            style = r.random()
            if style < 0.1:
                x = x.upper()
            elif style < 0.2 and "." not in x:
                x = x.lower()
                given.add(g)
                family.add(f)
            title = r.choice(["", "", "", "", "", "Dr. ", "Mr. ", "Ms ", "Frau ", "Mme ", "Prof. "]) if "," not in x else ""
            return title, x

        parts: list[tuple[str, str | None]] = []
        make = {"phone": _phone, "email": _email, "id_number": _id, "address": _address}

        def put(context: str, kind: str, value: str) -> None:
            rest = context.replace("{X2}", "{2}")
            while rest:
                k = min((i for i in (rest.find(m) for m in ("{X}", "{N}", "{P}", "{E}", "{2}")) if i >= 0), default=-1)
                if k < 0:
                    parts.append((rest, None))
                    break
                if k:
                    parts.append((rest[:k], None))
                m = rest[k : k + 3]
                if m == "{N}" or m == "{X}" and kind == "name":
                    title, x = name()
                    parts.append((title, None))
                    parts.append((x, "name"))
                elif m == "{P}":
                    parts.append((_phone(r), "phone"))
                elif m == "{E}":
                    parts.append((_email(r), "email"))
                else:
                    parts.append((make[kind](r) if m == "{2}" else value, kind))
                rest = rest[k + 3 :]

        def plain() -> str:
            x = r.choice(FILL)
            while "{w}" in x:
                x = x.replace("{w}", _stem(r, 2, 3), 1)
            x = x.replace("{n}", str(r.randint(1, 900)))
            return x.upper() if r.random() < 0.15 else x.lower() if r.random() < 0.1 else x

        for _ in range(r.choice([1, 1, 1, 2])):
            if r.random() < 0.4:
                parts.append((plain() + " ", None))
            what = r.random()
            if what < 0.26:
                put(r.choice(NAME_CTX), "name", "")
            elif what < 0.38:
                put(r.choice(PHONE_CTX), "phone", _phone(r))
            elif what < 0.46:
                put(r.choice(EMAIL_CTX), "email", _email(r))
            elif what < 0.58:
                put(r.choice(ID_CTX), "id_number", _id(r))
            elif what < 0.70:
                place = _address(r)
                if r.random() < 0.3:  # streets and towns are sometimes in the lexicon
                    for word in WORD.findall(place):
                        (given if r.random() < 0.5 else family).add(word.lower())
                put(r.choice(ADDRESS_CTX), "address", place)
            elif what < 0.95:
                x = r.choice(THING)
                while "{" in x:
                    k = x.index("{")
                    c = x[k + 1 : x.index("}")]
                    v = _stem(r, 2, 3) if c == "w" else "1" + _digits(r, 9) if c == "e10" else _digits(r, int(c[1:]))
                    x = x[:k] + v + x[k + len(c) + 2 :]
                parts.append((x, None))
            else:
                x = " ".join(_stem(r, 2, 3) for _ in range(r.randint(2, 5)))
                parts.append((x.title() if r.random() < 0.5 else x, None))
            parts.append((r.choice([" ", ". ", "\n"]), None))
        if r.random() < 0.4:
            parts.append((plain(), None))
        # a few common words are in every lexicon by mistake
        given.update(r.sample(["red", "green", "silver", "the", "old"], 1 if r.random() < 0.2 else 0))
        text, gold = "", []
        for x, kind in parts:
            if kind:
                gold.append((len(text), len(text) + len(x), kind))
            text += x
        out.append((text, gold, Lexicon(given, family)))
    return out


# Ordinary lower-case words that stand where a name could.
ORDINARY = ("people friends neighbours everyone nobody somebody anyone again about it that one kitchen garden window door table chair water bread coffee music rain snow morning evening "
            "tonight later before after lunch dinner never once more less same thing other side house train school work tired slow fast hungry late early much very really just then but and or so").split()


def lower_case(n: int = N // 2, seed: int = SEED + 1) -> list[tuple[str, list[tuple[int, int, str]], Lexicon]]:
    """Lower-case names that few or no texts write otherwise, and ordinary words in their places."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        g, f = _stem(r, 1, 2), _stem(r, 2, 3)
        is_name = r.random() < 0.4
        if not is_name:
            g, f = (r.choice(ORDINARY) if r.random() < 0.8 else x for x in (g, f))
        seen = (0.85, 0.85) if is_name else (0.06, 0.06)
        lex = Lexicon((), (), [g] if r.random() < seen[0] else [], [f] if r.random() < seen[1] else [])
        x = f"{f}, {g}" if r.random() < 0.1 else f"{g} {f}"
        ctx = r.choice(NAME_CTX)
        ctx = ctx.lower().replace("{x}", "{X}") if r.random() < 0.5 else ctx
        left = r.choice(FILL).replace("{w}", _stem(r, 2, 3)).replace("{n}", str(r.randint(1, 900))) + " " if r.random() < 0.4 else ""
        text, at = left + ctx.replace("{X}", x), len(left) + ctx.index("{X}")
        out.append((text, [(at, at + len(x), "name")] if is_name else [], lex))
    return out


def phrases() -> list[str]:
    """All fixed phrases of the sentences around what is labelled."""
    import re

    every = [*FILL, *NAME_CTX, *PHONE_CTX, *EMAIL_CTX, *ID_CTX, *ADDRESS_CTX, *THING]
    return sorted({p.strip() for c in every for p in re.split(r"\{[^{}]*\}|\n", c) if p.strip()})
