"""Personal information in free text, by a semi-Markov conditional random field.

Candidate segments (whole spans with a type) are proposed over the folded text, scored by features
of the whole span and of its surroundings, and a bounded-entity dynamic program chooses boundaries
and types of all entities of a text together. The chain has transitions: an entity is also scored by
the type of the entity right before it and what lies between them (``name>address,line``), or by
having none there (``O>name``). Plain text between entities scores zero. Weights of spans and
transitions are trained here, by maximum likelihood with forward and backward sums, on labelled
sentences that are composed at random (``pii_training``); no text of any collection is used.

Names need a lexicon where case tells nothing. It is mined from the whole collection: words that are
written in title case before (or after) many different title-case partners, and seldom in lower
case. A word is sure if it has at least ``SURE_SHARE`` of the partners that well connected words of its
role have (the 90th percentile), so what counts as many follows from the collection; others are kept
as rare ones, which the model trusts less. The lexicon is a table; up to ``BROADCAST_WORDS`` words it
is sent to the workers, beyond that each text gets those of its words that the table knows by a join.
Pairs of lower-case words that it doesn't know are candidates too, by their surroundings.

Kinds: email, phone, id_number, address, name. Defined cases: null and blank texts hold nothing and
stay as they are; segments and texts of any length are read whole; repeated rows give repeated
results; an empty table gives no rows; other columns stay.

Scale: one pass over the rows in Arrow batches with no shuffle, after one partial aggregate for the
lexicon; texts are shuffled only where the lexicon is too large to be sent.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlore.shared import cut, fresh

KINDS = ("email", "phone", "id_number", "address", "name")
BROADCAST_WORDS = 200_000
SURE_SHARE = 0.2
NEAR = 6  # characters between neighbours of the chain
CACHE = 50_000

# -- folding: compatibility forms and dashes, with the place of each character ---------------------
_DASH = dict.fromkeys(map(ord, "‐‑‒–−﹣－"), "-")


def fold(text: str) -> tuple[str, list[int] | None]:
    """Folded text and, where it isn't the text itself, the source index of each character."""
    if text.isascii():
        return text, None
    out, at = [], []
    for i, c in enumerate(text):
        if c.isascii() or c.isalpha() and unicodedata.is_normalized("NFKC", c):
            out.append(c)
            at.append(i)
            continue
        if unicodedata.category(c) == "Cf":
            continue
        for x in unicodedata.normalize("NFKC", c).translate(_DASH):
            out.append(x)
            at.append(i)
    at.append(len(text))
    return "".join(out), at


_DIGIT = re.compile(r"\d")


# -- candidates ------------------------------------------------------------------------------------
_L = r"[^\W\d_]"
EMAIL = re.compile(
    r"(?<![\w.+])[\w][\w.+\-]*(?:\s?@\s?|\s?[(\[{]\s?at\s?[)\]}]\s?|\sat\s(?=[\w\-]+\sdot\s))[\w\-]+(?:(?:\.|\s?[(\[{]\s?dot\s?[)\]}]\s?|\sdot\s|\s\.\s)[\w\-]+)+", re.I)
NUMBER = re.compile(r"(?<![\w.@#])(?:\+|00)?\(?\d(?:[ \d()\-/]|\.(?! )){4,28}\d(?:\s?(?:x|ext\.?|poste|Durchwahl)\s?\d{1,5})?(?!\w)(?![.@]\w)", re.I)
CODE = re.compile(r"(?<![\w\-])(?=[A-Za-z0-9\-]*\d[A-Za-z0-9\-]*\d[A-Za-z0-9\-]*\d)[A-Za-z]{0,3} ?\d+[A-Za-z]{0,2}(?:[\-./ ]\d+[A-Za-z]?){0,4}(?: [A-Z])?(?![\w\-])")
# Words that make a street address, in English, German, French and Spanish.
_AFTER = (r"street|st|avenue|ave|road|rd|lane|ln|drive|dr|court|ct|way|boulevard|blvd|row|hill|place|pl|square|sq|terrace|close|crescent|"
          r"parkway|pkwy|highway|hwy|alley|walk|mews|quay|gardens|grove|trail")
_GERMAN = r"(?:straße|strasse|str\.|str|weg|platz|gasse|allee|ufer|damm|ring|hof|steig|graben|chaussee|wall|markt)"
_BEFORE = (r"rue|avenue|av\.|boulevard|bd\.?|place|chemin|impasse|allée|allee|quai|route|cours|square|sentier|passage|"
           r"calle|c/|avenida|avda\.?|av\.|plaza|plazuela|paseo|camino|carretera|ronda|travesía|callejón|via|piazza")
_WORDS = rf"(?:{_L}[\w'’\-]*\.?|(?:d'|l'|d’|l’){_L}[\w'’\-]*)"
_TAIL = (rf"(?:,?\s(?:Apt|Apartment|Suite|Unit|Flat|App|Wohnung|Appt|Piso|#)\.?\s?\w{{1,5}})?(?:,\s?\d{{1,2}}\s?[ºo°]\s?\w)?"
         rf"(?:[,\n]\s?\d{{4,5}}\s(?-i:[A-ZÀ-Þ])[\w\-]+(?:\s(?-i:[A-ZÀ-Þ])[\w\-]+)?|[,\n]\s?(?-i:[A-ZÀ-Þ][a-zà-ÿ])[\w\-]*(?:\s(?-i:[A-ZÀ-Þ][a-zà-ÿ])[\w\-]*)?(?:\s(?-i:[A-Z])\w\s\d\w{{2}})?)?")
ADDRESS = [
    # 397 Saltmarsh Avenue, 1871 Tollkeeper's Row
    re.compile(rf"(?<![\w.,:/\-])\d{{1,5}}[a-z]?,?\s(?:{_WORDS}\s){{1,4}}(?:{_AFTER})\b\.?{_TAIL}", re.I),
    # 20 place des Trois-Fontaines, 53 bis chemin de la Glycine
    re.compile(rf"(?<![\w.,:/\-])\d{{1,4}}(?:\s?(?:bis|ter|[a-z]))?,?\s(?:{_BEFORE})\s(?:(?:de|du|des|la|le|les|l'|d')\s?)*{_WORDS}(?:\s{_WORDS})?{_TAIL}", re.I),
    # Lindenhofweg 130, Mühlengrabenstr. 63a
    re.compile(rf"(?<![\w.\-])(?:(?-i:[A-ZÄÖÜ])[\w\-]*\s){{0,2}}{_L}[\w\-]*?{_GERMAN}\s\d{{1,4}}\s?[a-z]?\b(?![.:]\d){_TAIL}", re.I),
    # Am Alten Speicher 6a
    re.compile(rf"(?<![\w.\-])(?:Am|An\sder|An\sden|Im|In\sder|Zum|Zur|Auf\sdem|Auf\sder|Unter\sden|Hinter\sdem)\s(?:(?-i:[A-ZÄÖÜ])[\w\-]*\s){{1,3}}\d{{1,4}}\s?[a-z]?\b(?![.:]\d){_TAIL}", re.I),
    # Calle Mirlo 79, C/ Retama 35
    re.compile(rf"(?<![\w.\-])(?:{_BEFORE})\s?(?:(?:de|del|la|las|los|el)\s)*{_WORDS}(?:\s{_WORDS}){{0,2}},?\s(?:n[.º°]\s?)?\d{{1,4}}\s?[a-z]?\b(?![.:]\d){_TAIL}", re.I),
    # P.O. Box 8907
    re.compile(rf"(?<!\w)(?:P\.?\s?O\.?\s?Box|Post\sOffice\sBox|Postfach|Apartado(?:\sde\s[Cc]orreos)?|Bo[iî]te\s[Pp]ostale|B\.?P\.?|Casilla)\s(?:n[.º°]\s?|no\.?\s?)?\d[\d ]{{0,6}}\b{_TAIL}", re.I),
]
# parts of a street are on one line; only what follows it may begin a new one
ADDRESS = [re.compile(p.pattern.replace(r"\s", " "), p.flags) for p in ADDRESS]
_STREET = re.compile(rf"(?<!\w)(?:{_AFTER}|{_BEFORE})(?!\w)|{_GERMAN}(?![^\W\d_])", re.I)
_BOX = re.compile(r"P\.?\s?O\.?\s?Box|Postfach|Apartado|postale|Casilla|^B\.?P\.?", re.I)
WORD = re.compile(rf"{_L}+(?:['’\-]{_L}+)*")
INITIAL = re.compile(r"[^\W\d_a-z]\.")
# Forms of address.
TITLES = frozenset("mr mrs ms miss mx dr prof sir madam herr frau mme mlle m monsieur madame sr sra srta don doña señor señora".split())
# Words near a number that tell what it counts.
CUES = {
    "phone": r"tel|téléphone|telefon|teléfono|phones?|telephone|fax|telefax|pager|call|calls|called|calling|mobile|cell|handy|móvil|text|texted|sms|whatsapp|ring|dial|voicemail|hotline|extension|reach|on call|rückruf|anruf\w*|durchwahl|erreichbar|rappel\w*|appel\w*|joign\w*|llám\w*|llam\w*|marc\w*",
    "id": r"passports?|reisepass|passeport|pasaporte|ssn|social security|sécurité sociale|seguridad social|sozialversicherung\w*|licen[cs]e|licence|driver'?s?|führerschein|permis|carné|dni|nie|nif|nino|insurance|steuer\w*|tax|taxpayer|fiscal|national id|identity|identification|identité|identidad|personalausweis|ausweis\w*|id card|id number|ids?|visitor|visa|permit",
    "thing": r"builds?|parts?|tickets?|messages?|hosts?|ports?|offsets?|sizes?|epochs?|bytes?|versions?|releases?|revisions?|commits?|rooms?|items?|orders?|invoices?|pages?|lines?|rows?|issues?|files?|serial|models?|sku|batch|lots?|cases?|ref|hash|checksum|sha|md5|server|ip|address of|counter|sensor|error|code|score|total|sum|price|cost|record|records|counts?|seconds|ms|percent|volume|chapter|section|bug|isbn|barcode|stock|printer|scanner",
}
_CUES = {k: re.compile(rf"(?<!\w)(?:{v})(?!\w)", re.I) for k, v in CUES.items()}
# What is counted or described also follows the number, at once or after one word.
_CUES_AFTER = _CUES | {"thing": re.compile(rf"^\W*(?:[^\W\d_]+\W+)?(?:{CUES['thing']}|of the|of an?|kb|mb|gb|times|units|pieces|euros?|dollars?)(?!\w)", re.I)}
FILE_TYPES = frozenset("png jpg jpeg gif svg txt md py js ts css html json xml csv pdf zip log sh c h cc go rs java 2x 3x".split())


class Lexicon:
    """Words seen as given and as family names, in lower case, and those seen with few partners."""

    def __init__(self, given=(), family=(), rare_given=(), rare_family=()):
        self.given, self.family = frozenset(given), frozenset(family)
        self.rare_given, self.rare_family = frozenset(rare_given), frozenset(rare_family)

    @classmethod
    def of(cls, codes) -> Lexicon:
        """From words with their role before them: G, F; g, f for the rare ones."""
        sets: dict[str, list[str]] = {"G": [], "F": [], "g": [], "f": []}
        for c in codes:
            sets[c[0]].append(c[1:])
        return cls(*sets.values())


class Text:
    """A folded text with its candidate segments: (start, end, kind, features)."""

    def __init__(self, text: str, lexicon: Lexicon, w: dict[str, float] | None = None, unknown: bool = True):
        """With weights, unknown lower-case pairs that score nothing are left out: they are never chosen."""
        self.unknown = unknown
        self.s, self.at = fold(text)
        self.lexicon, self.w = lexicon, w
        self.segments: list[tuple[int, int, str, list[str]]] = []
        s = self.s
        if "@" in s or "at" in s:
            for m in EMAIL.finditer(s):
                self._add(m.start(), m.end(), "email", self._email(m.group()))
        if _DIGIT.search(s):
            self._numbers()
            for n, p in enumerate(ADDRESS):
                for m in p.finditer(s):
                    self._add(m.start(), m.end(), "address", self._address(m.group(), n, m.start()))
        self.lonely = not self.segments
        self._names()
        self.segments.sort(key=lambda x: (x[0], x[1]))

    def _add(self, a: int, b: int, kind: str, features: list[str]) -> None:
        self.segments.append((a, b, kind, [f"{kind}|{f}" for f in features]))

    def _around(self, a: int, b: int) -> list[str]:
        """Cues before and after a span, the nearest words first."""
        left, right = self.s[max(0, a - 32) : a], self.s[b : b + 28]
        left = re.split(r"[.;?!\n]\s", left)[-1]
        right = re.split(r"[.;?!\n](?:\s|$)", right)[0]
        out = []
        for k, p in _CUES.items():
            if p.search(left):
                out.append(f"before={k}")
            if _CUES_AFTER[k].search(right):
                out.append(f"after={k}")
        return out or ["no cue"]

    @staticmethod
    def _email(x: str) -> list[str]:
        domain = re.split(r"@|[(\[{]\s?at\s?[)\]}]|\sat\s", x, maxsplit=1, flags=re.I)[-1]
        last = re.split(r"[^A-Za-z0-9]+", domain.strip().rstrip(")]} "))[-1]
        form = "plain" if re.fullmatch(r"[^\s@]+@[^\s@]+", x) else "spaced" if "@" in x else "spelt"
        tail = "file" if last.lower() in FILE_TYPES else "letters" if last.isalpha() and len(last) > 1 else "other"
        return ["bias", f"form={form}", f"tail={tail}", f"form,tail={form},{tail}"]

    def _numbers(self) -> None:
        s = self.s
        spans = set()
        for m in NUMBER.finditer(s):
            a, b = m.span()
            spans.add((a, b))
            cuts = [a, *[a + x.end() for x in re.finditer(r" ", m.group())]]
            ends = [*[a + x.start() for x in re.finditer(r" ", m.group())], b]
            for i in cuts:
                for j in ends:
                    if j - i >= 7 and sum(map(str.isdigit, s[i:j])) >= 7:
                        spans.add((i, j))
        for a, b in spans:
            x = s[a:b]
            if sum(map(str.isdigit, x)) < 7 or not (x[-1].isalnum()):
                continue
            shape = re.sub(r"\d+", lambda m: str(len(m.group())), x.split("x")[0].rstrip())
            digits = sum(map(str.isdigit, x))
            begins = "+" if x[0] == "+" else "00" if x.startswith("00") else "0" if x[0] == "0" else "(" if x[0] == "(" else "digit"
            edge = "inside" if (a, b) not in spans or any(p <= a and b <= q and (p, q) != (a, b) for p, q in spans) else "whole"
            around = self._around(a, b)
            feats = ["bias", f"shape={shape}", f"begins={begins}", f"digits={min(digits, 14)}", f"edge={edge}",
                     f"grouped={bool(re.search('[^0-9]', x[1:]))}", f"ip={bool(re.fullmatch(r'[0-9]{1,3}(?:[.][0-9]{1,3}){3}', x))}", *around,
                     *[f"begins={begins},{c}" for c in around], *[f"shape={shape},{c}" for c in around]]
            self._add(a, b, "phone", feats)
            self._add(a, b, "id_number", feats)
        for m in CODE.finditer(s):
            a, b = m.span()
            if (a, b) in spans:
                continue
            x = m.group()
            digits = sum(map(str.isdigit, x))
            if digits < 5:
                continue
            shape = re.sub(r"[A-Za-z]+", lambda m: "L" * len(m.group()), re.sub(r"\d+", lambda m: str(len(m.group())), x))
            around = self._around(a, b)
            self._add(a, b, "id_number", ["bias", f"shape={shape}", f"letters={'L' in shape}", f"digits={min(digits, 14)}", *around,
                                          *[f"letters={'L' in shape},{c}" for c in around], *[f"shape={shape},{c}" for c in around]])

    def _address(self, x: str, pattern: int, a: int) -> list[str]:
        street = _STREET.search(x)
        words = WORD.findall(x)
        title = sum(w[0].isupper() for w in words if len(w) > 2)
        house = re.match(r"\d+", x) or re.search(r"\d+", x)
        feats = ["bias", f"pattern={pattern}", f"street={bool(street)}", f"title={min(title, 3)}",
                 f"pattern,title={pattern},{min(title, 2)}", f"box={bool(_BOX.search(x))}", f"house={min(len(house.group()), 5) if house else 0}",
                 f"upper={x.upper() == x and bool(words)}", f"tail={'comma' if ',' in x else 'line' if chr(10) in x else 'none'}"]
        left = WORD.findall(self.s[max(0, a - 16) : a])
        feats.append(f"prev={left[-1].lower() if left else '^'}")
        return feats

    def _names(self) -> None:
        s, lex = self.s, self.lexicon
        tokens = [(m.start(), m.end(), m.group()) for m in WORD.finditer(s)]
        n = len(tokens)
        lower = [t[2].lower() for t in tokens]

        def kind(i: int) -> str:
            w = tokens[i][2]
            if len(w) == 1:
                return "I" if w.isupper() and s[tokens[i][1] : tokens[i][1] + 1] == "." else "-"
            if w[0].isupper():
                return "AA" if w.isupper() else "Aa"
            return "aa"
        kinds = [kind(i) for i in range(n)]

        def known(w: str) -> tuple[bool, bool]:
            if "-" not in w:
                return w in lex.given, w in lex.family
            first, *rest = w.split("-")
            return (w in lex.given or first in lex.given,
                    w in lex.family or bool(rest) and any(p in lex.family for p in (first, *rest)))

        for i in range(n - 1):
            k = kinds[i]
            if k == "-" or k != "I" and lower[i] in TITLES:
                continue
            j = i + 1
            gap = s[tokens[i][1] : tokens[j][0]]
            if k == "aa" and kinds[j] == "aa" and gap == " ":
                a, b = lower[i], lower[j]
                if a not in lex.given and b not in lex.family and "-" not in a and "-" not in b:
                    if self.unknown:
                        self._unknown(tokens, lower, i, j, i, j, "G F")
                    continue
            spans = []
            if k == "I":
                if gap in (". ", "."):
                    spans.append((i, j, "I F"))
                    # two initials
                    if kinds[j] == "I" and j + 1 < n and s[tokens[j][1] : tokens[j + 1][0]] in (". ", "."):
                        spans.append((i, j + 1, "I I F"))
            elif gap == " ":
                spans.append((i, j, "G F"))
                if kinds[j] == "I" and j + 1 < n and s[tokens[j][1] : tokens[j + 1][0]] == ". ":
                    spans.append((i, j + 1, "G I F"))
            elif gap == ", ":
                spans.append((i, j, "F, I" if kinds[j] == "I" else "F, G"))
            for a, b, form in spans:
                first, last = (b, a) if form[0:2] == "F," else (a, b)
                ka, kb = kinds[first], kinds[last]
                if kb in ("I", "-"):
                    continue
                wa, wb = lower[first], lower[last]
                given, family = known(wa)[0], known(wb)[1]
                if ka == "aa" or kb == "aa":
                    if not (family and (given or ka == "I")):
                        if self.unknown and ka == kb and not (given or family):
                            self._unknown(tokens, lower, a, b, first, last, form)
                        if not (given or family) or ka != kb:
                            continue
                if ka != "I" and wa in TITLES or wb in TITLES:
                    continue
                shape = f"{ka} {kb}"
                lexical = f"{'g' if given else '-'}{'f' if family else '-'}"
                swapped = known(wb)[0] and known(wa)[1] and not (given and family)
                x, y = tokens[a][0], tokens[b][1]
                before = [lower[q] for q in range(max(0, a - 2), a) if x - tokens[q][1] < 24]
                between = s[tokens[a - 1][1] : x] if a else s[:x]
                title = bool(before) and before[-1] in TITLES and between in (" ", ". ")
                start = not s[:x].strip() or bool(re.search(r"[.?!;:\n]\s*$", s[max(0, x - 40) : x]))
                after = WORD.match(s, y + 1) if s[y : y + 1] == " " else None
                whole = not s[:x].strip(" \t\n—-–") and not s[y:].strip()
                mark = "dash" if re.search(r"(?:—|--|–)\s?$", s[max(0, x - 8) : x]) else "none"
                feats = ["bias", f"form={form}", f"lex={lexical}", f"shape={shape}", f"form,lex={form},{lexical}", f"shape,lex={shape},{lexical}",
                         f"title={title}", f"start={start}", f"whole={whole}", f"dash={mark}", f"swapped={swapped}", f"hyphen={'-' in wb}",
                         f"prev={before[-1] if before and not start else '^'}", f"next={after.group().lower() if after else s[y : y + 1] or '$'}",
                         f"upper context={ka == 'AA' and s[max(0, x - 12) : x].upper() == s[max(0, x - 12) : x] and x > 3}",
                         f"common={wa in COMMON or wb in COMMON}", f"lex,common={lexical},{(wa in COMMON) + (wb in COMMON)}"]
                self._add(x, y, "name", feats)

    def _unknown(self, tokens: list[tuple[int, int, str]], lower: list[str], a: int, b: int, first: int, last: int, form: str) -> None:
        """A lower-case pair with no word that is well known. With weights, one that can't be chosen is left out."""
        s, lex = self.s, self.lexicon
        wa, wb = lower[first], lower[last]
        if wa in TITLES or wb in TITLES:
            return
        x, y = tokens[a][0], tokens[b][1]
        prev = lower[a - 1] if a and x - tokens[a - 1][1] < 4 else "^" if not a else s[x - 2 : x].strip() or "^"
        first_known = wa in lex.rare_given if "-" not in wa else not lex.rare_given.isdisjoint(_parts(wa)[:2])
        last_known = wb in lex.rare_family if "-" not in wb else not lex.rare_family.isdisjoint(_parts(wb))
        rare = ("gf" if first_known else "-f") if last_known else "g-" if first_known else "--"
        w = self.w if isinstance(self.w, Weights) else None
        if w is not None:
            bonus = w.alone if self.lonely else w.bonus
            if w.most[rare] + bonus + w.lower[2].get(prev, 0.0) + w.lower[6].get(f"{prev},{rare}", 0.0) <= 0:
                return
        after = lower[b + 1] if b + 1 < len(tokens) and tokens[b + 1][0] == y + 1 and s[y] == " " else s[y : y + 1] or "$"
        whole = a == 0 and b == len(tokens) - 1 and not s[:x].strip(" \t\n—-–") and not s[y:].strip()
        values = (rare, f"{rare},{form}", prev, after, f"{rare},{whole}", str((wa in COMMON) + (wb in COMMON)), f"{prev},{rare}", f"{min(len(wa), 4)},{min(len(wb), 4)}")
        if w is not None and sum([t.get(v, 0.0) for t, v in zip(w.lower, values)]) + bonus <= 0:
            return
        self._add(x, y, "name", [f"{g}={v}" for g, v in zip(LOWER, values)])


LOWER = ("lower", "lower,form", "lower,prev", "lower,next", "lower,whole", "lower,common", "lower,prev,rare", "lower,short")


class Weights(dict):
    """Weights by feature, with those of unknown lower-case pairs by group, and the most that a transition can add to a name."""

    def __init__(self, w: dict[str, float]):
        super().__init__(w)
        self.lower = [{f.partition("=")[2]: v for f, v in w.items() if f.startswith(f"name|{g}=")} for g in LOWER]
        # the most that the transitions into a name and out of it can add: anywhere, and where there are only names
        into = max([0.0, *(v for f, v in w.items() if ">name" in f and "|" not in f)])
        self.bonus = into + max([0.0, *(v for f, v in w.items() if f.startswith("name>"))])
        among = max([0.0, *(v for f, v in w.items() if f.startswith("name>name"))])
        self.alone = max(w.get("O>name", 0.0), among) + among
        # the most that a pair can score, by what the lexicon knows of it, without the word before it
        best = lambda group, start: max([0.0, *(v for x, v in self.lower[group].items() if x.startswith(start))])
        self.most = {rare: self.lower[0].get(rare, 0.0) + best(1, rare) + best(3, "") + best(4, rare) + best(5, "") + best(7, "")
                     for rare in ("--", "g-", "-f", "gf")}


def _parts(w: str) -> list[str]:
    """A word and, where it has hyphens, its parts."""
    return [w, *w.split("-")] if "-" in w else [w]


# Frequent words of the four languages, days and months, and words of streets.
COMMON = frozenset(
    "the a an and or but if is are was were it its in on at of to for from by with who what when where why how can could does did do has have had not no yes so as be been this that these those "
    "my our your their his her there here then than just also only all any some each more most other same new old first second last next please thanks thank hello hi dear sorry ok "
    "today tomorrow yesterday monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december "
    "street road lane way avenue drive court place square north south east west upper lower saint rue calle plaza avenida paseo puerto box suite apartment apt "
    "der die das ein eine und oder aber wer wie was wo wann ich wir ihr sie er es mit ohne für von zu im am um auf aus bei nach gestern heute morgen nicht "
    "le la les un une des et ou mais qui que quoi où quand je nous vous il elle est hier avec sans pour dans sur pas "
    "el los las una y o pero quien como cuando yo ella con sin por para en de del al ayer hoy no".split())


# -- the model -------------------------------------------------------------------------------------
def _score(w: dict[str, float], features: list[str]) -> float:
    return sum([w.get(f, 0.0) for f in features])


def _between(s: str, a: int, b: int) -> str:
    gap = s[a:b]
    return "line" if "\n" in gap else "comma" if "," in gap or ";" in gap else "blank" if not gap.strip() else "mark"


def transition(t: Text, q: int, k: int) -> str:
    """Feature of segment ``k`` right after segment ``q``."""
    (_, b, before, _), (a, _, kind, _) = t.segments[q], t.segments[k]
    return f"{before}>{kind},{_between(t.s, b, a)}"


def _neighbours(t: Text) -> tuple[list[int], list[list[int]]]:
    """For each segment the number of those (by end) that end out of reach before it, and those within reach."""
    by_end = sorted(range(len(t.segments)), key=lambda k: t.segments[k][1])
    ends = [t.segments[k][1] for k in by_end]
    far, near = [], []
    for a, _, _, _ in t.segments:
        i, j = bisect_left(ends, a - NEAR), bisect_right(ends, a)
        far.append(i)
        near.append(by_end[i:j])
    return far, near


def decode(t: Text, w: dict[str, float]) -> list[tuple[int, int, str]]:
    """Best chain of segments that don't overlap, as (start, end, kind) in the folded text.

    Segments are taken by start; all that end before one begins are done by then. Those out of reach
    count only by the best of them, those within reach one by one with their transition.
    """
    segs = t.segments
    if not segs:
        return []
    if len(segs) == 1:
        a, b, kind, feats = segs[0]
        return [(a, b, kind)] if _score(w, feats) + w.get(f"O>{kind}", 0.0) > 0 else []
    far, near = _neighbours(t)
    by_end = sorted(range(len(segs)), key=lambda k: segs[k][1])
    value, back = [0.0] * len(segs), [-1] * len(segs)
    top: list[tuple[float, int]] = [(0.0, -1)]  # best of the first n segments by end
    for k, (_, _, kind, feats) in enumerate(segs):
        while len(top) <= far[k]:
            q = by_end[len(top) - 1]
            top.append(max(top[-1], (value[q], q)))
        base, prev = top[far[k]]
        base += w.get(f"O>{kind}", 0.0)
        for q in near[k]:
            v = value[q] + w.get(transition(t, q, k), 0.0)
            if v > base:
                base, prev = v, q
        value[k], back[k] = base + _score(w, feats), prev
    best, k = max([(0.0, -1), *((v, n) for n, v in enumerate(value))])
    out = []
    while k >= 0:
        out.append(segs[k][:3])
        k = back[k]
    return out[::-1]


def _lse(xs: list[float]) -> float:
    m = max(xs)
    return m + math.log(sum([math.exp(x - m) for x in xs]))


def expectations(t: Text, w: dict[str, float]) -> tuple[float, list[float], dict[tuple[int, int], float]]:
    """log Z, the probability of each segment, and of each pair of neighbours within reach, by forward and backward sums."""
    segs = t.segments
    n = len(segs)
    far, near = _neighbours(t)
    by_end = sorted(range(n), key=lambda k: segs[k][1])
    score = [max(-25.0, min(25.0, _score(w, f))) for _, _, _, f in segs]
    first = [w.get(f"O>{kind}", 0.0) for _, _, kind, _ in segs]
    step = {(q, k): w.get(transition(t, q, k), 0.0) for k in range(n) for q in near[k]}
    fwd = [0.0] * n
    done = [0.0]  # log sum over the first segments by end, with none at all
    for k in range(n):
        while len(done) <= far[k]:
            done.append(_lse([done[-1], fwd[by_end[len(done) - 1]]]))
        fwd[k] = score[k] + _lse([done[far[k]] + first[k], *[fwd[q] + step[q, k] for q in near[k]]])
    z = _lse([0.0, *fwd])
    # after a segment: nothing more, or a segment that it is out of reach of, or a neighbour
    after: list[list[int]] = [[] for _ in range(n)]
    for k in range(n):
        for q in near[k]:
            after[q].append(k)
    bwd = [0.0] * n
    rest = [0.0] * (n + 1)  # log sum of what starts from the k-th segment by start on, out of reach, with none at all
    starts = [s[0] for s in segs]
    for k in range(n - 1, -1, -1):
        i = bisect_right(starts, segs[k][1] + NEAR)
        bwd[k] = _lse([rest[i], *[step[k, j] + score[j] + bwd[j] for j in after[k]]])
        rest[k] = _lse([rest[k + 1], first[k] + score[k] + bwd[k]])
    p = [math.exp(fwd[k] + bwd[k] - z) for k in range(n)]
    pairs = {(q, k): math.exp(fwd[q] + x + score[k] + bwd[k] - z) for (q, k), x in step.items()}
    return z, p, pairs


def train(labelled: list[tuple[str, list[tuple[int, int, str]], Lexicon]], epochs: int = 6, rate: float = 0.25, l2: float = 1e-4,
          unknown: bool = True) -> dict[str, float]:
    """Weights of spans and transitions by stochastic gradient ascent (Adagrad) on the log-likelihood."""
    data = []
    for text, gold, lexicon in labelled:
        t = Text(text, lexicon, unknown=unknown)
        y = [0.0] * len(t.segments)
        for a, b, kind in gold:  # the candidate of the kind that fits best
            fit = [(min(b, q) - max(a, p), -(max(b, q) - min(a, p)), n) for n, (p, q, k, _) in enumerate(t.segments) if k == kind and min(b, q) > max(a, p)]
            if fit:
                y[max(fit)[2]] = 1.0
        if t.segments:
            data.append((t, y))
    w: dict[str, float] = {}
    g2: dict[str, float] = {}
    for _ in range(epochs):
        for t, y in data:
            _, p, pairs = expectations(t, w)
            grad: dict[str, float] = {}
            alone = [yi - pi for yi, pi in zip(y, p)]  # what is left of these has no neighbour before it
            for (_, _, _, feats), d in zip(t.segments, alone):
                if abs(d) > 1e-4:
                    for f in feats:
                        grad[f] = grad.get(f, 0.0) + d
            for (q, k), x in pairs.items():
                d = y[q] * y[k] - x
                if abs(d) > 1e-4:
                    f = transition(t, q, k)
                    grad[f] = grad.get(f, 0.0) + d
                alone[k] -= d
            for (_, _, kind, _), d in zip(t.segments, alone):
                if abs(d) > 1e-4:
                    grad[f"O>{kind}"] = grad.get(f"O>{kind}", 0.0) + d
            for f, d in grad.items():
                d -= l2 * w.get(f, 0.0)
                g2[f] = g2.get(f, 1e-6) + d * d
                w[f] = w.get(f, 0.0) + rate * d / math.sqrt(g2[f])
    return {f: round(v, 4) for f, v in w.items() if abs(v) > 0.01}


@functools.lru_cache(maxsize=1)
def weights() -> dict[str, float]:
    from chatlore.llm import pii_training

    known = pii_training.sentences()
    # the features of unknown lower-case pairs are their own; learning them leaves the other weights as they are
    lower = {f: v for f, v in train(known + pii_training.lower_case()).items() if f.startswith("name|lower")}
    return Weights(train(known, unknown=False) | lower)


def find(text: str, lexicon: Lexicon, w: dict[str, float]) -> list[tuple[int, int, str]]:
    """(start, end, kind) in the text itself."""
    t = Text(text, lexicon, w)
    got = decode(t, w)
    if t.at is None:
        return got
    return [(t.at[a], t.at[b - 1] + 1, k) for a, b, k in got]


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, k in spans:
        out += [text[at:a], f"[{k.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


# -- the lexicon -----------------------------------------------------------------------------------
_T = r"\p{Lu}[\p{Ll}'’]+"
_HEAD = r"(?<![\p{L}.,'’-])(?!(?:Mr|Mrs|Ms|Mme|Mlle|Frau|Herr|Dr|Prof|Sr|Sra|Don)\b)"
_PAIR = rf"{_HEAD}({_T})[  ](?:\p{{Lu}}\.[  ])?({_T})(?:-{_T})?(?![\p{{L}}'’-])"
_TURNED = rf"{_HEAD}({_T})(?:-{_T})?,[  ]({_T})(?![\p{{L}}'’-])"

_LOWER = r"(?<![\p{L}@.+\d_-])\p{Ll}[\p{Ll}'’]+(?![\p{L}@.+\d_-])"


def lexicon_table(texts: DataFrame, text: str = "text") -> DataFrame:
    """(word, code) of all given and family names by their partners, over the whole collection; see ``Lexicon.of``."""
    def pairs(pattern: str, g: int, f: int):
        return F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias("g"),
                            F.regexp_extract_all(text, F.lit(pattern), F.lit(f)).alias("f"))
    some = texts.filter(F.col(text).isNotNull()).select(text, F.xxhash64(text).alias("t"))
    pair = some.select("t", F.explode(F.concat(pairs(_PAIR, 1, 2), pairs(_TURNED, 2, 1))).alias("p"))
    pair = cut(pair.select("t", F.lower("p.g").alias("g"), F.lower("p.f").alias("f")).distinct(), "pairs")
    # how many partners, and in how many different texts
    given = pair.groupBy(F.col("g").alias("word")).agg(F.count_distinct("f").alias("n"), F.count_distinct("t").alias("n_title"), F.lit("g").alias("role"))
    family = pair.groupBy(F.col("f").alias("word")).agg(F.count_distinct("g").alias("n"), F.count_distinct("t").alias("n_title"), F.lit("f").alias("role"))
    named = cut(given.unionByName(family), "names")
    # words that are written in lower case in half as many different texts are no sure names, in more texts ordinary words
    low = some.select("t", F.explode(F.regexp_extract_all(text, F.lit(_LOWER), F.lit(0))).alias("word"))
    low = low.join(named.select("word").distinct(), "word", "left_semi").distinct().groupBy("word").agg(F.count("*").alias("n_low"))
    n_low = F.coalesce("n_low", F.lit(0))
    kept = named.join(low, "word", "left").filter(n_low <= F.col("n_title"))
    # how many partners well connected words have, of those with more than one
    usual = {r.role: r.usual for r in named.filter("n > 1").groupBy("role").agg(F.percentile_approx("n", 0.9).alias("usual")).collect()}
    least = F.when(F.col("role") == "g", usual.get("g", 0) * SURE_SHARE).otherwise(usual.get("f", 0) * SURE_SHARE)
    role = F.when((F.col("n") > 1) & (F.col("n") >= least) & (n_low * 2 <= F.col("n_title")), F.upper("role")).otherwise(F.col("role"))
    return cut(kept.select("word", F.concat(role, "word").alias("code")), "names")


def mine_lexicon(texts: DataFrame, text: str = "text") -> Lexicon:
    return Lexicon.of(r.code for r in lexicon_table(texts, text).collect())


# -- over tables -----------------------------------------------------------------------------------
def _known(df: DataFrame, fields: list[str], lexicon: Lexicon | DataFrame) -> tuple[DataFrame, Lexicon | None, str | None]:
    """``df`` and the lexicon to send, or ``df`` with a column of the words that the lexicon knows."""
    if isinstance(lexicon, Lexicon):
        return df, lexicon, None
    if lexicon.count() <= BROADCAST_WORDS:
        return df, Lexicon.of(r.code for r in lexicon.collect()), None
    at = fresh(df, "text_at")
    df = df.withColumn(at, F.sha2(F.to_json(F.array(*fields)), 256))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = set()
            for f in fields:
                for k, text in zip(b[at], b[f]):
                    out |= {(k, p) for m in WORD.findall(fold(text)[0]) for p in _parts(m.lower())} if text else set()
            yield pd.DataFrame(list(out), columns=[at, "word"])
    words = df.select(at, *fields).dropDuplicates([at]).mapInPandas(run, f"`{at}` string, word string").distinct()
    known = fresh(df, "known")
    hits = words.join(lexicon, "word").groupBy(at).agg(F.collect_set("code").alias(known))
    return df.join(hits, at, "left").drop(at), None, known


def _model(df: DataFrame, lexicon: Lexicon | None):
    return df.sparkSession.sparkContext.broadcast((lexicon, weights()))


def _lexicons(b: pd.DataFrame, lexicon: Lexicon | None, known: str | None) -> list[Lexicon]:
    """The lexicon of each row of a batch."""
    if known is None:
        return [lexicon] * len(b)
    return [Lexicon.of(() if x is None else x) for x in b[known]]


def entities(df: DataFrame, key: str, fields: list[str], lexicon: Lexicon | DataFrame) -> DataFrame:
    """(key, field, kind, n) for every kind that a field of a row holds."""
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, field string, kind string, n int"
    df, lexicon, known = _known(df.select(key, *fields), fields, lexicon)
    model = _model(df, lexicon)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sent, w = model.value
        cache: dict[str, dict[str, int]] = {}
        for b in batches:
            out = []
            lexicons = _lexicons(b, sent, known)
            for f in fields:
                for k, text, lex in zip(b[key], b[f], lexicons):
                    if not text:
                        continue
                    got = cache.get(text)
                    if got is None:
                        got = {}
                        for _, _, kind in find(text, lex, w):
                            got[kind] = got.get(kind, 0) + 1
                        if len(cache) < CACHE:
                            cache[text] = got
                    out += [(k, f, kind, n) for kind, n in got.items()]
            yield pd.DataFrame(out, columns=[key, "field", "kind", "n"])

    return df.mapInPandas(run, schema)


def mask(df: DataFrame, key: str, fields: list[str], lexicon: Lexicon | DataFrame) -> DataFrame:
    """(key, fields) with every entity replaced by a placeholder that names its kind."""
    schema = ", ".join([f"`{key}` {df.schema[key].dataType.simpleString()}", *[f"`{f}` string" for f in fields]])
    df, lexicon, known = _known(df.select(key, *fields), fields, lexicon)
    model = _model(df, lexicon)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sent, w = model.value
        for b in batches:
            lexicons = _lexicons(b, sent, known)
            for f in fields:
                b[f] = [redact(x, find(x, lex, w)) if x else x for x, lex in zip(b[f], lexicons)]
            yield b[[key, *fields]]

    return df.mapInPandas(run, schema)
