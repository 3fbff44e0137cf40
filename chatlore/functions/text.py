"""Text functions: word split, globs, karma scan, day keys, record encoding. All are JVM expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatlore.functions.confusables import letter_class

# A word is a run of letters, digits and non-ASCII characters with inner apostrophes; every other
# visible character is a word of its own.
_RUN = r"[0-9A-Za-z\u0080-\x{10FFFF}]+"
TOKEN = rf"{_RUN}(?:'+{_RUN})*|[\x21-\x7E]"
TOKEN_RE2 = TOKEN.replace(r"\u0080", r"\x{80}")
# name, then one of the doubled operators
KARMA = r"([A-Za-z_\u0080-\x{10FFFF}][A-Za-z0-9_\u0080-\x{10FFFF}]*)(\+\+|--|\?\?|~~)"
KARMA_RE2 = KARMA.replace(r"\u0080", r"\x{80}")
MAX_KEY_BYTES = 256
RETENTION_DAYS = 7


def tokens(text: Column) -> Column:
    """Words of a text in order; null text has none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def split_words(text: str) -> list[str]:
    """The same for query text at plan time."""
    return re.findall(r"[0-9A-Za-z\u0080-\U0010FFFF]+(?:'+[0-9A-Za-z\u0080-\U0010FFFF]+)*|[\x21-\x7E]", text)


def _glob_chars(glob: str) -> tuple[list[tuple[str, bool]], bool]:
    """Characters with whether they were escaped, and whether the word is exact."""
    chars: list[tuple[str, bool]] = []
    i = 0
    while i < len(glob):
        if glob[i] == "\\" and i + 1 < len(glob):
            chars.append((glob[i + 1], True))
            i += 2
        else:
            chars.append((glob[i], False))
            i += 1
    return chars, any("A" <= c <= "Z" and not e or "a" <= c <= "z" and e for c, e in chars)


def exact_word(glob: str) -> str | None:
    """The only word that a glob matches, if there is but one."""
    chars, exact = _glob_chars(glob)
    if any(not e and c in "?*" for c, e in chars) or not exact and any("a" <= c <= "z" for c, _ in chars):
        return None
    return "".join(c for c, _ in chars)


def glob_regex(glob: str, ascii_only: bool = False) -> str:
    r"""Glob to an anchored regular expression: ``?`` one character, ``*`` any, ``\x`` itself.

    An unescaped upper-case or an escaped lower-case letter makes the whole word exact; otherwise
    each letter a-z also matches its other forms (only its upper case if ``ascii_only``).
    """
    chars, exact = _glob_chars(glob)
    out = []
    for c, e in chars:
        if not e and c == "?":
            out.append(".")
        elif not e and c == "*":
            out.append(".*")
        elif "a" <= c <= "z" and not exact:
            out.append(f"[{c}{c.upper()}]" if ascii_only else letter_class(c))
        else:
            out.append(rf"\x{{{ord(c):X}}}" if not c.isalnum() or not c.isascii() else c)
    return rf"(?s)\A{''.join(out)}\z"


def glob_match(token: Column, glob: str) -> Column:
    """Whether a word matches. The wide letter classes are tried only on words with other than ASCII characters."""
    wide, narrow = glob_regex(glob), glob_regex(glob, True)
    if wide == narrow:
        return token.rlike(wide)
    return token.rlike(narrow) | ((F.octet_length(token) > F.length(token)) & token.rlike(wide))


def accepts_everything(glob: str) -> bool:
    return bool(glob) and set(glob) == {"*"}


def is_logged(instance: Column) -> Column:
    """Whether a message is kept for good: everything but ``graffiti`` and ``graffiti.*``."""
    return ~((instance == "graffiti") | instance.startswith("graffiti."))


def day_key(day: Column, logged: Column) -> Column:
    """Packed day: yyyymmdd * 10 + 1 if logged."""
    return (F.year(day) * 100000 + F.month(day) * 1000 + F.dayofmonth(day) * 10 + logged.cast("int")).cast("long")


def day_of_key(key: Column) -> tuple[Column, Column]:
    """(day, logged) of a packed day; an impossible one gives a null day."""
    ymd = F.floor(key / 10).cast("int")
    y, m, d = F.floor(ymd / 10000).cast("int"), (F.floor(ymd / 100) % 100).cast("int"), (ymd % 100).cast("int")
    good = y.between(1970, 2100) & m.between(1, 12) & d.between(1, 31) & (key % 10).isin(0, 1)
    day = F.when(good, F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd"))
    return day, F.when(good, key % 10 == 1)


def log_day(timesecs: Column) -> Column:
    return F.to_date(F.timestamp_seconds(timesecs))


def karma(body: Column) -> Column:
    """Array of (key, delta) in order of appearance."""
    keys = F.regexp_extract_all(body, F.lit(KARMA), F.lit(1))
    ops = F.regexp_extract_all(body, F.lit(KARMA), F.lit(2))
    pairs = F.zip_with(keys, ops, lambda k, o: F.struct(
        k.alias("key"), F.when(o == "++", F.lit(1)).when(o == "--", F.lit(-1)).otherwise(F.lit(0)).cast("long").alias("delta")))
    return F.filter(pairs, lambda p: ~p["key"].isin("c", "C") & (F.octet_length(p["key"]) <= MAX_KEY_BYTES))


def zmoji_list(zmojis: Column) -> Column:
    """Items of a palette: trimmed, split at commas; an empty one has none."""
    t = F.trim(zmojis)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, ","))


def can_submit(instance: Column, body: Column) -> Column:
    return F.coalesce((F.length(F.trim(instance)) > 0) & (F.length(F.trim(body)) > 0), F.lit(False))


def abbreviate(body: Column, n: int = 60) -> Column:
    return F.substring(body, 1, n)


def linkify(body: Column) -> Column:
    return F.regexp_replace(body, r"(https?://[^\s<>\"]+)", '<a href="$1">$1</a>')


def json_string(c: Column) -> Column:
    """A string as JSON text."""
    return F.regexp_extract(F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)


def encode_message(zgram_id: Column, timesecs: Column, sender: Column, signature: Column, logged: Column, instance: Column,
                   body: Column, style: Column) -> Column:
    j = json_string
    return F.concat(F.lit('[["z",[['), zgram_id.cast("string"), F.lit("],"), timesecs.cast("string"), F.lit(","), j(sender), F.lit(","),
                    j(signature), F.lit(","), logged.cast("string"), F.lit(",["), j(instance), F.lit(","), j(body), F.lit(","), j(style),
                    F.lit("]]]]"))


def encode_metadata(kind: str, *cells: Column) -> Column:
    """rx: id, reaction, creator, value; zgrev: id, instance, body, style; ref: id, refers_to, value; zmojis: user, text."""
    j = json_string
    c = list(cells)
    if kind == "rx":
        inner = [F.lit("["), c[0].cast("string"), F.lit("],"), j(c[1]), F.lit(","), j(c[2]), F.lit(","), c[3].cast("string")]
    elif kind == "zgrev":
        inner = [F.lit("["), c[0].cast("string"), F.lit("],["), j(c[1]), F.lit(","), j(c[2]), F.lit(","), j(c[3]), F.lit("]")]
    elif kind == "ref":
        inner = [F.lit("["), c[0].cast("string"), F.lit("],["), c[1].cast("string"), F.lit("],"), c[2].cast("string")]
    elif kind == "zmojis":
        inner = [j(c[0]), F.lit(","), j(c[1])]
    else:
        raise ValueError(f"no such kind of metadata: {kind}")
    return F.concat(F.lit(f'[["m",[["{kind}",['), *inner, F.lit("]]]]]"))
