r"""Markup residue: what markup a text holds, and clean text that keeps its structure.

``kinds`` names the markup found; characters in their plain sense are none (``C:\dir``, ``$5 to $6``,
``a < b``, ``x++``/``x--``/``x~~`` scores, addresses in angle brackets, ``R&D;``). The clean text
writes headings as ``# title``, list items as ``- item`` or ``1. item``, code in back quotes or
indented by four spaces, formulas between dollar signs, and drops all other marks. Code and formulas
of any number of lines are taken out whole before the rules and put back as they are after them.

Content is then located by line blocks: text lengths are summed over a sliding window of lines; a
block that reaches ``surge`` of the largest block of the text opens a stretch of content, the next
empty block ends it, and the lines between are kept. So short lines apart from the text (navigation,
footers) go, while a text of even lines stays whole, whatever its length; code and formulas are text
of any length. A text holds markup if what is left by the stripping isn't the text itself
(``residue``); ``kinds`` names what was there and spares the stripping of texts that can't have any.

Defined cases: null gives null text and no kinds, empty and blank text give themselves emptied;
repeated rows give repeated results; all other columns stay. Everything is a JVM expression.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlore.shared import fresh

# Element names of HTML and of wiki extensions.
TAGS = ("a abbr address article aside audio b base bdi bdo big blockquote body br button caption center cite code col "
        "colgroup dd del details dfn div dl dt em fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head "
        "header hr html i iframe img input ins kbd label legend li link main map mark meta nav noscript nowiki object "
        "ol option p param pre q ref s samp script section select small source span strike strong style sub summary "
        "sup svg table tbody td textarea tfoot th thead time title tr tt u ul var video wbr").split()
_ATTR = r"""(?:\s+[A-Za-z_:][\w:.-]*\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>`]+)|\s+(?:disabled|checked|selected|hidden|async|defer|open|required|readonly))"""
TAG = rf"(?i)<(?:/(?:{'|'.join(TAGS)})\s*|(?:{'|'.join(TAGS)}){_ATTR}*+\s*/?)>"
COMMENT = r"(?s)<!--.*?-->"
_NAMES = sorted({k[:-1] for k in html5 if k.endswith(";")})
CHAR_REF = rf"&(?:#[0-9]{{1,7}}|#[xX][0-9a-fA-F]{{1,6}}|{'|'.join(_NAMES)});"

PATTERNS: dict[str, list[str]] = {
    "html": [TAG, COMMENT, CHAR_REF],
    "markdown": [
        r"(?m)^ {0,3}#{1,6}[ \t]+\S",
        r"(?m)^(?![ \t]*[>|#=-])(?=[ \t]*+\S)[^\n]++\n(?:={3,}|-{3,})[ \t]*$",
        r"(?m)^ {0,3}(?:```|~~~)",
        r"(?<![`\w])`[^`\n]+`(?!`)",
        r"(?<![*\w])\*\*(?=[^\s*])[^*\n]*(?<=[^\s*])\*\*(?!\*)",
        r"(?<![\w_])__(?=[^\s_])[^\n]*?(?<=[^\s_])__(?![\w_])",
        r"(?<![\w*])\*(?=[^\s*])[^*\n]*(?<=[^\s*])\*(?![\w*])",
        r"(?<![\w_])_(?=[^\s_])[^_\n]*(?<=[^\s_])_(?![\w_])",
        r"(?<![\w~])~~(?=[^\s~])[^~\n]*(?<=[^\s~])~~(?![\w~])",
        r"!?\[[^\[\]\n]*\]\([^()\s]+(?:\s+\"[^\"\n]*\")?\)",
        r"(?m)^ {0,3}>{1,3}[ \t]+\S",
        r"(?m)^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*+:?-{2,}+:?[ \t]*+)++\|?[ \t]*$",
        r"(?m)^ {0,3}[-*+][ \t]+\S[^\n]*\n(?:[ \t]*\n)?(?: {0,3}|\t)[-*+][ \t]+\S",
        r"(?m)^ {0,3}\d{1,3}[.)][ \t]+\S[^\n]*\n(?:[ \t]*\n)?(?: {0,3}|\t)\d{1,3}[.)][ \t]+\S",
    ],
    "wiki": [
        r"(?m)^[ \t]*(={2,6})[ \t]*[^=\s][^=\n]*?[ \t]*\1[ \t]*$",
        r"\[\[[^\[\]\n]+\]\]",
        r"\{\{[^{}\n]+\}\}",
        r"(?m)^[ \t]*(?:\{\||\|\}[ \t]*$|\|-[ \t]*$)",
        r"(?<![\w'])'''(?=[^\s'])[^\n]*?(?<=[^\s'])'''(?!')",
        r"(?<![\w'])''(?=[^\s'])[^\n]*?(?<=[^\s'])''(?![\w'])",
        r"\[https?://[^\s\]]+(?:\s[^\]\n]*)?\]",
    ],
    "latex": [
        r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{[^{}\n]*\}",
        r"(?m)^[ \t]*\\item\b",
    ],
    "formula": [
        r"(?s)\$\$[^$]+\$\$",
        r"(?s)(?<!\\)\\\[.+?\\\]",
        r"(?s)(?<!\\)\\\(.+?\\\)",
        r"(?<![\\$\w])\$(?=[^\s$])(?=[^$\n]*[\\^_=+(])[^$\n]*(?<=[^\s$])\$(?![\w$])",
        r"(?<![\\$\w])\$(?=[^$\n]*[\\^_])[^$\n]+\$(?![\w$])",
        r"(?<![\\$\w])\$[A-Za-z]\$(?![\w$])",
    ],
}
WINDOW, SURGE = 3, 0.125


def kinds(text: Column) -> Column:
    """Sorted array of the kinds of markup in ``text``."""
    found = []
    for kind, patterns in PATTERNS.items():
        hit = F.lit(False)
        for p in patterns:
            hit = hit | text.rlike(p)
        found.append(F.when(hit, F.lit(kind)))
    return F.coalesce(F.filter(F.array(*found), lambda k: k.isNotNull()), F.array().cast("array<string>"))


# (pattern, replacement) in this order
STRIP: list[tuple[str, str]] = [
    (r"(?i)<h[1-6]\b[^<>]*>", "\n# "), (r"(?i)</h[1-6]\s*>", "\n"),
    (r"(?i)<li\b[^<>]*>", "\n- "),
    (r"(?i)</?(?:p|div|br|tr|table|ul|ol|li|blockquote|section|article|header|footer|nav|hr)\b[^<>]*/?>", "\n"),
    (r"(?i)</t[dh]\s*>(?=\s*<t[dh])", " | "),
    (TAG, ""),
    # headings
    (r"(?m)^[ \t]*(={2,6})[ \t]*([^=\n]*[^=\s])[ \t]*\1[ \t]*$", "# $2"),
    (r"(?m)^(?![ \t]*[>|#=\uFDD0-])(?=[ \t]*+\S)([^\n]++)\n(?:={3,}|-{3,})[ \t]*$", "# $1"),
    (r"\\(?:part|chapter|(?:sub)*section|(?:sub)?paragraph)\*?\{([^{}\n]*)\}", "# $1"),
    (r"(?m)^ {0,3}#{1,6}[ \t]+", "# "),
    # lists, quotes, tables
    (r"\\(?:begin|end)\{[^{}\n]*\}(?:\[[^\]\n]*\])?", ""),
    (r"(?m)^[ \t]*\\item(?:\[[^\]\n]*\])?[ \t]*", "- "),
    (r"(?m)^ {0,3}[*+][ \t]+", "- "),
    (r"(?m)^ {0,3}>{1,3}[ \t]+", ""),
    (r"(?m)^[ \t]*(?:\{\|[^\n]*|\|\}|\|-|\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*+:?-{2,}+:?[ \t]*+)++\|?)[ \t]*$", ""),
    (r"(?m)^[ \t]*\|[ \t]*([^\n]*?)[ \t]*\|?[ \t]*$", "$1"),
    # links, templates, emphasis
    (r"!?\[([^\[\]\n]*)\]\([^()\s]+(?:\s+\"[^\"\n]*\")?\)", "$1"),
    (r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]\n]+)\]\]", "$1"),
    (r"\[https?://[^\s\]]+\s([^\]\n]*)\]", "$1"),
    # a template of words is text, so are its arguments without a name; other templates are calls
    (r"\{\{[^{}|\n]*\|(?=[^{}=\n]*\}\})(?:[^{}|\n]*\|)*([^{}|\n]*)\}\}", "$1"),
    (r"\{\{\s*([^{}|\s]+(?:[ \t]+[^{}|\s]+)+)\s*\}\}", "$1"), (r"\{\{[^{}\n]+\}\}", ""),
    (r"\\(?:cite|ref|label|footnotemark|pageref|vspace|hspace|input|include|bibliography|usepackage|documentclass)\*?(?:\[[^\]\n]*\])?\{[^{}\n]*\}", ""),
    # commands in commands, from the inside out
    *[(r"\\(?:emph|text(?:bf|it|tt|sc|rm|sf)|underline|mbox|footnote|caption|title|author|href\{[^{}\n]*\}|textcolor\{[^{}\n]*\})\*?\{([^{}\n]*)\}", "$1")] * 4,
    (r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{([^{}\n]*)\}", "$1"),
    (r"(?<![*\w])\*\*(?=[^\s*])([^*\n]*)(?<=[^\s*])\*\*(?!\*)", "$1"),
    (r"(?<![\w_])__(?=[^\s_])([^\n]*?)(?<=[^\s_])__(?![\w_])", "$1"),
    (r"(?<![\w~])~~(?=[^\s~])([^~\n]*)(?<=[^\s~])~~(?![\w~])", "$1"),
    (r"(?<![\w*])\*(?=[^\s*])([^*\n]*)(?<=[^\s*])\*(?![\w*])", "$1"),
    (r"(?<![\w_])_(?=[^\s_])([^_\n]*)(?<=[^\s_])_(?![\w_])", "$1"),
    (r"(?<![\w'])'''(?=[^\s'])([^\n]*?)(?<=[^\s'])'''(?!')", "$1"),
    (r"(?<![\w'])''(?=[^\s'])([^\n]*?)(?<=[^\s'])''(?![\w'])", "$1"),
    (r"[ \t]+$", ""),
]
# All names of HTML; a no-break space is written as a space.
REFERENCES = {k[:-1]: v for k, v in html5.items() if k.endswith(";")} | {"nbsp": " "}
_REFERENCE = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"


def _references(text: Column) -> Column:
    """Character references as characters, each once (``&amp;lt;`` is ``&lt;``); unknown names stay."""
    names = F.str_to_map(F.lit("\1".join(f"{k}\2{v}" for k, v in REFERENCES.items())), F.lit("\1"), F.lit("\2"))

    def char(n: Column) -> Column:
        # any plane, through UTF-32; the marks of what is taken out can't be written as references
        ok = (n > 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF) & ~n.between(0xFDD0, 0xFDEF)
        return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd"))

    def one(c: Column) -> Column:
        return (F.when(F.substring(c, 1, 2).isin("#x", "#X"), char(F.conv(F.substring(c, 3, 8), 16, 10).try_cast("int")))
                .when(F.substring(c, 1, 1) == "#", char(F.substring(c, 2, 8).try_cast("int")))
                .otherwise(F.coalesce(F.try_element_at(names, c), F.concat(F.lit("&"), c, F.lit(";")))))
    pieces = F.split(text, _REFERENCE, -1)
    codes = F.transform(F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(1)), one)
    joined = F.array_join(F.flatten(F.zip_with(pieces, codes, lambda p, c: F.array(p, F.coalesce(c, F.lit(""))))), "")
    return F.when(text.rlike(_REFERENCE), joined).otherwise(text)


# -- code and formulas: taken out whole, with a mark in their place --------------------------------
def _fence(c: str, group: str, info: str) -> str:
    """A fenced block up to its closing fence, or to the end where there is none."""
    return rf"^ {{0,3}}(?<{group}>{c}{{3,}}+){info}(?:\n(?<{group}x>(?s:.*?)))??(?:\n {{0,3}}\k<{group}>{c}*+[ \t]*(?=\n|\z)|\z)"


_FENCES = rf"(?:{_fence('`', 'a', '[^`' + chr(92) + 'n]*+')}|{_fence('~', 'b', '[^' + chr(92) + 'n]*+')})"
_PRE = r"(?is:<pre\b[^>]*>\n?(?<pre>.*?)</pre\s*>)"
_CODE = r"(?is:<code\b[^>]*>(?<code>.*?)</code\s*>)"
_VERBATIM = (r"(?s:\\begin\{(?<v>verbatim\*?|Verbatim\*?|lstlisting|minted|alltt)\}(?:(?<!verbatim\}|verbatim\*\})\[[^\]\n]*\])?"
             r"(?:(?<=minted\}|\])\{[^{}\n]*\})?[ \t]*\n?(?<vx>.*?)\n?[ \t]*\\end\{\k<v>\})")
_EQUATION = (r"(?s:\\begin\{(?<e>(?:equation|align|alignat|aligned|flalign|gather|multline|eqnarray|math|displaymath)\*?)\}(?:(?<=alignat\}|alignat\*\})\{[^{}\n]*\})?"
             r"\s*+(?<ex>.*?)\s*\\end\{\k<e>\})")
_GONE = rf"(?:{COMMENT}|(?is:<(?<s>script|style)\b[^>]*>.*?</\k<s>\s*>))"
_DISPLAY = r"(?s:\$\$(?<da>[^$]+)\$\$|(?<!\\)\\\[(?<db>.+?)\\\]|(?<!\\)\\\((?<dc>.+?)\\\))"
_SPAN = rf"(?:{'|'.join(f'(?:{p})' for p in (PATTERNS['markdown'][3], *PATTERNS['formula'][3:]))})"
# what starts first is taken; a text's own marks are taken too, so that all others are ours
TAKEN = rf"(?md)(?:{_FENCES}|{_GONE}|{_PRE}|{_CODE}|{_VERBATIM}|{_EQUATION}|{_DISPLAY}|{_SPAN}|[\uFDD0-\uFDD2])"
_MARK = r"[\uFDD0\uFDD1]([0-9]+)\uFDD2"


def _written(m: Column) -> Column:
    """What is taken out as it is put back."""
    def inner(pattern: str, by: str) -> Column:
        return F.regexp_replace(m, rf"(?md)\A{pattern}\z", by)

    def lines(c: Column) -> Column:
        return F.regexp_replace(c, r"(?md)^", "    ")

    def html(c: Column) -> Column:
        return _references(F.regexp_replace(F.regexp_replace(c, r"(?i)<br\s*/?>", "\n"), TAG, ""))

    def apart(c: Column) -> Column:
        return F.concat(F.lit("\n"), c, F.lit("\n"))
    pre, code = html(inner(_PRE, "${pre}")), html(inner(_CODE, "${code}"))
    return (F.when(m.rlike(r"\A {0,3}(?:```|~~~)"), lines(inner(_FENCES, "${ax}${bx}")))
            .when(m.rlike(r"(?i)\A<pre"), apart(lines(F.regexp_replace(pre, r"\n\z", ""))))
            .when(m.rlike(r"(?i)\A<code"), F.when(code.contains("\n"), apart(lines(code))).otherwise(F.concat(F.lit("`"), code, F.lit("`"))))
            .when(m.rlike(rf"(?md)\A{_VERBATIM}\z"), apart(lines(inner(_VERBATIM, "${vx}"))))
            .when(m.startswith("\\begin"), inner(_EQUATION, r"\$${ex}\$"))
            .when(m.rlike(r"\A(?:\$\$|\\)"), inner(_DISPLAY, r"\$${da}${db}${dc}\$"))
            .otherwise(m))


def taken(text: Column) -> Column:
    """Code, formulas, comments and scripts of ``text`` in their order."""
    found = F.regexp_extract_all(text, F.lit(TAKEN), F.lit(0))
    return F.when(text.rlike("[`~<$\\\\\uFDD0-\uFDD2]"), found).otherwise(F.array().cast("array<string>"))


def marked(text: Column, took: Column) -> Column:
    """``text`` with numbered marks for what is taken out, and nothing for comments and scripts."""
    def mark(m: Column, i: Column) -> Column:
        block = m.rlike(r"\A(?: {0,3}(?:```|~~~)|\\begin|(?i:<pre))")
        put = F.concat(F.when(block, F.lit("\ufdd0")).otherwise(F.lit("\ufdd1")), i.cast("string"), F.lit("\ufdd2"))
        return F.when(m.rlike(r"(?i)\A<(?:!--|script|style)"), F.lit("")).otherwise(put)
    pieces = F.zip_with(F.split(text, TAKEN, -1), F.transform(took, mark), lambda p, k: F.array(p, F.coalesce(k, F.lit(""))))
    return F.when(F.size(took) > 0, F.array_join(F.flatten(pieces), "")).otherwise(text)


def put_back(text: Column, took: Column) -> Column:
    places = F.regexp_extract_all(text, F.lit(_MARK), F.lit(1))
    pieces = F.zip_with(F.split(text, _MARK, -1), F.transform(places, lambda n: _written(F.element_at(took, n.cast("int") + 1))),
                        lambda p, c: F.array(p, F.coalesce(c, F.lit(""))))
    return F.when(F.size(took) > 0, F.array_join(F.flatten(pieces), "")).otherwise(text)


def strip(text: Column) -> Column:
    for pattern, by in STRIP:
        text = F.regexp_replace(text, pattern, by)
    return text


def content_lines(text: str, window: int = WINDOW, surge: float = SURGE) -> Column:
    """Text of a column between the surge and dive points of its line blocks."""
    lengths = f"transform(split({text}, '\\n', -1), x -> if(x rlike '[\ufdd0\ufdd1]', 1000, length(regexp_replace(x, '\\\\s', ''))))"
    blocks = f"transform(d.n, (x, i) -> aggregate(slice(d.n, i + 1, {window}), 0, (a, b) -> a + b))"
    return F.expr(f"""
        element_at(transform(transform(transform(array(named_struct('l', split({text}, '\\n', -1), 'n', {lengths})),
          d -> named_struct('l', d.l, 'b', {blocks})), d -> named_struct('l', d.l, 'b', d.b, 'most', array_max(d.b))), d ->
          array_join(aggregate(sequence(0, size(d.l) - 1),
            named_struct('on', false, 'kept', cast(array() as array<string>)),
            (s, i) -> named_struct('on', d.b[i] > 0 and (s.on or d.b[i] >= {surge} * d.most),
              'kept', if(d.b[i] > 0 and (s.on or d.b[i] >= {surge} * d.most), concat(s.kept, array(d.l[i])), s.kept)),
            s -> s.kept), '\\n')), 1)""")


def residue(text: Column, stripped: Column) -> Column:
    """Whether the prose is less than the text: blanks aside, stripping took or rewrote something. The marks of
    headings and items that the clean text keeps, and those of what was taken out whole, are no prose."""
    prose = F.regexp_replace(stripped, r"(?m)^(?:#|-|[0-9]{1,3}[.)])[ \t]+", "")
    return F.coalesce(F.regexp_replace(text, r"\s", "") != F.regexp_replace(prose, r"\s", ""), F.lit(False))


def clean(df: DataFrame, text: str = "body", kinds_col: str = "kinds", clean_col: str = "clean_text") -> DataFrame:
    """``df`` with the kinds of markup in ``text`` (none if stripping leaves the text as it is) and its clean text."""
    took = fresh(df.withColumn(clean_col, F.lit("")), "took")
    bare = fresh(df.withColumn(clean_col, F.lit("")), "bare")
    plain = df.withColumn(clean_col, F.regexp_replace(F.col(text), r"\r\n?", "\n"))
    plain = plain.withColumn(took, taken(F.col(clean_col)))
    plain = plain.withColumn(bare, _references(strip(marked(F.col(clean_col), F.col(took)))))
    plain = plain.withColumn(kinds_col, F.when(residue(F.col(text), F.col(bare)), kinds(F.col(text))).otherwise(F.array().cast("array<string>")))
    plain = plain.withColumn(clean_col, put_back(content_lines(f"`{bare}`"), F.col(took)))
    rest = [c for c in plain.columns if c not in (took, bare, clean_col, kinds_col)]
    return plain.select(*rest, clean_col, kinds_col)
