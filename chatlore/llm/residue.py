r"""Template residue, filler, error pages and script notices in place of content.

A record is a sentence of a line, written as its lower-case words; numbers become ``<*>``, a number
of the form of a status code ``<code>``. Records are routed through a prefix tree of fixed depth:
first by number of words, then by the first ``DEPTH`` words. In a leaf, a word stays in the template
if at least 1/``SPLIT`` of the leaf's records have it at that place, all others become ``<*>``; so a
leaf holds one template for each combination of its frequent words, and a leaf of one record is a
template by itself. These are shares, so a template doesn't depend on the size of the table.

Each distinct template is classified once, from its own words: notice, error, filler, navigation or
none. Verdicts are propagated to the records by way of the distinct records; no record is judged
by itself. A document is residue if records with a verdict weigh at least as much as its ordinary
text, site navigation left aside. Separately, unresolved slots are looked for inside ordinary
records; slots quoted as code are none.

Defined cases: null, empty and blank texts are no residue; repeated documents are judged alike; very
long texts are cut into records, never shortened; empty tables give no rows; other columns are
ignored.

Scale: equal records are merged before they are routed. Leaves none of whose records has a word that
any verdict needs are left out, since a template's words are its records' words. Words of a leaf are
counted by partial aggregates, never gathered; what is kept of a leaf is at most ``SPLIT`` words a
place. Python sees distinct templates only. Tables are broadcast only where their size, known at run
time, allows it.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from re import _parser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlore.shared import cut, spread

DEPTH = 3
SPLIT = 20
ANY = "<*>"

# -- unresolved slots ------------------------------------------------------------------------------
# Environment variables that are no slots; words that name a slot.
ENVIRONMENT = "HOME|PATH|USER|SHELL|PWD|LANG|TMP|TMPDIR|EDITOR|PAGER|DISPLAY|HOSTNAME|JAVA_HOME|SPARK_HOME|PYTHONPATH|LD_LIBRARY_PATH|RANDOM|IFS|PS1|TERM"
SLOT_WORDS = ("name|first name|last name|date|time|title|subject|company|sender|recipient|user|username|team|link|url|instance|"
              "address|email|phone|amount|number|city|country|product|order|message|text|image|logo|signature|thread|topic|"
              "nombre|fecha|asunto|empresa|título|enlace|nom|prénom|objet|sujet|titre|entreprise|société|fil|lien|"
              "betreff|datum|firma|titel|vorname|nachname|anrede")
_ID = r"[A-Za-z_][\w.\-]*"
SLOTS = [
    rf"\{{\{{\{{?\s*[#/&]?\s*{_ID}(?:\s*\|\s*\w+)*\s*\}}?\}}\}}",
    rf"(?<!\\)\$\{{(?!(?:{ENVIRONMENT})\}}){_ID}\}}",
    rf"#\{{{_ID}\}}",
    rf"<%[=\-]?\s*{_ID}\s*-?%>",
    rf"\{{%-?\s*{_ID}\s*-?%\}}",
    rf"%%{_ID}%%",
    rf"@@{_ID}@@",
    rf"<<\s*{_ID}\s*>>",
    rf"%\({_ID}\)[sd]",
    rf"(?<![\w%])%(?:[A-Z]+_[A-Z_]+|(?i:{SLOT_WORDS}))%(?![\w%])",
    # double square or single curly brackets also stand for links and sets: the name must be one of a slot
    rf"\[\[\s*(?:[A-Za-z]\w*[._]\w[\w.]*|[A-Z][A-Z_]+|(?i:{SLOT_WORDS}))\s*\]\]",
    rf"(?<![\w{{$#%\\}}])\{{\s*(?:[A-Za-z]\w*[._]\w[\w.]*|[A-Z][A-Z_]+|(?i:{SLOT_WORDS}))\s*\}}(?!\}})",
    # bracketed phrases
    r"(?iu)[\[<(](?:your|insert|enter|add|type|su|tu|ihr|ihre|dein|votre|vos|ton|escriba|escribir|introduzca|inserte|insérer|insérez|saisir|entrez|indiquez|hier)\s[\p{L} '’]{2,40}[\]>)]",
    r"(?iu)[\[<][\p{L} '’]{2,40}\s(?:here|goes here|hier|einfügen|eintragen|eingeben|ici|aquí|à compléter|à remplir|à insérer)[\]>]",
    rf"(?iu)\[(?:{SLOT_WORDS})\]",
    r"(?iu)<(?:nom|nombre|name|titre|titel|título|title|date|datum|fecha|sujet|objet|asunto|betreff)(?: (?:du|de la|de|del|des|der|of the|of) [\p{L}' ]{2,30})?>",
    r"\b(?:TITLE|TEXT|NAME|DATE|SUBJECT|CONTENT|LINK|IMAGE|BODY) GOES HERE\b",
    r"\b(?:INSERT|ENTER|ADD) (?:TITLE|TEXT|NAME|DATE|SUBJECT|CONTENT|LINK|COMPANY)(?: HERE)?\b",
    r"(?<![\w/])(?:XX?[/.\-]XX?[/.\-](?:XXXX|XX)|(?:DD|MM|JJ|TT)[/.\-](?:MM|DD)[/.\-](?:YYYY|AAAA|JJJJ|YY))(?![\w/])",
    r"(?u)_{4,}\s*\([\p{L} ]{2,30}\)",
]
# What a text must hold for the pattern at the same place to match; looked for first, as it is cheap.
SLOT_NEEDS = [
    ('{{',), ('${',), ('#{',), ('<%',), ('{%',), ('%%',), ('@@',), ('<<',), ('%(',), ('%',), ('[[',), ('{',), ('[', '<', '('), ('[', '<'), ('[',), ('<',), ('GOES HERE',), ('INSERT', 'ENTER', 'ADD'), ('X', 'DD', 'MM', 'JJ', 'TT'), ('____',),
]
CODE = [r"(?s)(?m)^ {0,3}(```|~~~)[^\n]*\n.*?^ {0,3}\1[ \t]*$", r"(?s)<(pre|code)\b[^>]*>.*?</\1>", r"`[^`\n]+`"]


def has_slot(text: Column) -> Column:
    for p in CODE:
        text = F.regexp_replace(text, p, " ")
    # bound once, as the only element of an array
    return F.exists(F.array(text), _any_slot)


def _any_slot(text: Column) -> Column:
    hit = F.lit(False)
    for p, needs in zip(SLOTS, SLOT_NEEDS, strict=True):
        some = F.lit(False)
        for x in needs:
            some = some | text.contains(x)
        hit = hit | (some & text.rlike(p))
    return hit


# -- what templates say ----------------------------------------------------------------------------
# The pseudo-Latin of filler text, with cut endings.
LATIN = ("lorem ipsum dolor dolore dolorem sit amet consec consectetur consectetuer adipis adipisci adipiscing elit sed eiusmod tempor incidunt "
         "incididunt ut et labor labore laboris laborum magna aliqua aliquam aliquip enim ad minim veniam quis nostrud exercitation ullamco nisi ex ea "
         "commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non "
         "proident sunt culpa qui officia deserunt mollit anim id est do").split()
_LATIN = frozenset(LATIN)
LATIN_LONG = 5  # pseudo-Latin has a word of this length
# keys of one row
ROW = r"^(?=[^ ]+ )[asdfghjklöäñ ]{10,}$"
# Reason phrases of HTTP (RFC 9110) for client and server errors.
REASONS = ("bad request|unauthori[sz]ed|payment required|forbidden|not found|method not allowed|not acceptable|proxy authentication required|request time-?\\s?out|conflict|gone|"
           "length required|precondition failed|content too large|payload too large|uri too long|unsupported media type|range not satisfiable|expectation failed|"
           "misdirected request|unprocessable content|upgrade required|too many requests|internal server error|not implemented|bad gateway|service unavailable|"
           "gateway time-?\\s?out|http version not supported")
_SCRIPTS = r"\b(?:java ?scripts?|js|(?:client-side )?script(?:s|ing)?|noscript|skripte?n?|les scripts|los scripts)\b"
_ENABLE = (r"\b(?:enabled?|activated?|allow|unblock|turn|turned|turning|switch|switched|requires?|required|needs?|without|disabled|must|support|run|blocked|won't|"
           r"activ[ae]r?|activez|active|habilit\w+|aktivier\w+|einschalten|ben[öo]tigt?|nécessaires?|necesari[oa]|requis|erforderlich|ohne|sans|sin)\b")
_THING = (r"(?:page|site|website|resource|file|document|content|url|address|link|item|thread|message|topic|"
          r"seite|datei|inhalt|adresse|ressource|página|archivo|recurso|contenido|fichier|adresse|contenu)")
_GONE = (r"(?:not (?:be )?(?:found|located|displayed|available|loaded|exist\w*|reachable)|couldn't be (?:found|located|displayed|loaded)|cannot be (?:found|displayed|loaded|reached)|"
         r"can't be (?:found|displayed|loaded|reached)|no longer (?:exists?|available)|doesn't exist|does not exist|never existed|unavailable|missing|removed|moved|"
         r"nicht (?:gefunden|verfügbar|erreichbar|vorhanden)|existiert nicht|introuvable|n'existe (?:pas|plus)|indisponible|no (?:encontrad[ao]|existe|disponible)|no se (?:encontró|encuentra|puede mostrar))")
_SERVER = r"(?:server|servers|gateway|upstream|backend|proxy|host|service|serveur|servidor|dienst|servicio)"
_DOWN = (r"(?:timed? ?-?out|too long|refused|reset|unreachable|overloaded|not respond\w*|no response|invalid response|not ready|unavailable|not available|offline|failed|"
         r"(?:bad|invalid|malformed|empty|unexpected) (?:response|reply|answer|header)|temporarily|momentan\w*|vorübergehend|überlastet|momentanément|temporairement|temporalmente|fuera de servicio|indisponible)")
_LATER = (r"(?:try again (?:later|soon|in|shortly)|please try again|retry (?:later|in|after)|come back (?:later|soon)|check back (?:later|soon)|later erneut|später (?:erneut|noch ?mal|wieder)|"
          r"réessay\w+|más tarde|inténtelo|vuelva a intentar\w*)")
_SERVER_DOWN = rf"^(?:\S+ ){{0,2}}{_SERVER}\b(?: \S+){{0,5}} {_DOWN}"
# What links around a page are called.
NAVIGATION = ("home menu search archive archives sign log login in up register back to the go report this next previous help contact about us skip content top start page return "
              "try again reload refresh privacy terms inicio accueil startseite menü buscar suche recherche").split()
# links around a page, or its copyright line
AROUND = rf"^(?:(?:{'|'.join(NAVIGATION)})(?: |$)){{1,12}}$|^(?:©|copyright)(?: [^ ]+){{0,4}}$"
TEMPLATES: dict[str, list[str]] = {
    "notice": [
        rf"(?s)\A(?=.*?{_SCRIPTS})(?=.*?{_ENABLE})", r"^loading$",
        r"^(?:please )?(?:turn|switch) (?:it|them) on and (?:reload|refresh|try)", r"^if nothing happens\b",
    ],
    "error": [
        rf"<code>(?: \S+){{0,2}} (?:{REASONS})\b|\b(?:{REASONS})(?: \S+){{0,2}} <code>",
        r"\b(?:error|errors|http|status|code|erreur|fehler|código|oops|whoops|fatal)(?: (?:code|no|nr|number|status))? <code>",
        r"^<code>(?: (?:error|oops|sorry|whoops)\b.*)?$",
        rf"^(?:<code> |<\*> )?(?:(?:http|error|fatal|sorry|oops|whoops|hmm|warning|exception|notice|the|an?|this|reason|cause|grund|raison|motivo) ){{0,2}}(?:{REASONS}|internal (?:error|fault)|server (?:error|fault)|access denied|permission denied|quota exceeded|"
        r"connection (?:to \S+ |from \S+ )?(?:was )?(?:refused|reset|timed out|closed)|acceso denegado|prohibido|zugriff verweigert|accès (?:refusé|interdit)|interner (?:server)?fehler|erreur interne|error interno)\b",
        rf"\b{_THING}\b(?: \S+){{0,7}} {_GONE}", rf"\bno se (?:encontró|pudo cargar|puede mostrar)(?: \S+){{0,2}} {_THING}\b",
        r"\bwe (?:could(?: not|n't)|can(?:not|'t)) (?:find|locate|load|display|process) (?:what|the|this|that|your)\b",
        r"\b(?:must|need to|have to) (?:be )?(?:sign in|signed in|log in|logged in|login) to (?:see|view|access|read|continue)\b|\bdo(?:n't| not) have (?:permission|access|the right)\b|\bnot (?:authori[sz]ed|allowed|permitted) to\b",
        r"^(?:please )?(?:sign|log) in (?:again|to continue)\b|\bsession (?:has |is )?(?:expired|timed out|ended)\b|\bsitzung (?:ist )?abgelaufen\b|\bsession a expiré\b|\bsesión ha (?:caducado|expirado)\b",
        r"\bsomething went wrong\b|\ban? (?:unexpected|unknown|internal) error\b|\b(?:unerwarteter|interner|unbekannter) fehler\b|\berreur (?:inattendue|inconnue|interne)\b|\berror (?:inesperado|desconocido|interno)\b",
        rf"^(?:please )?(?:\S+ ){{0,6}}{_LATER}",
        r"^(?:\S+ ){1,4}is (?:currently |temporarily )?(?:offline|down|unavailable)(?: at the moment| right now| for now)?(?: <code>)?$",
        r"^(?:there was an? )?(?:problem|error|failure|trouble) (?:while |when |in )?(?:accessing|loading|opening|reading|processing|fetching|retrieving|displaying)\b",
        r"\b(?:down|offline|closed) for (?:\S+ )?maintenance\b|\bmaintenance (?:mode|window|in progress)\b|\bwartungsarbeiten\b|\ben maintenance\b|\ben mantenimiento\b",
        _SERVER_DOWN, rf"^(?:no|none of the|all) {_SERVER} (?:is |are )?(?:available|ready|reachable|down|busy|responded)",
        r"^traceback most recent call last|^file \S+ line <\*> in \S|^raise \w+|^at [\w.$]+ \S+ java\b|^\w*(?:error|exception) \S+ at\b|^caused by \w*(?:error|exception)",
        r"^(?:error|request|reference|incident|trace|ray|correlation|transaction|vorgang|référence|referencia)(?: (?:id|code|no|nr|number|nummer))? <\*>$",
        r"^error (?:code|status|message|<code>|<\*>)\b|^(?:status|code) (?:<code>|<\*>) (?:message|error)\b",
    ],
    "filler": [
        r"\byour (?:text|content|title|name|summary|message|description) (?:goes )?here\b|\b(?:insert|enter|add|put|type|write|place)\b(?: \S+){0,5} (?:text|content|title|name|summary|message|description|words?)(?: \S+){0,2} here\b",
        r"\breplace this (?:text|paragraph|sentence|line)\b|^sample text\b|\bplaceholder (?:text|content|page|entry|for)\b|\bdummy (?:text|entry|content)\b|\bfiller text\b",
        r"^(?:todo|tbd|fixme|tba)\b|^(?:(?:content )?coming soon|under construction|to be (?:written|added|done|announced|completed))$|\bno content yet\b|\bcontent coming soon\b",
        r"\b(?:hier (?:steht|kommt) (?:später )?(?:der|ein) (?:text|inhalt)|platzhalter ?text|blindtext|beispieltext|mustertext)",
        r"\b(?:texto de (?:relleno|ejemplo|muestra|prueba)|escriba aquí|reempla\w+ este texto|sustituy\w+ este texto|texte? (?:d'exemple|d’exemple|de remplissage|à remplacer|factice)|remplace\w* ce texte|à remplacer\b)",
    ],
}


MOST = 60  # literals of one pattern that are looked for first


def _runs(parsed) -> list[frozenset[str]]:
    """Sets of literals of a parsed pattern; every match holds a member of each set."""
    out: list[frozenset[str]] = []
    exact: list[str] = [""]  # all that the pattern can match so far since the last break

    def end() -> None:
        nonlocal exact
        if all(exact):
            out.append(frozenset(exact))
        exact = [""]
    for op, arg in parsed:
        op = str(op)
        options: list[str] | None = None
        if op == "LITERAL":
            options = [chr(arg)]
        elif op == "IN" and len(arg) <= 3 and all(str(o) == "LITERAL" for o, _ in arg):
            options = [chr(v) for _, v in arg]
        elif op in ("AT", "ASSERT_NOT"):
            continue
        elif op == "ASSERT":
            out += _runs(arg[1]) if arg[0] > 0 else []
            continue
        elif op == "SUBPATTERN" or op == "BRANCH":
            branches = arg[1] if op == "BRANCH" else [arg[3]]
            words = [_word(b) for b in branches]
            if all(w is not None for w in words) and len(exact) * sum(map(len, words)) <= MOST:
                options = [x for w in words for x in w]
            else:
                sets = [_best(_runs(b)) for b in branches]
                if all(sets):
                    out.append(frozenset().union(*sets))
        elif op.endswith("REPEAT"):
            if arg[0] == 0 and arg[1] == 1 and (w := _word(arg[2])) is not None and len(exact) * (len(w) + 1) <= MOST:
                options = ["", *w]
            elif arg[0] > 0:
                out += _runs(arg[2])
        if options is None:
            end()
        else:
            exact = [e + o for e in exact for o in options]
    end()
    return out


def _word(parsed) -> list[str] | None:
    """All strings that a pattern without repeats can match, or None."""
    exact = [""]
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            options = [chr(arg)]
        elif op == "IN" and len(arg) <= 3 and all(str(o) == "LITERAL" for o, _ in arg):
            options = [chr(v) for _, v in arg]
        elif op in ("SUBPATTERN", "BRANCH"):
            words = [_word(b) for b in (arg[1] if op == "BRANCH" else [arg[3]])]
            if any(w is None for w in words):
                return None
            options = [x for w in words for x in w]
        elif op.endswith("REPEAT") and arg[0] == 0 and arg[1] == 1 and (w := _word(arg[2])) is not None:
            options = ["", *w]
        elif op == "AT":
            continue
        else:
            return None
        exact = [e + o for e in exact for o in options]
        if len(exact) > MOST:
            return None
    return exact


def _best(sets: list[frozenset[str]]) -> frozenset[str]:
    """The set that says most: literals of some length (wildcards aside), and few of them."""
    return max(sets, key=lambda s: (min(4, *(len(x.replace(ANY, "").strip()) for x in s), 4), -len(s), min(map(len, s))), default=frozenset())


# the part of a pattern whose words are rarest, where that isn't plain from their length and number
RAREST = {TEMPLATES["notice"][0]: _SCRIPTS, _SERVER_DOWN: _DOWN}


def _literals(pattern: str) -> frozenset[str]:
    """Literals of which every match holds one; empty if none is known."""
    found = frozenset(x.strip(" ") for x in _best(_runs(_parser.parse(RAREST.get(pattern, pattern)))))
    return frozenset() if "" in found else found


@functools.lru_cache(maxsize=256)
def needs(pattern: str) -> tuple[str, ...]:
    """The same without those that hold another of them, so that they can be looked for first."""
    found = _literals(pattern)
    return tuple(sorted(x for x in found if not any(y in x for y in found if y != x)))


def _trie(words: set[str]) -> str:
    """A pattern for any of the words, with their beginnings shared."""
    if "" in words:
        return ""
    heads: dict[str, set[str]] = {}
    for w in words:
        heads.setdefault(w[0], set()).add(w[1:])
    parts = [re.escape(c) + _trie(rest) for c, rest in sorted(heads.items())]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


# Literals that may stand inside a word; all others are looked for at the beginning of a word only.
INSIDE = ("error", "exception", "script", "skript")


@functools.lru_cache(maxsize=1)
def any_need() -> str:
    """What a template must hold to get a verdict by a pattern or as pseudo-Latin, unless it is in ``INSIDE``."""
    # where a template has a wildcard, its records have any word
    every = {max(x.split(ANY), key=len).strip() for patterns in TEMPLATES.values() for p in patterns for x in _literals(p)} | {w for w in LATIN if len(w) >= LATIN_LONG}
    every = {x for x in every if not any(y in x for y in INSIDE)}
    return f"(?:^| )(?:{_trie({x for x in every if not any(x.startswith(y) for y in every if y != x)})})"


@functools.lru_cache(maxsize=1)
def _compiled() -> tuple[re.Pattern, list[tuple[str, tuple[str, ...], re.Pattern]]]:
    return re.compile(any_need()), [(kind, needs(p), re.compile(p)) for kind, patterns in TEMPLATES.items() for p in patterns]


def verdict(template: str) -> str | None:
    """What a template says: notice, error, filler, navigation or None."""
    some, patterns = _compiled()
    words = template.split(" ")
    if any(x in template for x in INSIDE) or some.search(template):
        for kind, literals, pattern in patterns:
            if any(x in template for x in literals) and pattern.search(template):
                return kind
        own = [w for w in words if w != ANY]
        latin = [w for w in own if w in _LATIN]
        if len(own) >= 3 and len(latin) >= 0.6 * len(own) and max(map(len, latin)) >= LATIN_LONG:
            return "filler"
    if ANY in template:
        return None
    if len(words) >= 6 and len(set(words)) * 4 <= len(words) or re.search(ROW, template):
        return "filler"
    return "navigation" if re.search(AROUND, template) else None


def may_say(record: Column) -> Column:
    """Whether a template with the words of a record may get a verdict; its words are among the record's."""
    words = F.split(record, " ")
    drum = (F.size(words) >= 6) & (F.size(F.array_distinct(words)) * 4 <= F.size(words))
    inside = F.lit(False)
    for x in INSIDE:
        inside = inside | record.contains(x)
    return inside | record.rlike(any_need()) | drum | record.rlike(ROW) | record.rlike(AROUND)


_BLOCK = r"(?i)</?(?:h[1-6]|p|div|br|hr|li|ul|ol|tr|td|th|table|title|head|body|html|header|footer|nav|section|article)(?:\s[^<>\n]*)?/?>"


def records(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, record, chars): the words of every sentence of every line."""
    plain = F.regexp_replace(F.regexp_replace(F.col(text), r"(?i)<noscript>", " noscript: "), _BLOCK, "\n")
    plain = F.regexp_replace(plain, r"<[/!]?[a-zA-Z][^<>\n]*>", " ")
    plain = F.when(F.col(text).contains("<"), plain).otherwise(F.col(text))
    lines = F.split(plain, r"\r?\n|\r|(?<=[.!?。])\s+(?=[\p{Lu}¿¡\[\"'])")
    one = docs.select(F.col(key).alias("key"), F.explode(lines).alias("line"))
    words = F.trim(F.regexp_replace(F.lower("line"), r"[^\p{L}\p{M}\p{N}_'’©-]+", " "))
    coded = F.regexp_replace("words", r"(?<![^ ])[45][0-9][0-9](?![^ ])", "<code>")
    masked = F.regexp_replace(coded, r"[^ ]*[0-9][^ ]*", ANY)
    one = one.select("key", words.alias("words"), F.length(F.trim("line")).alias("chars")).filter("words <> ''")
    return one.select("key", F.when(F.col("words").rlike("[0-9]"), masked).otherwise(F.col("words")).alias("record"), "chars")


def mine(records: DataFrame) -> DataFrame:
    """(record, template) of the distinct records of all leaves that may get a verdict."""
    words = F.split("record", " ")
    path = F.concat_ws(" ", F.size(words).cast("string"), F.slice(words, 1, DEPTH))
    distinct = records.groupBy("record").agg(F.count("*").alias("c")).withColumns({"path": path, "may": may_say(F.col("record"))})
    distinct = cut(distinct, "distinct")
    # leaves none of whose templates can get a verdict are left as they are
    every = cut(distinct.groupBy("path").agg(F.sum("c").alias("total"), F.count("*").alias("n"), F.max("may").alias("may")).filter("may"), "leaves")
    distinct = distinct.join(every.select("path"), "path", "left_semi")
    leaf = every.filter("n > 1").select("path", "total")
    # words of the places below the head that enough of the leaf's records have
    shared = distinct.join(leaf, "path")
    places = shared.select("path", "c", "total", F.posexplode(words).alias("at", "word")).filter(F.col("at") >= DEPTH)
    kept = places.groupBy("path", "total", "at", "word").agg(F.sum("c").alias("c")).filter(F.col("c") * SPLIT >= F.col("total"))
    kept = kept.groupBy("path").agg(F.concat(F.lit("|"), F.array_join(F.collect_set(F.concat_ws(" ", "at", "word")), "|"), F.lit("|")).alias("kept"))
    # a leaf of several records without any shared word has an empty list, a leaf of one has null
    kept = leaf.select("path").join(kept, "path", "left").select("path", F.coalesce("kept", F.lit("|")).alias("kept"))
    template = F.array_join(F.transform(words, lambda w, i: F.when((i < DEPTH) | F.col("kept").contains(F.concat(F.lit("|"), i.cast("string"), F.lit(" "), w, F.lit("|"))), w).otherwise(ANY)), " ")
    return distinct.join(kept, "path", "left").select("record", F.when(F.col("kept").isNull(), F.col("record")).otherwise(template).alias("template"))


def classified(routed: DataFrame) -> DataFrame:
    """(record, verdict): each distinct template gets its verdict once, its records get it from there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = [(t, v) for t in b.column(0).to_pylist() if (v := verdict(t))]
            yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in said], pa.string()) for n in (0, 1)], ["template", "verdict"])
    routed = cut(routed, "routed")
    templates = cut(routed.select("template").distinct().mapInArrow(run, "template string, verdict string"), "templates")
    return routed.join(templates, "template").select("record", "verdict")


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, reason) of every document to leave out; reason is slot, notice, error or filler."""
    docs = spread(docs.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text))
    slots = docs.filter(has_slot(F.col(text))).select(F.col(key).alias("key"), F.lit("slot").alias("reason"))
    rows = cut(records(docs, key, text), "records")
    said = cut(classified(mine(rows)), "verdicts")
    rows = rows.join(said, "record", "left")
    v, chars = F.col("verdict"), F.col("chars")
    title = v.isNull() & (F.size(F.split("record", " ")) <= 2)
    sums = [F.sum(F.when(v == x, chars).otherwise(0)).alias(x) for x in ("notice", "error", "filler")]
    weight = rows.groupBy("key").agg(*sums, F.sum(F.when(v.isNull() & ~title, chars).otherwise(0)).alias("ordinary"))
    total = F.col("notice") + F.col("error") + F.col("filler")
    reason = (F.when((F.col("notice") >= F.col("error")) & (F.col("notice") >= F.col("filler")), "notice")
              .when(F.col("error") >= F.col("filler"), "error").otherwise("filler"))
    whole = weight.filter((total > 0) & (total >= F.col("ordinary"))).select("key", reason.alias("reason"))
    return (slots.unionByName(whole).groupBy("key").agg(F.min(F.struct((F.col("reason") == "slot").alias("s"), "reason")).alias("m"))
            .select(F.col("key").alias(key), F.col("m.reason").alias("reason")))
