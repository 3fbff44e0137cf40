"""Small cases of each operator: nulls, blanks, long texts, ties, repeats, clashing columns, empty tables."""

import collections
import datetime as dt
import itertools
import math
import pickle
import random
import re

import pytest
from pyspark.sql import functions as F

from chatlore.llm import conversations as C
from chatlore.llm import frequency as N
from chatlore.llm import leakage as L
from chatlore.llm import markup as M
from chatlore.llm import pii as P
from chatlore.llm import pii_training
from chatlore.llm import queries as Q
from chatlore.llm import residue as R
from chatlore.llm import tokenizer as K

LONG = "The relay kept the old list. " * 20_000


# -- 1 ---------------------------------------------------------------------------------------------
LEX = P.Lexicon(["jon", "mira"], ["harrowell", "sandquist"])
PII = {
    "ask Mira Sandquist about it": {"name"}, "J. Harrowell did it again": {"name"}, "harrowell, mira": {"name"}, "MIRA HARROWELL (nights)": {"name"}, "write to mira.harrowell@example.org": {"email"},
    "jon (at) mail (dot) example": {"email"}, "jon＠mail.example": {"email"}, "call me on 212-555-0145": {"phone"}, "fax ２１２-５５５-０１４５": {"phone"}, "pager +49 (0)30 23125-780": {"phone"},
    "for the visitor list: 912-45-6789": {"id_number"}, "passport no. Q1234567": {"id_number"}, "DNI 12345678Z": {"id_number"}, "find me at 17 Copper Mill Lane": {"address"}, "P.O. Box 77, Ostwick": {"address"},
    "Lindenweg 12a, 01234 Oberdorf": {"address"}, "Calle Mirto 7, 2º B": {"address"}, "part no. 912-45-6789 of the printer is out of stock": set(), "build 594.870.7162 is slower than 3.32": set(),
    "icon@2x.png is missing": set(), "the host answers on 10.20.30.40 port 8080": set(), "Amber Gate was the name of the 7th release": set(), "": set(), "  \n": set(), None: set(), LONG: set(),
    "Mira Sandquist\n17 Mill Road\ntel 212-555-0145\nmira@example.org": {"name", "address", "phone", "email"},
}


def test_personal_data(spark):
    rows = list(PII)
    df = spark.createDataFrame([(n, t, "x", "y") for n, t in enumerate(rows)] + [(0, rows[0], "x", "y")], "id long, body string, kind string, n string")
    got = collections.defaultdict(set)
    for r in P.entities(df, "id", ["body"], LEX).collect():
        got[r.id].add(r.kind)
    assert {rows[n]: k for n, k in got.items()} == {t: k for t, k in PII.items() if k}
    masked = {r.id: r.body for r in P.mask(df, "id", ["body"], LEX).collect()}
    assert masked[0] == "ask [NAME] about it" and masked[4] == "write to [EMAIL]" and masked[rows.index(None)] is None and masked[rows.index(LONG)] == LONG
    assert P.entities(df.limit(0), "id", ["body"], LEX).count() == 0


def test_held_out_accuracy():
    w, right, wrong = P.weights(), 0, 0
    for text, gold, lex in pii_training.sentences(400, seed=77):
        got, want = {k for _, _, k in P.find(text, lex, w)}, {k for _, _, k in gold}
        right += len(got & want)
        wrong += len(got ^ want)
    assert wrong <= 0.05 * right


def chain_value(t, w, chosen):
    """Score of a chain of segments, given by their numbers."""
    total, before = 0.0, None
    for k in chosen:
        a, _, kind, feats = t.segments[k]
        near = before is not None and a - t.segments[before][1] <= P.NEAR
        total += sum(w.get(f, 0.0) for f in feats) + w.get(P.transition(t, before, k) if near else f"O>{kind}", 0.0)
        before = k
    return total


def chains(t):
    """All sets of segments that don't overlap, in order."""
    def go(k, end):
        if k == len(t.segments):
            yield ()
            return
        yield from go(k + 1, end)
        a, b = t.segments[k][:2]
        if a >= end:
            yield from ((k, *rest) for rest in go(k + 1, b))
    return [c for c in go(0, 0) if all(t.segments[x][1] <= t.segments[y][0] for x, y in zip(c, c[1:]))]


def test_decoding_is_the_best_choice():
    """Against all chains of segments that don't overlap."""
    w = P.weights()
    for text, _, lex in pii_training.sentences(150, seed=5):
        t = P.Text(text, lex)
        if len(t.segments) > 10:
            continue
        at = {s[:3]: n for n, s in enumerate(t.segments)}
        got = chain_value(t, w, [at[c] for c in P.decode(t, w)])
        assert got == pytest.approx(max(chain_value(t, w, c) for c in chains(t)), abs=1e-9)


def test_expectations_are_sums_over_chains():
    w = P.weights()
    for text, _, lex in pii_training.sentences(60, seed=6):
        t = P.Text(text, lex)
        if not 0 < len(t.segments) <= 9:
            continue
        weight = {c: math.exp(chain_value(t, w, c)) for c in chains(t)}
        total = sum(weight.values())
        z, p, pairs = P.expectations(t, w)
        assert z == pytest.approx(math.log(total), rel=1e-6)
        assert p == pytest.approx([sum(v for c, v in weight.items() if k in c) / total for k in range(len(t.segments))], abs=1e-6)
        for (x, y), v in pairs.items():
            assert v == pytest.approx(sum(u for c, u in weight.items() if (x, y) in zip(c, c[1:])) / total, abs=1e-6)


def test_transitions_are_trained_and_decide():
    w = P.weights()
    assert sum(">" in f and abs(v) > 0.1 for f, v in w.items()) > 20
    without = P.Weights({f: v for f, v in w.items() if ">" not in f})
    changed = [text for text, _, lex in pii_training.sentences(600, seed=78) if P.find(text, lex, w) != P.find(text, lex, without)]
    assert changed


def test_training_sentences_are_not_of_the_archive(spark, small):
    rows = spark.read.parquet(f"{small}/zgrams.parquet").select("body", "signature").collect()
    archive = "\n".join(x for r in rows for x in r if x)
    assert [p for p in pii_training.phrases() if sum(map(str.isalpha, p)) >= 6 and p in archive] == []


def test_long_segments_and_number_runs():
    lex = P.Lexicon()
    long = "a." * 400 + "x@mail.example.org"
    assert [(k, text) for a, b, k in P.find(f"write {long}", lex, P.weights()) for text in [f"write {long}"[a:b]]] == [("email", long)]
    text = "tel 1 2 3 4 5 6 7 8 9 0 12 34"
    spans = {text[a:b] for a, b, kind, _ in P.Text(text, lex).segments if kind == "phone"}
    assert "4 5 6 7 8 9 0" in spans and "1 2 3 4 5 6 7 8 9 0 12 34" in spans


def test_lexicon_is_mined(spark):
    r = random.Random(1)
    given, family = [f"Gi{c}lo" for c in "abcdefgh"], [f"Fa{c}mer" for c in "abcdefgh"]
    texts = [f"ask {r.choice(given)} {r.choice(family)} now" for _ in range(400)] + ["ask Blue Lantern now"] * 50 + [None, ""]
    lex = P.mine_lexicon(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert lex.given == {g.lower() for g in given} and lex.family == {f.lower() for f in family}
    assert not P.mine_lexicon(spark.createDataFrame([], "text string")).given


def test_rare_lower_case_names(spark):
    """Names that one text of a small collection writes in title case, elsewhere in lower case."""
    texts = ["I met Ulvo Trenkirst", "ask ulvo trenkirst about it", "ask the parser about it", "cc mailing list", "thanks for that", None, "nobody here waits for ok"]
    df = spark.createDataFrame([(n, t, "k") for n, t in enumerate(texts)], "id long, body string, known string")
    assert {r.id for r in P.entities(df, "id", ["body"], P.lexicon_table(df, "body")).collect()} - {0} == {1}
    unknown = P.Text("ask ulvo trenkirst about it", P.Lexicon())
    assert any(unknown.s[a:b] == "ulvo trenkirst" for a, b, _, _ in unknown.segments)


def test_lexicon_too_large_to_send(spark, monkeypatch):
    """The join finds what the sent lexicon finds, whatever its size; none of its words is cut off."""
    names = [("gi" + a + b + "lo", "fa" + b + a + "mer") for a in "bcdfgklmnp" for b in "aeiouyrstz"]
    lex = spark.createDataFrame([(w, c + w) for g, f in names for w, c in ((g, "G"), (f, "F"))], "word string, code string")
    rows = [(n, f"ask {g} {f} about it", f"{f.upper()}-x, {g}") for n, (g, f) in enumerate(names)] + [(500, None, ""), (501, "ask the parser about it", None)] * 2
    df = spark.createDataFrame(rows, "id long, body string, signature string")
    fields = ["body", "signature"]
    want = sorted(map(tuple, P.entities(df, "id", fields, lex).collect()))
    masked = sorted(P.mask(df, "id", fields, lex).collect(), key=str)
    assert {k for k, f, kind, _ in want if f == "body" and kind == "name"} == set(range(100))
    monkeypatch.setattr(P, "BROADCAST_WORDS", 10)
    assert sorted(map(tuple, P.entities(df, "id", fields, lex).collect())) == want
    assert sorted(P.mask(df, "id", fields, lex).collect(), key=str) == masked


# -- 2 ---------------------------------------------------------------------------------------------
@pytest.mark.parametrize("max_n", [1, 2, 4])
def test_ngrams_against_brute_force(spark, max_n):
    r = random.Random(3)
    docs = [[r.choice("abcab") for _ in range(r.randint(0, 12))] for _ in range(150)] + [["a"] * 300, None, [], ["z", None, "y"], ["z", "y"], ["z", "y"]]
    df = spark.createDataFrame([("f", d, 1, "t") for d in docs], "field string, tokens array<string>, n int, occ string")
    occ, rec = collections.Counter(), collections.Counter()
    for d in docs:
        d = [t for t in d or [] if t is not None]
        grams = [tuple(d[i : i + n]) for n in range(1, max_n + 1) for i in range(len(d) - n + 1)]
        occ.update(grams)
        rec.update(set(grams))
    got = {tuple(x.gram): (x.occurrences, x.records) for x in N.ngram_counts(df, max_n=max_n).collect()}
    assert got == {g: (occ[g], rec[g]) for g in occ}
    assert N.ngram_counts(df.limit(0), max_n=max_n).count() == 0


def test_words_and_marks(spark):
    df = spark.createDataFrame([("Don't STOP 'now' a''b x_y É9",), (None,)], "t string")
    assert df.select(N.words(F.col("t"))).first()[0] == ["don't", "stop", "now", "a''b", "x", "y", "é9"]
    counts = spark.createDataFrame([(2,), (3,), (5,), (6,)], "records long")
    assert [r.mark for r in N.mark(counts, 100).orderBy("records").collect()] == ["rare", None, None, "common"]


# -- 3 ---------------------------------------------------------------------------------------------
def archive(spark, messages, edges, purged=()):
    z = spark.createDataFrame([(i, t, s, inst, body, "x") for i, t, s, inst, body in messages], "zgram_id long, timesecs long, sender string, instance string, body string, root string")
    e = spark.createDataFrame([(n, a, b, v) for n, (a, b, v) in enumerate(edges)], "seq long, zgram_id long, refers_to long, value boolean")
    p = spark.createDataFrame([(i, dt.datetime(2001, 1, 1)) for i in purged], "zgram_id long, purged_at timestamp")
    return z, e, p


def thread(first, n, senders="ab", inst="i"):
    return [(first + k, 100 + k, senders[k % len(senders)], inst, "x") for k in range(n)]


def test_conversations(spark):
    messages = (thread(1, 3) + thread(10, 2) + thread(20, 2, "a") + thread(30, 2) + thread(40, 2) + thread(50, 3) + thread(60, 2) + thread(70, 2) + thread(80, 2) + thread(90, 40)
                + [(200, 5, "a", " Ops", "x"), (201, 5, "b", "oPs ", "x"), (210, 9, "a", "i", "x"), (211, 8, "b", "i", "x"), (220, 1, None, "i", "x"), (221, 2, "b", "i", "x"), (222, 3, "c", "i", " \t\n"), (230, 1, "a", None, "x"), (231, 2, "b", None, "x")])
    edges = [(2, 1, True), (3, 2, True), (2, 1, True), (11, 10, True), (11, 10, False), (21, 20, True), (31, 30, True), (41, 40, True), (40, 41, True), (51, 50, True), (52, 51, True), (52, 50, True),
             (61, 60, True), (61, 999, True), (71, 70, True), (71, 71, True), (81, 80, True), (201, 200, True), (211, 210, True), (221, 220, True), (222, 221, True), (231, 230, True), (None, 5, True), (5, None, True), (300, 301, None)]
    edges += [(k, k - 1, True) for k in range(91, 130)]
    z, e, p = archive(spark, messages + messages[:2], edges, [31])
    got = sorted((r.root_id, r.turn, r.zgram_id, r.role) for r in C.conversations(z, e, p).collect())
    want = [(1, 1, 1, "starter"), (1, 2, 2, "responder"), (1, 3, 3, "starter"), (80, 1, 80, "starter"), (80, 2, 81, "responder"), (200, 1, 200, "starter"), (200, 2, 201, "responder")]
    want += [(90, k + 1, 90 + k, "starter" if k % 2 == 0 else "responder") for k in range(40)]
    assert got == sorted(want)
    assert {r.zgram_id for r in C.dropped(z, e).collect()} == {40, 41}
    assert C.conversations(z.limit(0), e.limit(0), p.limit(0)).count() == 0


# -- 6 ---------------------------------------------------------------------------------------------
MARKED = {
    "<b>x</b>": "html", "a<br>b": "html", "<!-- c --> x": "html", "x &amp; y": "html", "x &#8217; y": "html", "# head\n\ntext": "markdown", "head\n====\ntext": "markdown", "```py\nx\n```": "markdown", "~~~\nx\n~~~": "markdown",
    "run `x` now": "markdown", "a **b c** d": "markdown", "~~a b~~ c": "markdown", "__a b__": "markdown", "[a](/b.html)": "markdown", "![a](b.png)": "markdown", "> a\n> b": "markdown", "- a\n- b": "markdown", "1. a\n2. b": "markdown",
    "| a | b |\n|---|---|": "markdown", "== a b ==": "wiki", "[[a|b c]]": "wiki", "{{note|x=1}}": "wiki", "'''a''' b": "wiki", "''a b'' c": "wiki", '{| class="x"\n|}': "wiki", r"\emph{a}": "latex", "\\begin{itemize}\n\\item a\n\\end{itemize}": "latex",
    "$$x$$": "formula", r"\[ x \]": "formula", r"a \(x\) b": "formula", "$O(n^2)$ at best": "formula", "so $ b_{6} = 6 $ holds": "formula",
}
PLAIN = ["C:\\docs\\x.txt", "\\o/", "set $HOME and $PATH", "seats are $ 6 to $ 12 each", "if a <5 and y> 6", "<3", "a -> b", "<- new", "C++ or C# or C*?", "3 * 5 * 6", "a_b_3", "said [sic] in note [2]", "{1, 7}", "see #95 and #x", "a == b == 3",
         "x~~ and y++ but z--", "<ann@example.org>", "R&D; Q&A;", "isn''t it isn''t", "|", "", " ", None, LONG, "*" * 5000, "_" * 5000, "<b " * 3000, "$ " * 3000, "[[" * 3000, "a" * 200_000 + "\n"]


def test_markup_kinds(spark):
    texts = list(MARKED) + PLAIN
    df = spark.createDataFrame([(n, t, "k") for n, t in enumerate(texts)], "id long, body string, text string")
    got = {r.id: r.kinds for r in M.clean(df).collect()}
    for n, t in enumerate(texts):
        assert (MARKED[t] in got[n]) if t in MARKED else got[n] == [], repr(t)[:80]
    assert M.clean(df.limit(0)).count() == 0


CLEAN = {
    "<h2>Head</h2><p>a &lt; b&nbsp;c</p>": "# Head\n\na < b c", "Head\n===\ntext": "# Head\ntext", "== Head ==\n* [[a|b]]": "# Head\n- b", "\\section{Head}\n\\begin{itemize}\n\\item a\n\\end{itemize}": "# Head\n\n- a",
    "```py\nx = 1\n```\nb": "    x = 1\nb", "a **b** ~~c~~ `d`": "a b c `d`", r"\[ x^2 \] b": "$ x^2 $ b", "[t](/u) &#233;&#x1F600;": "t é😀", "<script>x()</script>y": "y", "{| class=\"x\"\n|-\n| a || 4\n|}\nb": "a || 4\n\nb", "x": "x", "": "",
}


def test_clean_text(spark):
    df = spark.createDataFrame([(k,) for k in CLEAN] + [(None,)], "body string")
    got = {r.body: r.clean_text for r in M.clean(df).collect()}
    squeeze = lambda s: "\n".join(x for x in s.split("\n") if x.strip()) if s is not None else None
    assert {k: squeeze(v) for k, v in got.items()} == {k: squeeze(v) for k, v in CLEAN.items()} | {None: None}


WHOLE = {
    "```py\n# a\n* x\n\n\n\n\n__init__ &amp; **b**\n```\n* y": "    # a\n    * x\n    \n    \n    \n    \n    __init__ &amp; **b**\n- y",
    "~~~\n```\n<!-- c -->\n~~~\nz": "    ```\n    <!-- c -->\nz", "````\n```\n_a_\n````": "    ```\n    _a_", "a\n```\n* x\n_y_": "a\n    * x\n    _y_", "```\nx\n```\n---\nb": "    x\n---\nb",
    "<pre><code>* a &lt; b\n__c__</code></pre>": "    * a < b\n    __c__", "<pre>\n# a\n<b>_b_</b>\n</pre>": "    # a\n    _b_", "use <code>__a__</code> now": "use `__a__` now", "use `__a__` **b**": "use `__a__` b",
    "\\begin{verbatim}\n* x\n\\item __y__\n\\end{verbatim}": "    * x\n    \\item __y__", "\\begin{lstlisting}[language=C]\n* x\n# y\n\\end{lstlisting}": "    * x\n    # y", "\\begin{minted}{c}\n* x\n\\end{minted}": "    * x",
    "\\begin{align*}\na &= b \\\\\n* c &= _d_\n\\end{align*} *e*": "$a &= b \\\\\n* c &= _d_$ e", "\\[ \n_a_ + \\mbox{x}\n\\]": "$ \n_a_ + \\mbox{x}\n$", "$a_1 * _b_ * c$": "$a_1 * _b_ * c$",
    "<!-- ```\nx -->*y*": "y", "&eacute;&NotEqualTilde;&AMP;&amp;lt;&nosuch;&frac12;&#38;gt;&#65;": "é\u2242\u0338&&lt;&nosuch;½&gt;A", "\ufdd00\ufdd2 `a` &#xFDD1;0&#xFDD2;": "\ufdd00\ufdd2 `a` \ufffd0\ufffd",
}


def test_code_and_formulas_stay_whole(spark):
    long = "```\n" + "* __a__\n" * 30_000 + "```"
    df = spark.createDataFrame([(k, "t") for k in [*WHOLE, long]], "body string, took string")
    got = {r.body: r.clean_text for r in M.clean(df).collect()}
    assert got.pop(long) == "    * __a__\n" * 29_999 + "    * __a__"
    assert {k: v.strip("\n") for k, v in got.items()} == WHOLE
    assert M.clean(df).columns == ["body", "took", "clean_text", "kinds"]


def test_line_blocks(spark):
    """Navigation and footers go, with the parameters of production; texts of even lines, and code, stay whole."""
    nav, content = "Home\n[News](/n)\n\n\n\n\n", "# Head\n" + "a **long** line of content that goes on and on and on\n" * 3
    code = "```\nx = 1\n```"
    texts = [nav + content + "\n\n\n\nfoot", content, "*a*\n\n\n\nb\n\n\n\nc", content + "\n\n\n\n" + code, "*one*"]
    got = {r.body: r.clean_text for r in M.clean(spark.createDataFrame([(t,) for t in texts], "body string")).collect()}
    line = "a long line of content that goes on and on and on"
    assert [x for x in got[texts[0]].split("\n") if x] == ["# Head", line, line, line]
    assert got[texts[1]].strip("\n").split("\n") == ["# Head", line, line, line]
    assert [x for x in got[texts[2]].split("\n") if x] == ["a", "b", "c"]
    assert "    x = 1" in got[texts[3]] and got["*one*"] == "one"


RESIDUE_FREE = {
    "an _italic_ word, a_b_c": "an italic word, a_b_c", "&eacute; &rarr; x": "é → x", r"\emph{a \textbf{b}} c": "a b c", r"\textcolor{red}{a \emph{b \textit{c}}}": "a b c", "so {{important text}} stays": "so important text stays",
    "x {{note|kept}} {{call}} y": "x kept  y", "use `**kwargs**` **now**": "use `**kwargs**` now", "```python\n# note\ndef f(**kw):\n    x = __init__\n```": "    # note\n    def f(**kw):\n        x = __init__",
    "<pre><code>* c\nd</code></pre>": "    * c\n    d",
}


def test_no_residue_and_nothing_lost(spark):
    got = {r.body: r.clean_text for r in M.clean(spark.createDataFrame([(t,) for t in RESIDUE_FREE], "body string")).collect()}
    assert {k: v.strip("\n") for k, v in got.items()} == RESIDUE_FREE


def test_found_by_what_stripping_takes(spark, small, monkeypatch):
    """Without the stripping nothing but the marks of headings and items is found."""
    found = {r.zgram_id for r in Q.p6_found(spark, small).collect()}
    assert found == {r.zgram_id for r in Q.p6_clean(spark, small).select("zgram_id").collect()} and found
    monkeypatch.setattr(M, "STRIP", [])
    monkeypatch.setattr(M, "marked", lambda text, took: text)
    monkeypatch.setattr(M, "_references", lambda text: text)
    left = {r.zgram_id for r in Q.p6_found(spark, small).collect()}
    assert left < found and len(left) * 10 < len(found)


# -- 8 ---------------------------------------------------------------------------------------------
TEXTS = ["", None, " ", "hello world", "<|endoftext|> is text", "naïve café 🤷‍♀️ \u200b\ufeff", "\r\n\t", "汉字" * 50, ("line one of it\nand 'two'  more\n\n" * 9_000), "x" * 150_000, "a\x00b", "e\u0301" * 20]


def test_encoding(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(K.vocabulary())
    t.encode_special_tokens = True
    df = spark.createDataFrame([(n, x, "c") for n, x in enumerate(TEXTS)] + [(3, TEXTS[3], "c")], "doc_id long, text string, ids string")
    ids = K.encode(df)
    got = {r.doc_id: r.ids for r in ids.collect()}
    assert got == {n: t.encode(x, add_special_tokens=False).ids if x else [] for n, x in enumerate(TEXTS)}
    assert ids.count() == len(TEXTS) + 1 and K.encode(df.limit(0)).count() == 0
    assert {r.doc_id: r.text for r in K.decode(ids).collect()} == {n: x or "" for n, x in enumerate(TEXTS)}
    table = K.byte_table()
    for r in K.encode_with_offsets(df).collect():
        x = TEXTS[r.doc_id] or ""
        assert r.ids == got[r.doc_id] and len(r.begins) == len(r.ends) == len(r.ids)
        at = 0
        for i, a, b in list(zip(r.ids, r.begins, r.ends))[:3000]:
            n = sum(c in table for c in K.load(K.vocabulary()).id_to_token(i))
            if len(x) < 20_000:
                assert a == len(x.encode()[:at].decode(errors="ignore")) and x[a:b].encode() in (x.encode()[at : at + n], x[a:b].encode()) and len(x[a:b].encode()) >= n
            at += n
        assert (r.ends[-1] if r.ends else 0) == len(x)


# -- 9 ---------------------------------------------------------------------------------------------
def brute_readings(text):
    """All sequences of words, with every line-end hyphen read either way."""
    pieces = re.split(r"(?<=\w)-[ \t]*\r?\n[ \t>]*(?=\w)", text)
    return [L.words("".join(p + g for p, g in zip(pieces, [*gaps, ""]))) for gaps in itertools.product(["", " "], repeat=len(pieces) - 1)]


def items_and_docs():
    r = random.Random(9)
    vocab = [f"w{n}" for n in range(120)]
    items = [(n, " ".join(r.choice(vocab) for _ in range(r.randint(5, 60))), "w1 w2", "w3") for n in range(40)] + [(90, None, "q", None), (91, "", None, "a"), (92, " ".join(vocab[:20]), "w1", "w7"), (93, " ".join(vocab[:20]), "w1", "w7")]
    docs = []
    for n in range(300):
        w = [r.choice(vocab + ["zz"]) for _ in range(r.randint(0, 80))]
        if n % 3 == 0:
            p = r.choice(items[:40])[1].split()
            k = r.randint(0, max(0, len(p) - 13))
            p = p[k : k + r.choice([12, 13, 14, 40])]
            if n % 2:  # broken at some line ends, within words and between them
                p = [x if r.random() < 0.8 else x[:1] + "-\n" + x[1:] for x in p]
                p = [y for x in p for y in ([x] if "-" in x or r.random() < 0.9 else [x + "-\n" + "zz"])]
            w[r.randint(0, len(w)):0] = p
        docs.append((n, " ".join(w)))
    return items, docs + [(900, None), (901, ""), (902, " "), (903, " ".join(vocab[:20]) * 2000), (904, "W0, **w1** <b>w2</b> w3\n> w4 w5&nbsp;w6 ｗ7 w8 w\u00ad9 w10 w11 [w12](/x y) w13")]


def test_leaks_against_brute_force(spark):
    items, docs = items_and_docs()
    it = spark.createDataFrame(items, "item_id long, passage string, question string, answer string")
    dd = spark.createDataFrame([(a, b, 0) for a, b in docs], "doc_id long, text string, item_id int")
    want = set()
    runs = {i: {tuple(w[k : k + 13]) for k in range(len(w) - 12)} for i, p, _, _ in items if (w := L.words(p or ""))}
    for d, t in docs:
        for w in brute_readings(t or ""):
            have = {tuple(w[k : k + 13]) for k in range(len(w) - 12)}
            want |= {(d, i) for i, x in runs.items() if x & have}
    got = L.find(dd, it).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and (903, 92) in want and (903, 93) in want
    assert all(r.run_words >= 13 for r in got)
    assert L.find(dd.limit(0), it).count() == 0 and L.find(dd, it.limit(0)).count() == 0


def test_index_gives_all_above_threshold():
    items, docs = items_and_docs()
    ix = L.Index(items)
    for _, t in docs:
        terms = set(L.words(t or ""))
        score = collections.Counter()
        for x in terms:
            if x in ix.postings:
                for o, s in zip(ix.postings[x][1], ix.postings[x][2]):
                    score[o] += s
        assert sorted(ix.above(terms)) == [o for o in range(len(ix.ids)) if score[o] >= ix.threshold[o]]


def test_hyphens_are_read_one_by_one(spark):
    passage = "the well known parser of charlie keeps a short list of all old lines here"
    it = spark.createDataFrame([(1, passage, "which parser", "old lines")], "item_id long, passage string, question string, answer string")
    texts = [passage.replace("well known", "well-\nknown").replace("charlie", "char-\nlie"), passage.replace("old", "o-\nl-\nd"), passage.replace("charlie", "char-\nles"), "x-\ny " * 5000]
    dd = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.run_words, r.has_answer, r.evidence) for r in L.find(dd, it).collect()}
    assert got == {0: (15, True, "run+answer"), 1: (15, True, "run+answer")}


def test_many_items_are_one_pass():
    """100,000 items make one block, and their index stays small."""
    r = random.Random(4)
    vocab = [f"v{n}" for n in range(20_000)]
    items = [(n, " ".join(r.choices(vocab, k=40)), "q", "a") for n in range(4_000)]
    assert sum(len(p) for _, p, _, _ in items) / 4_000 * 100_000 < L.BLOCK_BYTES
    ix = L.Index(items)
    assert len(pickle.dumps(ix)) < 6 * sum(len(p) for _, p, _, _ in items)
    assert ix.search(items[7][1].split()) == {7: 40}


def test_items_in_blocks(spark, monkeypatch):
    items, docs = items_and_docs()
    it, dd = spark.createDataFrame(items, "item_id long, passage string, question string, answer string"), spark.createDataFrame(docs, "doc_id long, text string")
    whole = {(r.doc_id, r.item_id) for r in L.find(dd, it).collect()}
    monkeypatch.setattr(L, "BLOCK_BYTES", 1500)
    assert {(r.doc_id, r.item_id) for r in L.find(dd, it).collect()} == whole


# -- 10 --------------------------------------------------------------------------------------------
TALK = " The relay kept the old list while the cache was cold. Nobody touched the parser since the upgrade. My guess is that two readers share a lock."
RESIDUE = {
    "Hello {{first_name}}," + TALK: "slot", "Dear ${SUBJECT}," + TALK: "slot", "Regards,\n[Your name here]" + TALK: "slot", "cc: _____ (name)" + TALK: "slot", "on XX/XX/XXXX" + TALK: "slot", "[[zgram_id]]" + TALK: "slot", "<Betreff hier>" + TALK: "slot",
    "Lorem ipsum dolor sit amet consectetur adipiscing elit. Duis aute irure dolor velit.": "filler", "foo " * 20: "filler", "Your text goes here": "filler", "asdf jkl ajskdf lkjasdf asdf": "filler",
    "404 Not Found\nThe page x could not be located on this server.": "error", "Home | Search | Sign in\nSorry! internal server error (code 500)\n© archive 2003": "error", "Access denied.": "error",
    "Please enable JavaScript to view the archive.": "notice", "<noscript>You need to turn on JS in your browser</noscript>": "notice", "Bitte aktivieren Sie JavaScript, um das Archiv anzuzeigen.": "notice", "Lorem ipsum dolor sit amet elit. " * 3000: "filler",
}
CONTENT = ["The script writes `Hello {{first_name}}` and fills it." + TALK, "Set ${HOME} first." + TALK, "```\nsubject: {{x}}\n```\nThat is the template." + TALK, "The relay answered 404 twice, then recovered." + TALK,
           "Readers without JavaScript used to see a notice." + TALK, "The access denied report was a false alarm." + TALK, "Use lorem ipsum as its body." + TALK, "ok", "see [2] and [[lists]]", "", " ", None, LONG]


def test_residue(spark):
    texts = list(RESIDUE) + CONTENT
    df = spark.createDataFrame([(n, t, "r", "p") for n, t in enumerate(texts)], "doc_id long, text string, reason string, path string")
    got = {texts[r.doc_id]: r.reason for r in R.judge(df).collect()}
    assert got == RESIDUE
    assert R.judge(df.limit(0)).count() == 0


def test_codes_of_error_pages(spark):
    texts = [f"{x} {n}{y}" for x in ("HTTP ERROR", "Status code", "Oops, fatal") for n in (400, 419, 500, 501, 510, 511, 519) for y in ("", " was returned")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {texts[r.doc_id] for r in R.judge(df).collect()} == set(texts)


def samples(parsed):
    """Shortest texts of a parsed pattern: one for every choice of alternatives and of members of a small class."""
    out = []
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            out.append([chr(arg)])
        elif op == "IN":
            chars = [c for o, v in arg for c in (chr(v) if str(o) == "LITERAL" else map(chr, range(v[0], v[1] + 1)) if str(o) == "RANGE" else {"CATEGORY_DIGIT": "7", "CATEGORY_WORD": "k", "CATEGORY_SPACE": " "}.get(str(v), ".") if str(o) == "CATEGORY" else "")]
            out.append(["~" if str(arg[0][0]) == "NEGATE" else c for c in (chars if len(chars) < 6 else chars[-1:])])
        elif op in ("ANY", "NOT_LITERAL"):
            out.append(["~"])
        elif op == "BRANCH":
            out.append([x for b in arg[1] for x in samples(b)])
        elif op == "SUBPATTERN":
            out.append(samples(arg[3]))
        elif op == "ATOMIC_GROUP":
            out.append(samples(arg))
        elif op.endswith("REPEAT"):
            out.append([x * arg[0] for x in samples(arg[2])] if arg[0] else ["", " "] if str(arg[2][0][0]) in ("ANY", "IN") else [""])
        elif op == "ASSERT" and arg[0] > 0:
            out.append(samples(arg[1]))
        else:
            assert op in ("AT", "ASSERT", "ASSERT_NOT"), op
    return sorted({"".join(x) for x in itertools.product(*out)})


PATTERNS = [(p, n) for p, n in zip(R.SLOTS, R.SLOT_NEEDS, strict=True)] + [(p, R.needs(p)) for patterns in R.TEMPLATES.values() for p in patterns]


@pytest.mark.parametrize("pattern,needs", PATTERNS)
def test_what_is_looked_for_first_is_in_every_match(pattern, needs):
    p = pattern.replace("\\p{L}", "a-zé").replace("\\p{Lu}", "A-Z")
    found = [x for x in itertools.islice(samples(re._parser.parse(p)), 20_000) if re.search(p, x)]
    assert found
    if needs:
        assert [x for x in found if not any(n in x for n in needs)] == []
    if pattern not in R.SLOTS:
        assert [x for x in found if not (re.search(R.any_need(), x) or any(n in x for n in R.INSIDE))] == []


def test_templates_of_a_leaf(spark):
    """Words that enough records of a leaf share stay, others become wildcards; a leaf of one record is its own template."""
    names = ["ulvo", "brint", "kasto", "mellin", "dorva", "pexa", "rinto", "sulme", "tavik", "woren", "yaldi", "zemor", "arvik", "belto", "corin", "dalmo", "ervin", "falko", "garmo", "hinto", "ilvar", "jusko"]
    df = spark.createDataFrame(list(enumerate(["Reader of old pages"] * 3 + ["nothing found now", "a", "error"])), "doc_id long, text string")
    assert {(r.record, r.template) for r in R.mine(R.records(df, "doc_id", "text")).collect()} == {(x, x) for x in ("nothing found now", "error")}
    df = spark.createDataFrame([(n, f"the old page {x} moved from {x} to archive") for n, x in enumerate(names)] + [(99, "the old page of us was copied twice today")] * 2, "doc_id long, text string")
    got = {r.record: r.template for r in R.mine(R.records(df, "doc_id", "text")).collect()}
    assert set(got.values()) == {"the old page <*> moved from <*> to archive", "the old page of us was copied twice today"}


def test_verdicts_come_by_templates_alone(spark, monkeypatch):
    """Without the tree only slots are found; with it, a document is judged by what its templates say."""
    texts = list(RESIDUE) + CONTENT
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {texts[r.doc_id] for r in R.judge(df).collect()} == set(RESIDUE)
    monkeypatch.setattr(R, "mine", lambda rows: rows.select("record", F.lit(R.ANY).alias("template")).distinct())
    assert {texts[r.doc_id]: r.reason for r in R.judge(df).collect()} == {t: k for t, k in RESIDUE.items() if k == "slot"}


def test_one_verdict_for_all_records_of_a_template(spark):
    """The word that would tell differs between the records, so it is none of the template's."""
    texts = [f"Page {a} list of {b}" for a in ("one", "two") for b in ("readers", "writers")]
    routed = spark.createDataFrame([(t.lower(), "page not found on <*>") for t in texts] + [("ok then", "ok then")], "record string, template string")
    assert {(r.record, r.verdict) for r in R.classified(routed).collect()} == {(t.lower(), "error") for t in texts}
