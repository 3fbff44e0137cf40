import random
import re

import pytest
from pyspark.sql import functions as F

from chatlore.functions import text as T
from chatlore.operators.index import Index, with_tokens
from chatlore.plans import nodes as P
from chatlore.plans import postings_plan, row_plan
from chatlore.plans.parser import QuerySyntaxError, by_instance, by_reaction, by_sender, check_syntax, from_url, parse

D = "instance|body"
GOLDEN = {
    "tea cup": f"And([Adapt(Pattern({D}, tea)), Adapt(Pattern({D}, cup))])",
    "tea cup pot": f"And([Adapt(Pattern({D}, tea)), Adapt(Pattern({D}, cup)), Adapt(Pattern({D}, pot))])",
    "sender:ann instance:ops signature:sea": "And([Adapt(Pattern(sender, ann)), Adapt(Pattern(instance, ops)), Adapt(Pattern(signature, sea))])",
    "don't": f"Adapt(Pattern({D}, don't))", "'tea": f"Near(1, [Pattern({D}, '), Pattern({D}, tea)])",
    "tea'": f"Near(1, [Pattern({D}, tea), Pattern({D}, ')])", '""': f"PopOrNot(pop=(none), unpop={D})", "~~": f"PopOrNot(pop=(none), unpop={D})",
    '"tea"': f"Adapt(Pattern({D}, tea))", '"tea cup"': f"Near(1, [Pattern({D}, tea), Pattern({D}, cup)])", "~tea cup~": f"Near(3, [Pattern({D}, tea), Pattern({D}, cup)])",
    'body:"tea cup"': "Near(1, [Pattern(body, tea), Pattern(body, cup)])", '"sender:tea"': f"Near(1, [Pattern({D}, sender), Pattern({D}, :), Pattern({D}, tea)])",
    '"tea)$"': f"Near(1, [Pattern({D}, tea), Pattern({D}, )), Pattern({D}, $)])", 'signature:""': "PopOrNot(pop=(none), unpop=signature)",
    "a or b and c d": f"Or([Adapt(Pattern({D}, a)), And([Adapt(Pattern({D}, b)), Adapt(Pattern({D}, c)), Adapt(Pattern({D}, d))])])",
    "not not a": f"Adapt(Pattern({D}, a))", "not a b": f"And([Not(Adapt(Pattern({D}, a))), Adapt(Pattern({D}, b))])", "android": f"Adapt(Pattern({D}, android))",
    "a and (b or c)": f"And([Adapt(Pattern({D}, a)), Or([Adapt(Pattern({D}, b)), Adapt(Pattern({D}, c))])])",
    "instance:^*$": "Adapt(Anchored(^$, AnyWord(instance)))", "*": "PopOrNot(pop=instance|body, unpop=(none))", "sender, body: ^x": "Adapt(Anchored(^, Pattern(sender|body, x)))",
    'zgramid( 5 ) hasreaction( "a\\"b" )': 'And([ZgramId(5), HavingReaction(a"b)])', 'literally("a-b")': f"Near(1, [Pattern({D}, a), Pattern({D}, -), Pattern({D}, b)])",
}


@pytest.mark.parametrize("query", GOLDEN)
def test_plans(query):
    assert str(parse(query)) == GOLDEN[query]


@pytest.mark.parametrize("query", ['tea"', '"tea', "tea~", "~tea", "(a", "a)", "and", "a or", "not", "zgramid(x)", "hasreaction(x)", "a ^"])
def test_errors_have_a_position(query):
    with pytest.raises(QuerySyntaxError) as e:
        parse(query)
    assert 0 <= e.value.position <= len(query)
    assert check_syntax(query)[0] is False


def test_empty_and_rewrites():
    assert parse("") == P.TRUE and parse(" ", False) == P.FALSE
    a = parse("a")
    assert P.conjunction([a, P.TRUE]) == a and P.conjunction([a, P.FALSE]) == P.FALSE
    assert P.disjunction([a, P.FALSE]) == a and P.disjunction([a, P.TRUE]) == P.TRUE and P.negate(P.TRUE) == P.FALSE
    assert P.near(1, []) == P.TRUE and str(parse(by_instance('a "b"'))) == "Near(1, [Anchored(^, Pattern(instance, a)), Pattern(instance, \"), Pattern(instance, b), Pattern(instance, \")])"
    assert parse(by_reaction('"\\')) == P.HavingReaction('"\\')


SPLITS = {"tea++": ["tea", "+", "+"], "I don't know": ["I", "don't", "know"], 'a "b", c': ["a", '"', "b", '"', ",", "c"], "I 🙀Cιηη🔥 !": ["I", "🙀Cιηη🔥", "!"],
          "a''b c' 'd": ["a''b", "c", "'", "'", "d"], "\x07\t": [], "": []}


def test_word_split(spark):
    df = spark.createDataFrame([(k,) for k in SPLITS] + [(None,)], "t string").select("t", T.tokens(F.col("t")).alias("w"))
    assert {r.t: r.w for r in df.collect()} == SPLITS | {None: []}
    assert all(T.split_words(k) == v for k, v in SPLITS.items())


WORDS = ["button", "Button", "butto", "but-ton", "bυttσn", "but🔥ton", "🙀button🙀", "xbuttonx", "BUTTON", "", "b", "ⓒ", "⒞", "c", "𝚋𝚞𝚝𝚝𝚘𝚗"]
MATCH = {
    "button": {"button", "Button", "BUTTON", "bυttσn", "𝚋𝚞𝚝𝚝𝚘𝚗"}, "Button": {"Button"}, r"\button": {"button"}, "but?ton": {"but-ton", "but🔥ton"},
    "*button*": {"button", "Button", "BUTTON", "bυttσn", "🙀button🙀", "xbuttonx", "𝚋𝚞𝚝𝚝𝚘𝚗"}, "?": {"b", "c", "ⓒ", "⒞"}, "c": {"c", "ⓒ", "⒞"}, "but*ton": {"button", "Button", "BUTTON", "bυttσn", "but-ton", "but🔥ton", "𝚋𝚞𝚝𝚝𝚘𝚗"},
    "***": set(WORDS), "butto": {"butto"},
}


def test_globs(spark):
    df = spark.createDataFrame([(w,) for w in WORDS], "w string")
    for glob, want in MATCH.items():
        assert {r.w for r in df.filter(F.col("w").rlike(T.glob_regex(glob))).collect()} == want, glob
    assert T.accepts_everything("**") and not T.accepts_everything("?*") and not T.accepts_everything("")


def test_karma(spark):
    texts = {"tea++ and tea-- tea++": [("tea", 1), ("tea", -1), ("tea", 1)], "C++ c-- x~~ y??": [("x", 0), ("y", 0)], "3tea++": [("tea", 1)], "a+b++": [("b", 1)], "né++": [("né", 1)],
             "k" * 257 + "++": [], "+++": [], "a_1--x": [("a_1", -1)]}
    df = spark.createDataFrame([(k,) for k in texts], "t string").select("t", T.karma(F.col("t")).alias("k"))
    assert {r.t: [tuple(p) for p in r.k] for r in df.collect()} == texts


def small_archive(spark):
    r = random.Random(5)
    words = ["the", "The", "cup", "pot", "tea", "C", "+", "don't", "🙀", "bυt"]
    rows = [(n, r.choice(["ann", "bob"]), r.choice([None, "", "by the sea"]), r.choice(["ops", "ops.the", None]), r.choice([None, "  ", " ".join(r.choice(words) for _ in range(r.randint(1, 9)))]))
            for n in range(300)]
    return spark.createDataFrame(rows, "zgram_id long, sender string, signature string, instance string, body string")


QUERIES = ["the", '"the cup"', "~the tea~", "~the cup pot~", "the and not cup", "the or cup pot", 'body:""', "body:^the", "body:tea$", "instance:^ops$", '"the the"', "not (the or tea)", "C+", "signature:*",
           "instance,signature:the", "b?t", "body:^cup$", 'body:^"the cup"$', "zgramid(7) or the", 'hasreaction("up") tea', "don't"]


def brute(plan, row, reacted):
    """Independent evaluation of a plan on one row."""
    tok = {f: T.split_words(row[f] or "") for f in P.FIELDS}

    def hits(w, f):
        core, left, right = (w.child, w.left, w.right) if isinstance(w, P.Anchored) else (w, False, False)
        t = tok[f] if f in core.mask else []
        pat = None if isinstance(core, P.AnyWord) else re.compile(pythonic(T.glob_regex(core.glob)))
        return [i for i, x in enumerate(t) if (pat is None or pat.search(x)) and (not left or i == 0) and (not right or i == len(t) - 1)]
    if isinstance(plan, P.And):
        return all(brute(c, row, reacted) for c in plan.children)
    if isinstance(plan, P.Or):
        return any(brute(c, row, reacted) for c in plan.children)
    if isinstance(plan, P.Not):
        return not brute(plan.child, row, reacted)
    if isinstance(plan, P.PopOrNot):
        return plan == P.TRUE or any(tok[f] for f in plan.pop) or any(not tok[f] for f in plan.unpop)
    if isinstance(plan, P.ZgramId):
        return row["zgram_id"] == plan.zgram_id
    if isinstance(plan, P.HavingReaction):
        return row["zgram_id"] in reacted
    if isinstance(plan, P.Adapt):
        return any(hits(plan.word, f) for f in P.FIELDS)
    for f in P.FIELDS:
        reach = set(hits(plan.words[0], f))
        for w in plan.words[1:]:
            reach = {i for i in hits(w, f) if any(1 <= i - q <= plan.margin for q in reach)}
        if reach:
            return True
    return False


def pythonic(regex):
    return re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: re.escape(chr(int(m.group(1), 16))), regex).replace(r"\z", r"\Z")


def test_both_plans_equal_brute_force(spark):
    rows = small_archive(spark).cache()
    reactions = spark.createDataFrame([("up", 3, 2), ("up", 5, 0), ("up", 7, 1), ("down", 9, 1)] + [("up", n, 1) for n in range(20, 200, 3)], "reaction string, zgram_id long, n long")
    reacted = {3, 7, *range(20, 200, 3)}
    local = [r.asDict() for r in rows.collect()]
    ix = Index.of(rows, reactions)
    docs = with_tokens(rows)
    for q in QUERIES:
        plan = parse(q)
        want = {r["zgram_id"] for r in local if brute(plan, r, reacted)}
        assert {r.zgram_id for r in row_plan.search(plan, docs, reactions).collect()} == want, q
        assert {r.zgram_id for r in postings_plan.search(plan, ix).collect()} == want, q


def test_links():
    base = "https://archive.example/?"
    assert from_url(base) == ("", "end", None)
    assert from_url(base + "id=68&q=tea") == ("zgramid(68)", "end", None)
    assert from_url(base + "id=x&s=ann&soid=12") == (by_sender("ann"), "zgram", 12)
    assert from_url(base + "q=tea+cup&i=help.relay&sots=983000000&zz=1") == (by_instance("help.relay"), "timestamp", 983000000)
    assert from_url(base + "q=a%20or%20b&soid=5&sots=7&soid=") == ("a or b", "timestamp", 7)


# Letters that a loosely written word must match, by hand, and some that it must not.
LOOSE = {"a": "ά व ﾑ ⓐ à Ⱥ", "c": "ɔ Ҁ Ↄ ς ć", "f": "Ŧ ɟ ꟻ ḟ", "g": "ƃ ǵ", "j": "ɾ ј", "o": "ē ૅ ø ة", "p": "ᴩ ꟼ ρ", "s": "ꙅ Ꙅ ѕ", "u": "ᵾ ц ü", "e": "⋶ 已 ǝ", "x": "Ж χ", "z": "乙 Ƶ"}
NOT_LOOSE = {"a": "в b ß", "c": "k с̀x", "f": "t", "o": "0 q", "z": "s 2"}


def test_look_alikes(spark):
    for letters, wanted in ((LOOSE, True), (NOT_LOOSE, False)):
        for letter, forms in letters.items():
            df = spark.createDataFrame([(f,) for f in forms.split()], "w string")
            assert {r[0] for r in df.select(T.glob_match(F.col("w"), letter)).collect()} == {wanted}, letter


def test_proximity_is_linear(spark):
    """The last place is enough: a later start never does worse."""
    docs = with_tokens(spark.createDataFrame([(1, "", "", "", "a x x x a x b"), (2, "", "", "", "a x x x b"), (3, "", "", "", "b a"), (4, "", "", "", "a " * 60_000 + "b c"), (5, "", "", "", "a a b a x c")],
                                             "zgram_id long, sender string, signature string, instance string, body string"))
    assert {r.zgram_id for r in row_plan.search(parse("~a b~"), docs).collect()} == {1, 4, 5}
    assert {r.zgram_id for r in row_plan.search(parse("~a b c~"), docs).collect()} == {4, 5}
