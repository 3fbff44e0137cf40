"""Evaluation texts in a training corpus: BM25 inverted index with block-max WAND, then exact runs.

The index holds the evaluation items. Every document is cut into overlapping passages of words, and
each passage is a query that must get back every item it may hold a run of. The score of a passage
and an item is the sum of BM25 impacts of the item's terms in it; an item's threshold is the least
such sum over all runs of ``min_run`` words of its own text, so no run can score below it. The
retrieval prunes by the upper bounds of terms and of posting blocks. Retrieved pairs are verified by
the longest run of words that document and item share, and each leak says what else bears it out:
the share of the question's words and whether the answer stands in the document (``evidence``).

Passages are cut from stretches of indexed words: a word that no item has ends any run.

Words are runs of letters and digits after NFKC, lower-casing, and removal of tags, character
references, link targets and invisible characters. Where a hyphen breaks a word at a line end, each
such place by itself may be one word or two: a passage asks for both, and a run may take either.

Defined cases: null, empty and blank texts hold nothing; items with fewer than ``min_run`` words
can't leak; repeated documents and items are judged one by one; very long texts are walked passage
by passage; empty tables give no rows.

Scale: documents are one narrow pass without a shuffle. The index is flat arrays, about three times
the items' text; items of at most ``BLOCK_BYTES`` of text are one pass and one broadcast (over 100,000
items of usual length), and only more text than that takes another pass.
"""

from __future__ import annotations

import functools
import html
import math
import re
import unicodedata
from array import array
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_RUN = 13
PASSAGE = 2 * MIN_RUN
BLOCK_BYTES = 64 << 20
POSTING_BLOCK = 16
K1, B = 1.2, 0.75
QUESTION_SHARE = 0.8
_INLINE = re.compile(r"</?(?:a|abbr|b|big|code|del|em|font|i|ins|kbd|mark|q|s|small|span|strike|strong|sub|sup|tt|u|wbr)(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"<[/!]?[a-zA-Z][^<>]*>|<!--.*?-->", re.S)
_TARGET = re.compile(r"\]\([^()\s]*\)")
JOINT = "\ue000"  # stands for a hyphen at a line end; a text's own is dropped
_WORD = re.compile(rf"[^\W_]+(?:{JOINT}[^\W_]+)*")
_BROKEN = re.compile(r"(?<=\w)-[ \t]*\r?\n[ \t>]*(?=\w)")


@functools.lru_cache(maxsize=1 << 16)
def _unseen(c: str) -> bool:
    """Whether a character is invisible or a combining mark that is no letter."""
    return unicodedata.category(c) in ("Cf", "Mn") and not c.isalnum()


def units(text: str) -> list[str]:
    """Words of a text; one broken at a line end holds ``JOINT`` at that place."""
    if JOINT in text:
        text = text.replace(JOINT, "")
    if "-" in text:
        text = _BROKEN.sub(JOINT, text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "&" in text:
        text = html.unescape(text)
    if "](" in text:
        text = _TARGET.sub("] ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        for c in set(text):
            if c > "\x7f" and _unseen(c):
                text = text.replace(c, "")
    text = text.lower()
    if "'" in text or "’" in text:
        text = text.replace("'", "").replace("’", "")
    return _WORD.findall(text)


def words(text: str) -> list[str]:
    """Words of a text; a word broken at a line end is two."""
    return [w for u in units(text) for w in u.split(JOINT)]


def readings(unit: str) -> set[str]:
    """All words that a unit may hold: any of its neighbouring parts together."""
    parts = unit.split(JOINT)
    return {"".join(parts[i:j]) for i in range(len(parts)) for j in range(i + 1, len(parts) + 1)}


def longest_run(document: list[str], at: dict[str, list[int]]) -> int:
    """Words of the longest run that the units of a document share with an item; ``at``: word -> its places in the item."""
    best = 0
    open_runs: dict[int, int] = {}  # next place in the item -> words so far
    for u in document:
        if JOINT not in u:
            places = at.get(u)
            if not places:
                open_runs = {}
                continue
            open_runs = {p + 1: open_runs.get(p, 0) + 1 for p in places}
            best = max(best, *open_runs.values())
            continue
        parts = u.split(JOINT)
        states: list[dict[int, int]] = [open_runs, *({} for _ in parts)]
        for i in range(len(parts)):
            for j in range(i + 1, len(parts) + 1):
                for place in at.get("".join(parts[i:j]), ()):
                    n = states[i].get(place, 0) + 1
                    if n > states[j].get(place + 1, 0):
                        states[j][place + 1] = n
                        best = max(best, n)
        open_runs = states[-1]
    return best


def _ordinal(cursor: list) -> int:
    return cursor[0]


class Index:
    """Postings of a block of items in flat arrays, with the upper bounds of terms and posting blocks."""

    def __init__(self, items: list[tuple[int, str, str, str]], min_run: int = MIN_RUN):
        self.min_run = min_run
        self.asked: dict[int, dict[str, list[int]]] = {}
        self.ids, self.texts = array("q"), []
        self.question, self.answer = [], []
        for item_id, passage, question, answer in items:
            w = words(passage or "")
            if len(w) >= min_run:
                self.ids.append(item_id)
                self.texts.append(" ".join(w))
                self.question.append(" ".join(words(question or "")))
                self.answer.append(" ".join(words(answer or "")))
        n = len(self.texts)
        mean = sum(t.count(" ") + 1 for t in self.texts) / n if n else 1
        df = Counter(x for t in self.texts for x in set(t.split()))
        postings: dict[str, tuple[array, array]] = defaultdict(lambda: (array("l"), array("d")))
        self.threshold = array("d")
        for o, t in enumerate(self.texts):
            w = t.split()
            impact = {x: math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(w) / mean))
                      for x, f in Counter(w).items()}
            for x, v in impact.items():
                postings[x][0].append(o)
                postings[x][1].append(v)
            starts = range(len(w) - min_run + 1)
            self.threshold.append(min(sum(impact[x] for x in set(w[i : i + min_run])) for i in starts) - 1e-9)
        self.least = min(self.threshold, default=math.inf)
        # term -> (most, ordinals, impacts, the last ordinal and the most of each block)
        self.postings = {}
        for x, (o, v) in postings.items():
            cuts = range(0, len(o), POSTING_BLOCK)
            last = array("l", [o[min(k + POSTING_BLOCK, len(o)) - 1] for k in cuts])
            self.postings[x] = (max(v), o, v, last, array("d", [max(v[k : k + POSTING_BLOCK]) for k in cuts]))

    def above(self, terms: set[str]) -> list[int]:
        """Ordinals of all items whose score reaches their threshold, by block-max WAND."""
        lists = [p for t in terms if (p := self.postings.get(t))]
        if sum([p[0] for p in lists]) < self.least:
            return []
        # cursor: ordinal, position, list, number of the block that may hold the pivot, its last ordinal, its most
        cursors = [[p[1][0], 0, p, 0, p[3][0], p[4][0]] for p in lists]
        end, out = len(self.ids), []
        least = self.least
        while cursors:
            cursors.sort(key=_ordinal)
            total, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                total += c[2][0]
                if total >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            o = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == o:
                pivot += 1
            # upper bound by the blocks that may hold the pivot
            bound, nearest = 0.0, end
            for c in cursors[: pivot + 1]:
                if c[4] < o:
                    last, k = c[2][3], c[3] + 1
                    while k < len(last) and last[k] < o:
                        k += 1
                    if k == len(last):
                        c[3], c[4], c[5] = k, end, 0.0
                    else:
                        c[3], c[4], c[5] = k, last[k], c[2][4][k]
                bound += c[5]
                if c[4] < nearest:
                    nearest = c[4]
            if bound < least:
                # no item up to the nearest block end can reach it
                to = nearest + 1
                if pivot + 1 < len(cursors):
                    to = min(to, cursors[pivot + 1][0])
                self._advance(cursors[: pivot + 1], max(to, o + 1), end)
            else:
                self._advance(cursors[: pivot + 1], o, end)
                here = [c for c in cursors if c[0] == o]
                if sum([c[2][2][c[1]] for c in here]) >= self.threshold[o]:
                    out.append(o)
                self._advance(here, o + 1, end)
            cursors = [c for c in cursors if c[0] < end]
        return out

    @staticmethod
    def _advance(cursors: list, o: int, end: int) -> None:
        """Move cursors to the first ordinal from ``o`` on."""
        for c in cursors:
            if c[0] < o:
                ordinals = c[2][1]
                i = c[1] + 1
                if i < len(ordinals) and ordinals[i] < o:
                    i = bisect_left(ordinals, o, i)
                c[1] = i
                c[0] = ordinals[i] if i < len(ordinals) else end

    def stretches(self, w: list[str]) -> Iterator[tuple[int, int]]:
        """Maximal stretches of units with indexed words that are long enough; no run goes beyond one.

        A run has a word at least of each unit, so it spans at most ``min_run`` units if it is as short as that.
        A unit of several words may make a stretch of fewer units long enough.
        """
        known = self.postings.__contains__
        flags = bytes(map(known, w))
        joints = [i for i, u in enumerate(w) if JOINT in u] if JOINT in "".join(w) else []
        if joints:
            flags = bytearray(flags)
            for i in joints:
                flags[i] = any(map(known, readings(w[i])))
        extra = sum(w[i].count(JOINT) for i in joints)
        for m in re.finditer(rb"\x01{%d,}" % max(1, self.min_run - extra), bytes(flags)):
            yield m.start(), m.end()

    def search(self, w: list[str]) -> dict[int, int]:
        """Ordinal -> longest run of words shared with the item."""
        found: dict[int, int] = {}
        n, step = self.min_run, PASSAGE - self.min_run + 1
        for begin, end in self.stretches(w):
            held: set[int] = set()
            for at in range(begin, max(begin + 1, end - n + 1), step):
                part = w[at : min(at + PASSAGE, end)]
                bag = {x for u in part for x in (readings(u) if JOINT in u else (u,))}
                held.update(o for o in self.above(bag) if o not in held and longest_run(part, self.places(o)) >= n)
            for o in held:
                found[o] = max(found.get(o, 0), longest_run(w[begin:end], self.places(o)))
        return found

    def places(self, o: int) -> dict[str, list[int]]:
        """Word -> its places in an item; kept for the items that were asked for."""
        got = self.asked.get(o)
        if got is None:
            got = self.asked[o] = defaultdict(list)
            for i, x in enumerate(self.texts[o].split()):
                got[x].append(i)
        return got


def find(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", min_run: int = MIN_RUN) -> DataFrame:
    """(doc_id, item_id, run_words, question_share, has_answer, evidence) of every leak.

    ``evidence``: ``run``, or with ``+question`` (at least ``QUESTION_SHARE`` of its words) and ``+answer``.
    """
    spark = documents.sparkSession
    schema = "doc_id long, item_id long, run_words int, question_share double, has_answer boolean, evidence string"
    docs = documents.filter(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long"), F.col(text))
    rows = items.select("item_id", "passage", "question", "answer").filter("item_id is not null and passage is not null")
    size = rows.agg(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in ("passage", "question", "answer")), F.lit(0)))).first()[0] or 0
    n_blocks = max(1, -(-size // BLOCK_BYTES))
    out = None
    for k in range(n_blocks):
        block = rows if n_blocks == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "passage"), F.lit(n_blocks)) == k)
        index = spark.sparkContext.broadcast(Index([tuple(r) for r in block.toLocalIterator()], min_run))

        def run(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            ix = index.value
            for b in batches:
                got = []
                for doc, body in zip(b.iloc[:, 0], b.iloc[:, 1]):
                    w = units(body)
                    for o, length in ix.search(w).items():
                        have = [x for u in w for x in u.split(JOINT)]
                        bag, q, a = set(have).union(*map(readings, w)), set(ix.question[o].split()), ix.answer[o]
                        share = len(q & bag) / len(q) if q else 0.0
                        inside = bool(a) and (f" {a} " in f" {' '.join(have)} " or f" {a} " in f" {' '.join(w).replace(JOINT, '')} ")
                        evidence = "run" + "+question" * (share >= QUESTION_SHARE) + "+answer" * inside
                        got.append((doc, ix.ids[o], length, share, inside, evidence))
                yield pd.DataFrame(got, columns=["doc_id", "item_id", "run_words", "question_share", "has_answer", "evidence"])

        part = docs.mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    return out
