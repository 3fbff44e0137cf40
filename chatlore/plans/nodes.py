"""Query plan nodes. The constructors below rewrite as they build; nothing here knows Spark."""

from __future__ import annotations

from dataclasses import dataclass

from chatlore.functions.text import accepts_everything

FIELDS = ("sender", "signature", "instance", "body")
DEFAULT_FIELDS = frozenset({"instance", "body"})


def show_fields(mask: frozenset[str]) -> str:
    return "|".join(f for f in FIELDS if f in mask) or "(none)"


@dataclass(frozen=True)
class Pattern:
    mask: frozenset[str]
    glob: str

    def __str__(self):
        return f"Pattern({show_fields(self.mask)}, {self.glob})"


@dataclass(frozen=True)
class AnyWord:
    mask: frozenset[str]

    def __str__(self):
        return f"AnyWord({show_fields(self.mask)})"


@dataclass(frozen=True)
class Anchored:
    child: object
    left: bool
    right: bool

    def __str__(self):
        return f"Anchored({'^' * self.left}{'$' * self.right}, {self.child})"


@dataclass(frozen=True)
class Adapt:
    word: object

    def __str__(self):
        return f"Adapt({self.word})"


@dataclass(frozen=True)
class Near:
    margin: int
    words: tuple

    def __str__(self):
        return f"Near({self.margin}, [{', '.join(map(str, self.words))}])"


@dataclass(frozen=True)
class PopOrNot:
    """Some field of ``pop`` has words, or some field of ``unpop`` has none."""

    pop: frozenset[str]
    unpop: frozenset[str]

    def __str__(self):
        return f"PopOrNot(pop={show_fields(self.pop)}, unpop={show_fields(self.unpop)})"


@dataclass(frozen=True)
class And:
    children: tuple

    def __str__(self):
        return f"And([{', '.join(map(str, self.children))}])"


@dataclass(frozen=True)
class Or:
    children: tuple

    def __str__(self):
        return f"Or([{', '.join(map(str, self.children))}])"


@dataclass(frozen=True)
class Not:
    child: object

    def __str__(self):
        return f"Not({self.child})"


@dataclass(frozen=True)
class ZgramId:
    zgram_id: int

    def __str__(self):
        return f"ZgramId({self.zgram_id})"


@dataclass(frozen=True)
class HavingReaction:
    reaction: str

    def __str__(self):
        return f"HavingReaction({self.reaction})"


ALL = frozenset(FIELDS)
TRUE = PopOrNot(ALL, ALL)
FALSE = PopOrNot(frozenset(), frozenset())


def pattern(mask: frozenset[str], glob: str):
    return AnyWord(mask) if accepts_everything(glob) else Pattern(mask, glob)


def anchored(child, left: bool, right: bool):
    if isinstance(child, Anchored):
        return anchored(child.child, left or child.left, right or child.right)
    return Anchored(child, left, right) if left or right else child


def adapt(word):
    return PopOrNot(word.mask, frozenset()) if isinstance(word, AnyWord) else Adapt(word)


def near(margin: int, words: list):
    if not words:
        return TRUE
    return adapt(words[0]) if len(words) == 1 else Near(margin, tuple(words))


def negate(child):
    if isinstance(child, Not):
        return child.child
    return FALSE if child == TRUE else TRUE if child == FALSE else Not(child)


def _combine(kind, neutral, absorbing, children: list):
    flat = []
    for c in children:
        if c == absorbing:
            return absorbing
        if c != neutral:
            flat += c.children if isinstance(c, kind) else [c]
    return neutral if not flat else flat[0] if len(flat) == 1 else kind(tuple(flat))


def conjunction(children: list):
    return _combine(And, TRUE, FALSE, children)


def disjunction(children: list):
    return _combine(Or, FALSE, TRUE, children)
