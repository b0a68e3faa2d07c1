"""Query language: a string becomes a small tree.

Terms, "quoted phrases", AND, OR, NOT (upper case; AND binds tighter), + and -, parentheses; words side by side are joined
by AND (by OR where asked for). Unknown syntax is refused, never ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import regex

from ..functions.text import TOKEN


class QueryError(ValueError):
    """A query that cannot be read or run."""


class UnknownStrategy(QueryError):
    pass


class EnricherError(RuntimeError):
    pass


@dataclass(frozen=True)
class Term:
    text: str


@dataclass(frozen=True)
class Phrase:
    terms: tuple[str, ...]


@dataclass(frozen=True)
class Fuzzy:
    text: str
    distance: int


@dataclass(frozen=True)
class Regex:
    pattern: str


@dataclass(frozen=True)
class OneOf:
    """Any of some terms; counts like a pattern."""

    terms: tuple[str, ...]


@dataclass(frozen=True)
class All:
    pass


@dataclass(frozen=True)
class Nothing:
    pass


@dataclass(frozen=True)
class Boost:
    query: object
    weight: float


@dataclass(frozen=True)
class Bool:
    must: tuple = ()
    should: tuple = ()
    must_not: tuple = ()


#: Edits of a fuzzy query at most.
MAX_EDITS = 2
_token = regex.compile(TOKEN)


def words(text: str) -> list[str]:
    """Tokens of a query text, as the index has them."""
    return [w.lower() for w in _token.findall(text)]


def leaf(text: str, quoted: bool = True) -> object:
    """A term, a phrase of several tokens, or nothing."""
    found = words(text)
    if not found:
        return Nothing()
    return Term(found[0]) if len(found) == 1 else Phrase(tuple(found))


_lexer = re.compile(r'\s+|"([^"]*)"?|([()])|([+-])(?=[^\s)])|([^\s()"]+)')
_refused = re.compile(r"[*?~^\[\]{}]|\w:\S")


def _lex(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _lexer.match(text, at)
        if not m:
            raise QueryError(f"cannot read the query at {text[at:]!r}")
        at = m.end()
        if m[1] is not None:
            out.append(("phrase", m[1]))
        elif m[2]:
            out.append((m[2], m[2]))
        elif m[3]:
            out.append(("sign", m[3]))
        elif m[4]:
            if m[4] in ("AND", "OR", "NOT"):
                out.append((m[4], m[4]))
            elif _refused.search(m[4]):
                raise QueryError(f"not supported in a query: {m[4]!r}")
            else:
                out.append(("word", m[4]))
    return out


class _Parser:
    def __init__(self, text: str, conjunction: bool):
        self.items, self.at, self.conjunction = _lex(text), 0, conjunction

    def kind(self) -> str | None:
        return self.items[self.at][0] if self.at < len(self.items) else None

    def take(self) -> tuple[str, str]:
        if self.at >= len(self.items):
            raise QueryError("the query ends too early")
        self.at += 1
        return self.items[self.at - 1]

    def whole(self) -> object:
        out = self.either()
        if self.kind():
            raise QueryError(f"unexpected {self.items[self.at][1]!r}")
        return out

    def either(self) -> object:
        """Alternatives joined by OR."""
        sides = [self.both()]
        while self.kind() == "OR":
            self.take()
            sides.append(self.both())
        return sides[0] if len(sides) == 1 else Bool(should=tuple(sides))

    def both(self) -> object:
        """Clauses side by side or joined by AND; each has a sign of its own."""
        must, plain, never, joined = [], [], [], False
        while True:
            sign = None
            if self.kind() == "NOT":
                self.take()
                sign = "-"
            elif self.kind() == "sign":
                sign = self.take()[1]
            clause = self.one()
            (never if sign == "-" else must if sign == "+" else plain).append(clause)
            if self.kind() == "AND":
                self.take()
                joined = True
            elif self.kind() not in ("word", "phrase", "(", "sign", "NOT"):
                break
        if self.conjunction or joined:
            must, plain = must + plain, []
        if len(must) + len(plain) == 1 and not never:
            return (must + plain)[0]
        return Bool(tuple(must), tuple(plain), tuple(never))

    def one(self) -> object:
        kind, text = self.take()
        if kind == "(":
            out = self.either()
            if self.kind() != ")":
                raise QueryError("a parenthesis is not closed")
            self.take()
            return out
        if kind in ("word", "phrase"):
            return leaf(text)
        raise QueryError(f"unexpected {text!r}")


def parse(text: str, conjunction: bool = True) -> object:
    """The tree of a query string."""
    return _Parser(text, conjunction).whole()


def _checked(text: str) -> str:
    text = text.strip()
    if text in ("+", "-"):
        raise QueryError("a query cannot be a sign alone")
    return text


def auto_phrase(text: str) -> object:
    """Several words without quotes are one phrase."""
    text = _checked(text)
    if not text:
        return Nothing()
    return leaf(text) if " " in text and '"' not in text else parse(text)


def has_operators(text: str) -> bool:
    return any(c in text for c in '"()+-') or any(w.upper() in ("AND", "OR", "NOT") for w in text.split())


def boolean_phrase(text: str) -> object:
    """Several words without quotes, signs or operators are one phrase; anything else is read as written."""
    text = _checked(text)
    if not text:
        return Nothing()
    return leaf(text) if " " in text and not has_operators(text) else parse(text)


STRATEGIES = {"auto_phrase": auto_phrase, "boolean_phrase": boolean_phrase}


def structured(clauses: list[tuple[str, str]]) -> object:
    """Clauses as (text, must | should | must_not); a clause that cannot be read is left out."""
    sides: dict[str, list] = {"must": [], "should": [], "must_not": []}
    for text, occur in clauses:
        if occur not in sides:
            raise QueryError(f"unknown clause kind {occur!r}")
        try:
            q = auto_phrase(text)
        except QueryError:
            continue
        if q != Nothing():
            sides[occur].append(q)
    return Bool(**{k: tuple(v) for k, v in sides.items()}) if any(sides.values()) else Nothing()


def structured_json(items: list[dict]) -> object:
    """The same from [{"term", "occur"}]; occur is must if left out."""
    for x in items:
        if not isinstance(x.get("term"), str) or not x["term"].strip():
            raise QueryError("a clause needs a term")
    return structured([(x["term"], x.get("occur", "must")) for x in items])


def fuzzy(text: str, distance: int) -> object:
    """Any token within so many edits (two at most); tokens are lower-cased."""
    if distance <= 0:
        return auto_phrase(text)
    if distance > MAX_EDITS:
        raise QueryError(f"a fuzzy query allows {MAX_EDITS} edits at most")
    found = tuple(Fuzzy(w.lower(), distance) for w in text.split())
    return Bool(should=found) if found else Nothing()


def by_kind(kind: str, text: str) -> object:
    """Queries of the viewer: standard (words joined by OR), fuzzy (one edit), regex on terms, phrase (empty: everything)."""
    if kind == "standard":
        return parse(text, conjunction=False) if text.strip() else Nothing()
    if kind == "fuzzy":
        return fuzzy(text, 1)
    if kind == "regex":
        return Regex(text)
    if kind == "phrase":
        return leaf(text) if words(text) else All()
    raise UnknownStrategy(kind)


def positive(query: object) -> bool:
    """False for a query that only excludes."""
    if isinstance(query, Bool):
        return any(positive(q) for q in query.must + query.should)
    return True


def leaves(query: object, weight: float = 1.0, out: list | None = None) -> list[tuple[object, float]]:
    """Leaves that score, with their weights; what is excluded does not score."""
    out = [] if out is None else out
    if isinstance(query, Bool):
        for q in query.must + query.should:
            leaves(q, weight, out)
    elif isinstance(query, Boost):
        leaves(query.query, weight * query.weight, out)
    elif not isinstance(query, (All, Nothing)):
        out.append((query, weight))
    return out


def all_leaves(query: object) -> list[object]:
    if isinstance(query, Bool):
        return [x for q in query.must + query.should + query.must_not for x in all_leaves(q)]
    if isinstance(query, Boost):
        return all_leaves(query.query)
    return [] if isinstance(query, (All, Nothing)) else [query]


def split_quoted(text: str) -> list[tuple[str, bool]]:
    """Pieces of a query and whether each was quoted; empty quotes go, an open quote runs to the end."""
    out = []
    for i, piece in enumerate(text.split('"')):
        if i % 2:
            out += [(piece.strip(), True)] if piece.strip() else []
        else:
            out += [(w, False) for w in piece.split()]
    return out


def auto_phrase_groups(text: str) -> tuple[list[list[str]], list[str]]:
    """Highlight groups: one for each quoted phrase, one for the words that stand together."""
    groups: list[list[str]] = []
    loose: list[str] = []
    for piece, quoted in split_quoted(text):
        if quoted:
            groups.append(piece.lower().split())
        else:
            loose.append(piece.lower())
    groups = ([loose] if loose else []) + groups
    return groups, list(dict.fromkeys(w for g in groups for w in g))


#: Fixed value: punctuation trimmed from the words of a boolean query (an apostrophe stays).
_TRIM = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def boolean_phrase_groups(text: str) -> tuple[list[list[str]], list[str]]:
    """Highlight groups of a boolean query: each word by itself, each quoted phrase together."""
    if " " in text.strip() and not has_operators(text):
        return auto_phrase_groups(text)
    groups = []
    for piece, quoted in split_quoted(text.replace("(", " ").replace(")", " ")):
        if not quoted and piece.lower() in ("and", "or", "not"):
            continue
        own = [w.strip(_TRIM).lower() for w in piece.split()]
        own = [w for w in own if w]
        if own:
            groups.append(own)
    if not groups and text.strip():
        return auto_phrase_groups(text)
    return groups, list(dict.fromkeys(w for g in groups for w in g))
