"""The short query language: +must -must_not should, field:text, "phrases", /re/, wild*, fuzzy~1, boost^2, ranges."""

from __future__ import annotations

import re

from searchlake.plans.query import Query, QueryError, boolean, conjunction, disjunction

_ESCAPED = "+-=&|><!(){}[]^\"~*?:\\/ "
_NUMBER = re.compile(r"-?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")


class _Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def space(self) -> None:
        while self.peek() and self.peek().isspace():
            self.at += 1

    def quoted(self, mark: str) -> str:
        self.at += 1
        out = ""
        while True:
            c = self.peek()
            if not c:
                raise QueryError(f"unterminated {'quote' if mark == chr(34) else 'pattern'}")
            self.at += 1
            if c == mark:
                return out
            if c == "\\" and self.peek() and (self.peek() == mark or mark == '"' and self.peek() in _ESCAPED):
                c = self.peek()
                self.at += 1
            out += c

    def word(self) -> tuple[str, bool, bool]:
        """A bare string: its text, whether it holds a free wildcard, whether it ends at a colon."""
        out, wild = "", False
        while c := self.peek():
            if c == "\\" and self.at + 1 < len(self.text):
                following = self.text[self.at + 1]
                out += following if following in _ESCAPED else c + following
                self.at += 2
                continue
            if c.isspace() or c in ':^"' or (c == "~" and out):
                break
            wild = wild or c in "*?"
            out += c
            self.at += 1
        return out, wild, self.peek() == ":"

    def suffix(self, mark: str, default: float | None) -> float | None:
        if self.peek() != mark:
            return None
        self.at += 1
        m = _NUMBER.match(self.text, self.at)
        if m:
            self.at = m.end()
            return float(m[0])
        if default is None and self.peek() and not self.peek().isspace():
            raise QueryError(f"a number has to follow {mark}")
        return 1.0 if default is None else default


def parse_query_string(text: str) -> Query:
    """The boolean query of a string; an empty one matches nothing."""
    r = _Reader(text)
    sections: dict[str, list[Query]] = {"must": [], "should": [], "must_not": []}
    r.space()
    while r.peek():
        kind = {"+": "must", "-": "must_not"}.get(r.peek(), "should")
        if kind != "should":
            r.at += 1
        sections[kind].append(_clause(r))
        r.space()
    if not any(sections.values()):
        return Query("match_none")
    q = boolean(
        conjunction(*sections["must"]) if sections["must"] else None,
        disjunction(*sections["should"]) if sections["should"] else None,
        disjunction(*sections["must_not"]) if sections["must_not"] else None,
    )
    q.args["query_string"] = True
    return q


def _clause(r: _Reader) -> Query:
    fld = None
    start = r.at
    if r.peek() not in '"/':
        name, _, colon = r.word()
        if colon and name:
            fld = name
            r.at += 1
        else:
            r.at = start
    c = r.peek()
    if not c or c.isspace():
        raise QueryError(f"a term is missing at {r.at}")
    if fld is not None and c in "<>":
        return _boosted(r, _range(r, fld))
    if c == '"':
        phrase = r.quoted('"')
        fuzz = r.suffix("~", 1.0)
        q = Query("match_phrase", fld, args={"match_phrase": phrase} | ({"fuzziness": int(fuzz)} if fuzz is not None else {}))
        return _boosted(r, q)
    if c == "/" and "/" in r.text[r.at + 1 :]:
        return _boosted(r, Query("regexp", fld, args={"regexp": r.quoted("/")}))
    word, wild, _ = r.word()
    while r.peek() == ":":  # further colons belong to the text
        r.at += 1
        more, more_wild, _ = r.word()
        word, wild = f"{word}:{more}", wild or more_wild
    if not word:
        raise QueryError(f"a term is missing at {r.at}")
    fuzz = r.suffix("~", 1.0)
    if fuzz is not None:
        q = Query("match", fld, args={"match": word, "fuzziness": int(fuzz)})
    elif wild:
        q = Query("wildcard", fld, args={"wildcard": word})
    elif _NUMBER.fullmatch(word):
        value = float(word)
        equal = Query("numeric_range", fld, args={"min": value, "max": value, "inclusive_min": True, "inclusive_max": True})
        q = disjunction(Query("match", fld, args={"match": word}), equal)
        q.args["query_string"] = True
    else:
        q = Query("match", fld, args={"match": word})
    return _boosted(r, q)


def _boosted(r: _Reader, q: Query) -> Query:
    boost = r.suffix("^", None)
    if boost is not None:
        q.boost = boost
        for c in q.children:
            c.boost = boost
    return q


def _range(r: _Reader, fld: str) -> Query:
    low = r.peek() == ">"
    r.at += 1
    inclusive = r.peek() == "="
    r.at += inclusive
    side = "min" if low else "max"
    if r.peek() == '"':
        edge = "start" if low else "end"
        return Query("date_range", fld, args={edge: r.quoted('"'), f"inclusive_{edge}": inclusive})
    m = _NUMBER.match(r.text, r.at)
    if not m:
        raise QueryError(f"a number or a quoted date has to follow the comparison at {r.at}")
    r.at = m.end()
    return Query("numeric_range", fld, args={side: float(m[0]), f"inclusive_{side}": inclusive})
