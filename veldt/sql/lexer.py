"""Tokens of a statement."""

from __future__ import annotations

import re
from typing import NamedTuple

from veldt.errors import unsupported
from veldt.types import NAMES

#: Reserved words. Type names are reserved too, but may name columns (a superset: the tables of this world have a column `text`).
KEYWORDS = frozenset(
    "ALTER ADD AND AS COLUMN CONSTRAINT CREATE CASCADE DEFAULT DELETE DROP COMMIT ROLLBACK UNIQUE INDEX ASC DESC INNER JOIN KEY NOT NULL "
    "ON PRIMARY FOREIGN BY FROM INSERT INTO ORDER OR REFERENCES RESTRICT SELECT SET TABLE UPDATE USING VALUES WHERE TRUE FALSE".split()
)
TYPES = frozenset(NAMES)

_TOKEN = re.compile(r"\s+|(?P<real>\d+\.\d+)|(?P<int>\d+)|(?P<name>[^\W\d]\w*)|'(?P<text>[^']*)'|(?P<op><=|>=|<>|!=|[=<>(),.?+*-])")


class Token(NamedTuple):
    kind: str  # int, real, text, name, word (a keyword or type), op, end
    value: str
    at: int
    end: int


def tokenize(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m or (m.lastgroup in ("int", "real") and m.end() < len(sql) and (sql[m.end()].isalnum() or sql[m.end()] == "_")):
            raise unsupported()
        kind = m.lastgroup
        if kind:
            value = m[kind]
            if kind == "name" and value.upper() in KEYWORDS | TYPES:
                kind = "word"
            out.append(Token(kind, value, m.start(), m.end()))
        at = m.end()
    return [*out, Token("end", "", len(sql), len(sql))]
