"""Secrets inside strings inside strings: escaped quotes and percent-encoding are read to a depth, redacted there and written back."""

from __future__ import annotations

import json
import re
from urllib.parse import unquote

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

DEPTH = 2
#: What a text must hold for its inner forms to differ from what is written.
NESTED = r'\\["\\nrtu/]|%[0-9A-Fa-f]{2}'
LITERAL = re.compile(r'"((?:[^"\\]|\\.)*)"', re.S)
ENCODED = re.compile(r"[^\s\"'<>&?#=]*%[0-9A-Fa-f]{2}[^\s\"'<>&?#=]*")


def _unescaped(inner: str) -> str:
    """What a quoted text says: as JSON if it is, else with each escape as the character after the backslash."""
    try:
        return json.loads(f'"{inner}"', strict=False)
    except ValueError:
        return re.sub(r"\\(.)", r"\1", inner, flags=re.S)


class Scanner:
    """Redacts the inner forms of a text and leaves what stands in it plainly to the caller's own patterns."""

    def __init__(self):
        from sessionlens.functions import privacy

        end = lambda p: regex.compile(re.sub(r"(?<!\\)\\z", r"\\Z", p))
        back = lambda to: re.sub(r"\$(\d)", r"\\g<\1>", to)
        secret = privacy.SECRET
        self.steps = [(end(p), secret) for p in (*privacy.CREDENTIALS, privacy.BLOB)] + [(end(privacy.ASSIGNED), rf"\g<1>{secret}")]
        self.steps += [(end(p), back(to)) for p, to in privacy.URL_STEPS] + [(end(p), privacy.PATH) for p, _ in privacy.PATH_STEPS]

    def plain(self, text: str) -> str:
        for pattern, to in self.steps:
            text = pattern.sub(to, text)
        return text

    def inner(self, text: str, depth: int = DEPTH) -> str:
        """``text`` with its quoted and encoded parts redacted, those in them too, down to ``depth``."""
        if depth == 0:
            return text

        def literal(m: re.Match) -> str:
            if "\\" not in m.group(1):
                return m.group()
            said = _unescaped(m.group(1))
            clean = self.plain(self.inner(said, depth - 1))
            return json.dumps(clean, ensure_ascii=False) if clean != said else m.group()

        def encoded(m: re.Match) -> str:
            said = unquote(m.group())
            if said == m.group():
                return said
            clean = self.plain(self.inner(said, depth - 1))
            return clean if clean != said else m.group()

        return ENCODED.sub(encoded, LITERAL.sub(literal, text))


def unnested(text: Column) -> Column:
    """``text`` with the secrets of its inner forms redacted. Only texts with an escape or an encoded character reach Python."""
    def scan(texts: pd.Series) -> pd.Series:
        scanner = Scanner()
        return pd.Series([None if t is None else scanner.inner(t) for t in texts], dtype=object)

    return F.coalesce(F.pandas_udf(scan, "string")(F.when(text.rlike(NESTED), text)), text)
