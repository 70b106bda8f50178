"""Redaction of secrets, urls and paths, opaque identifiers, hashes and leak checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What redacted parts become.
SECRET, URL, PATH, CUT = "[redacted-secret]", "[redacted-url]", "[sensitive-path]", "[truncated]"
#: Longest output by context, in characters; the input is read up to MOST_INPUT.
MOST_INPUT, MOST_TOKENS = 4096, 80
LIMITS = {"evidence": 512, "diagnostic": 256, "url": 256, "path": 256, "command_result": 512, "summary": 200, "metadata": 200}

#: Kind, prefix, alphabet and least length of what follows, in any letter case. All places that redact must agree on them.
CREDENTIAL_SHAPES = (
    ("code host token", "gh[pousr]_", "A-Za-z0-9_-", 16),
    ("service key", "sk-", "A-Za-z0-9_-", 16),
    ("cloud access key", "AKIA", "0-9A-Z", 16),
    ("chat token", "xox[baprs]-", "A-Za-z0-9-", 20),
    ("web token", "eyJ", "A-Za-z0-9_-", 10),
    ("authorization", r"(?:Bearer|Basic)\s+", "A-Za-z0-9._~+/=:-", 8),
)


def credential(kind: str, prefix: str, alphabet: str, least: int) -> str:
    """The pattern of a shape: its prefix at the start of a word and a run of its alphabet. A web token has three such parts."""
    run = f"[{alphabet}]{{{least},}}"
    return rf"(?i)(?<![A-Za-z0-9_]){prefix}{run}" + (rf"(?:\.{run}){{2}}" if kind == "web token" else "")


#: A PEM private key from its first line to its last, or to the end where it is cut.
KEY_BLOCK = r"(?is)-----\s*BEGIN\b[^-]*PRIVATE\s+KEY[^-]*-----.*?(?:-----\s*END\b[^-]*PRIVATE\s+KEY[^-]*-----|\z)"
CREDENTIALS = (KEY_BLOCK, credential("personal token", "github_pat_", "A-Za-z0-9_", 16), *(credential(*s) for s in CREDENTIAL_SHAPES))
#: What each of them begins with: a text without any of these holds no credential, and is told so by one pass.
MARKS = "(?i)PRIVATE\\s+KEY|github_pat_|" + "|".join(prefix for _, prefix, _, _ in CREDENTIAL_SHAPES)
SECRET_NAMES = "password|passwd|secret|token|api_?key|authorization|credential"
ASSIGNED = rf"""(?i)(["']?\b[a-z0-9_-]*(?:{SECRET_NAMES})[a-z0-9_-]*["']?\s*[:=]\s*)("[^"]*"|'[^']*'|[^\s,;}}\]]+)"""
#: Runs of the base64 alphabet that are long enough to be encoded data.
BLOB = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{20,}={0,2}"
WINDOWS_PATH = r"(?i)(\b[a-z]:\\|\\\\)[^\s\"'<>|]+"
SECRET_PLACES = r"/\.ssh/|/\.aws/|id_rsa|id_ed25519|\.pem\b|\.p12\b"
POSIX_SECRET_PATH = rf"(?i)(~|/)?[^\s\"']*({SECRET_PLACES}|(^|/)\.env)[^\s\"']*"
HOME_PATH = r"(~|/home/[^/\s]+|/Users/[^/\s]+)/[^\s\"'<>|;,)]+"
URL_STEPS = (
    (r"(?i)\b([a-z][a-z0-9+.-]*://)[^\s/@<>\"']+@", "$1"),
    (r"([?&][^=\s&#\"'<>]+)=[^\s&#\"'<>]*", "$1=[redacted]"),
    (r"(?i)\b([a-z][a-z0-9+.-]*://[^\s/?#<>\"']+)/[^\s?#<>\"']+", f"$1/{URL}"),
)
PATH_STEPS = ((WINDOWS_PATH, r"\\"), (POSIX_SECRET_PATH, rf"(?i){SECRET_PLACES}|\.env"), (HOME_PATH, "~/|/home/|/Users/"))


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def where_found(text: Column, mark: str, change) -> Column:
    """``change(text)`` where the text holds ``mark``, a cheap pattern that stands in all that ``change`` can find; else the text."""
    return bind(text, lambda t: F.when(t.rlike(mark), change(t)).otherwise(t))


def redact_secrets(text: Column) -> Column:
    """Private keys, tokens of known shapes, bearer values and long encoded runs."""
    def each(t: Column) -> Column:
        for pattern in CREDENTIALS:
            t = F.regexp_replace(t, pattern, SECRET)
        return t

    return F.regexp_replace(where_found(text, MARKS, each), BLOB, SECRET)


def redact_assignments(text: Column) -> Column:
    """Values of keys that name a secret, in shell, JSON and YAML forms; the key stays."""
    return where_found(text, f"(?i){SECRET_NAMES}", lambda t: F.regexp_replace(t, ASSIGNED, f"$1{SECRET}"))


def redact_urls(text: Column) -> Column:
    """User info, query values and path parts of urls go, also of a url inside a percent-encoded value."""
    decoded = lambda t: F.regexp_replace(F.regexp_replace(t, "(?i)%3a", ":"), "(?i)%2f", "/")
    text = where_found(text, "(?i)%3a%2f%2f", decoded)

    def each(t: Column) -> Column:
        for pattern, to in URL_STEPS:
            t = F.regexp_replace(t, pattern, to)
        return t

    return where_found(text, "://|[?&]", each)


def redact_paths(text: Column) -> Column:
    for pattern, mark in PATH_STEPS:
        text = where_found(text, mark, lambda t, p=pattern: F.regexp_replace(t, p, PATH))
    return text


def redact(text: Column, nested: bool = True) -> Column:
    """All of these. With ``nested``, texts with escaped quotes or percent-encoding are read in their inner forms first, see nested."""
    from sessionlens.functions.nested import unnested

    if nested:
        text = unnested(text)
    return redact_paths(redact_urls(redact_assignments(redact_secrets(text))))


def sanitise(text: Column, context: str = "evidence") -> Column:
    """Redacted text that is fit for an event: input cut, redacted, white space collapsed, output cut with a mark.

    Redaction comes before the output is cut, so that no cut bares part of a secret. A secret that the input cut would
    break is covered by cutting at the last white space when the input is too long.
    """
    return sanitise_for(text, (context,))[context]


def sanitise_for(text: Column, contexts: tuple[str, ...]) -> Column:
    """A struct with the text sanitised for each context; it is redacted once and only cut for each."""
    head = F.substring(text, 1, MOST_INPUT)
    whole = F.when(F.length(text) > MOST_INPUT, F.regexp_replace(head, r"\S*\z", "")).otherwise(head)

    def each(clean: Column) -> Column:
        one_line = F.array_join(F.slice(F.split(F.trim(clean), r"\s+"), 1, MOST_TOKENS), " ")
        fit = lambda c, most: F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - len(CUT)), F.lit(CUT))).otherwise(c)
        return bind(one_line, lambda c: F.struct(*[fit(clean if k == "command_result" else c, LIMITS[k]).alias(k) for k in contexts]))

    return bind(redact(whole), each)


def has_credential(text: Column) -> Column:
    """True if a text holds a credential of a known shape."""
    found = F.lit(False)
    for pattern in CREDENTIALS:
        found = found | text.rlike(pattern)
    return text.rlike(MARKS) & found


def opaque(kind: str, value: Column) -> Column:
    return F.concat(F.lit(f"[{kind}:"), F.sha2(value, 256), F.lit("]"))


def safe_identifier(kind: str, value: Column, most: int = 64) -> Column:
    """A plain name stays, anything else becomes opaque."""
    return F.when(value.rlike(rf"^[A-Za-z][A-Za-z0-9_.:-]{{0,{most - 1}}}$") & ~has_credential(value), value).otherwise(opaque(kind, value))


def rationale(text: Column, most: int = 160) -> Column:
    return F.left(F.trim(F.regexp_replace(F.regexp_replace(text, r"[\p{Cntrl}]", " "), r"\s+", " ")), F.lit(most))


def leaks(df: DataFrame, markers: list[str]) -> DataFrame:
    """Rows of an output table whose JSON form holds a marker string; none may."""
    body = F.to_json(F.struct("*"))
    return df.where(F.exists(F.array(*[F.lit(m) for m in markers]), lambda m: body.contains(m)))
