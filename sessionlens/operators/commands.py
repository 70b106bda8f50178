"""Shell commands of a whole table: segments, quote-free readings, tokens and stages.

Commands without quotes or escapes are split by Spark itself; only the others pass through an Arrow stage.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLAIN_SPLIT = r"\s*(?:&&|\|\||\|&|[;|\n&])\s*"
QUOTED = r"""['"\\]"""
OPERATORS = ("&&", "||", "|&", ";", "|", "\n", "&")
WRAPPERS = ("sudo", "env", "nohup", "time", "command", "exec", "nice", "stdbuf", "timeout", "xargs", "doas")
SHELLS = ("sh", "bash", "zsh", "fish", "dash", "ksh", "pwsh", "powershell", "cmd")
INTERPRETERS = ("python", "python3", "node", "perl", "ruby", "php")
INLINE = ("-c", "-e", "-r", "--eval", "-command", "/c")
DOWNLOADERS = ("curl", "wget", "iwr", "invoke-webrequest", "aria2c", "fetch")
UPLOAD_FLAGS = ("-d", "--data", "--data-binary", "--data-raw", "--data-urlencode", "-f", "--form", "-t", "--upload-file", "--post-data", "--post-file", "--body-data", "--body-file")
PACKAGE_TOOLS = {"pip": ("install",), "pip3": ("install",), "npm": ("install", "i", "add"), "yarn": ("add",), "pnpm": ("add", "install"), "apt": ("install",), "apt-get": ("install",), "brew": ("install",), "cargo": ("install",), "gem": ("install",), "go": ("install", "get")}


def lex(command: str) -> list[tuple[str, list[str], str]]:
    """(text, tokens, separator after) of each segment, split outside quotes; redirections such as 2>&1 stay whole."""
    out, words = [], []
    word: list[str] = []
    has_word, quote, start, i, n = False, "", 0, 0, len(command)

    def end_word():
        nonlocal has_word
        if has_word:
            words.append("".join(word))
            word.clear()
            has_word = False

    while i < n:
        c = command[i]
        if quote:
            if c == quote:
                quote = ""
            elif c == "\\" and quote == '"' and i + 1 < n:
                i += 1
                word.append(command[i])
            else:
                word.append(c)
        elif c in "'\"":
            quote, has_word = c, True
        elif c == "\\" and i + 1 < n:
            i += 1
            word.append(command[i])
            has_word = True
        elif c == "&" and i and command[i - 1] in "<>" or c == "&" and i + 1 < n and command[i + 1] == ">":
            word.append(c)
            has_word = True
        elif op := next((o for o in OPERATORS if command.startswith(o, i)), ""):
            end_word()
            if text := command[start:i].strip():
                out.append((text, words.copy(), op))
            words.clear()
            i += len(op)
            start = i
            continue
        elif c.isspace():
            end_word()
        else:
            word.append(c)
            has_word = True
        i += 1
    end_word()
    if text := command[start:].strip():
        out.append((text, words.copy(), ""))
    return out


def quote_free(command: str) -> str:
    """The command without quotes and escapes."""
    return "".join((" ".join(tokens) + {"": ""}.get(sep, f" {sep} ")) for _, tokens, sep in lex(command))


STAGES = "array<struct<text:string,tokens:array<string>,separator:string>>"


READ = f"struct<stages:{STAGES},quote_free:string>"


def _read(command: pd.Series) -> pd.DataFrame:
    stages = [None if c is None else [{"text": t, "tokens": w, "separator": s} for t, w, s in lex(c)] for c in command]
    return pd.DataFrame({"stages": stages, "quote_free": [None if c is None else quote_free(c) for c in command]})


def with_stages(obs: DataFrame, column: str = "command") -> DataFrame:
    """``obs`` with ``stages`` (text, tokens and separator of each segment) and ``quote_free``.

    A null command has neither. Rows without a quote or escape and without an operator are one stage of their words.
    """
    c = F.col(column)
    plain = c.isNull() | ~c.rlike(QUOTED + r"|[;|&\n<>]")
    words = F.filter(F.split(F.trim(c), r"\s+"), lambda t: t != "")
    easy = F.when(F.trim(c) == "", F.array().cast(STAGES)).otherwise(F.array(F.struct(F.trim(c).alias("text"), words.alias("tokens"), F.lit("").alias("separator"))).cast(STAGES))
    read = obs.withColumn("_read", F.pandas_udf(_read, READ)(F.when(~plain, c)))
    return read.withColumns({"stages": F.when(plain & c.isNotNull(), easy).otherwise(F.col("_read.stages")), "quote_free": F.when(plain, c).otherwise(F.col("_read.quote_free"))}).drop("_read")


def with_segments(obs: DataFrame, column: str = "command") -> DataFrame:
    """``obs`` with ``segments`` and ``quote_free`` of the command."""
    return with_stages(obs, column).withColumn("segments", F.transform("stages", lambda s: s["text"])).drop("stages")


def command_segments(obs: DataFrame, column: str = "command") -> DataFrame:
    """(observation_id, seg_no, segment) of every command."""
    return with_segments(obs, column).select("observation_id", F.posexplode("segments").alias("seg_no", "segment"))


def command_tokens(obs: DataFrame, column: str = "command") -> DataFrame:
    """(observation_id, statement_no, token_no, token) of every command."""
    stages = with_stages(obs, column).select("observation_id", F.posexplode("stages").alias("statement_no", "s"))
    return stages.select("observation_id", "statement_no", F.posexplode("s.tokens").alias("token_no", "token"))


def json_shell_call(arguments: Column) -> Column:
    """The command of a recorded JSON shell call, as :func:`~sessionlens.operators.spans.shell_call` reads it, else null."""
    from sessionlens.operators.spans import shell_call

    def read(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or (call := shell_call(t)) is None else call[0] for t in texts], dtype=object)

    return F.pandas_udf(read, "string")(F.when(F.ltrim(arguments).startswith("{"), arguments))


def bare_tokens(tokens: Column) -> Column:
    """Tokens after wrappers and leading assignments, so that the first is the program."""
    skip = lambda t: F.lower(t).isin(*WRAPPERS) | t.rlike(r"^[A-Za-z_][A-Za-z0-9_]*=")
    lead = F.aggregate(tokens, F.struct(F.lit(0).alias("n"), F.lit(True).alias("open")), lambda a, t: F.struct((a["n"] + F.when(a["open"] & skip(t), 1).otherwise(0)).alias("n"), (a["open"] & skip(t)).alias("open")))["n"]
    return F.slice(tokens, lead + 1, F.size(tokens))


def program(tokens: Column) -> Column:
    """Base name of a stage's program in lower case, without .exe."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.get(tokens, F.lit(0)), r"([^/\\]*)$", 1)), r"\.exe$", "")


def is_url(token: Column) -> Column:
    return token.rlike(r"(?i)^(https?|ftp)://") & ~token.rlike(r"(?i)^[a-z]+://(localhost|127\.|\[::1\]|0\.0\.0\.0)")


def is_upload(tokens: Column) -> Column:
    """A stage that sends data: body or form flags, methods that write, or a cloud copy from a local source."""
    prog, low = program(tokens), F.transform(tokens, F.lower)
    http = prog.isin(*DOWNLOADERS, "http", "https") & (F.exists(low, lambda t: t.isin(*UPLOAD_FLAGS) | t.rlike(r"^(--(data|form|post|body)[a-z-]*=|-d.)")) | F.exists(low, lambda t: t.isin("post", "put", "-xpost", "-xput")))
    operands = F.filter(F.slice(tokens, 2, F.size(tokens)), lambda t: ~t.startswith("-"))
    remote = r"^(s3|gs|az|https?)://"
    cloud = prog.isin("aws", "gsutil", "rclone", "az") & F.exists(low, lambda t: t.isin("cp", "mv", "sync", "rsync", "copy", "move", "upload")) & F.coalesce(F.element_at(F.when(F.size(operands) > 0, operands), -1).rlike(remote + r"|^[a-z0-9_-]+:"), F.lit(False)) & ~F.coalesce(F.element_at(F.when(F.size(operands) > 1, operands), -2).rlike(remote), F.lit(True))
    return http | cloud


def is_download(tokens: Column) -> Column:
    """A stage that fetches from a url that isn't the host itself."""
    return program(tokens).isin(*DOWNLOADERS) & F.exists(tokens, is_url) & ~is_upload(tokens)


def _one_of(words):
    return lambda t: t.isin(*words)


def stage_kind(tokens: Column) -> Column:
    """download, upload, shell, package or other, of a stage's tokens after wrappers."""
    low = F.transform(tokens, F.lower)
    inline = program(tokens).isin(*INTERPRETERS) & F.exists(low, lambda t: t.isin(*INLINE))
    package = F.lit(False)
    for tool, verbs in PACKAGE_TOOLS.items():
        package = package | ((program(tokens) == tool) & F.exists(low, _one_of(verbs)))
    return F.when(is_upload(tokens), "upload").when(is_download(tokens), "download").when(program(tokens).isin(*SHELLS) | inline, "shell").when(package, "package").otherwise("other")


def stages(obs: DataFrame, column: str = "command", keep: tuple[str, ...] = ("observation_id",)) -> DataFrame:
    """One row for each stage of each command: position, tokens after wrappers, program, kind, text, separator after and before."""
    rows = with_stages(obs, column).select(*keep, F.posexplode("stages").alias("stage_no", "s"), F.transform("stages", lambda s: s["separator"]).alias("seps"))
    bare = bare_tokens(F.col("s.tokens"))
    rows = rows.select(*keep, "stage_no", bare.alias("tokens"), F.col("s.text").alias("text"), F.col("s.separator").alias("separator"), F.get("seps", F.col("stage_no") - 1).alias("before"))
    return rows.withColumns({"program": program(F.col("tokens")), "kind": stage_kind(F.col("tokens"))})


def encoded_http(stage_rows: DataFrame) -> DataFrame:
    """Fetching stages that carry data out: a long base64-like query value, a substitution with base64, or a long host label with digits."""
    t = F.col("text")
    hit = t.rlike(r"[?&][^=\s]+=[A-Za-z0-9+/_-]{40,}") | t.rlike(r"(\$\(|`)[^)`]*base64") | t.rlike(r"(?i)://[a-z0-9-]*[0-9][a-z0-9-]{30,}\.")
    return stage_rows.where(F.col("program").isin(*DOWNLOADERS) & hit)


SECRET_FILE = r"(?i)(^|[/\\])(\.env(\.[a-z0-9_-]+)?|\.(bash|zsh)_secrets)$"
TEMPLATE_FILE = r"(?i)\.(example|sample|template|dist)$"


def secret_files(obs: DataFrame, column: str = "file_path") -> DataFrame:
    """``obs`` with ``secret_file``: the first path token that names a secrets file and no template copy, else null."""
    named = F.filter(F.split(F.coalesce(column, F.lit("")), r"\s+"), lambda t: t.rlike(SECRET_FILE) & ~t.rlike(TEMPLATE_FILE))
    return obs.withColumn("secret_file", F.get(named, F.lit(0)))


KEY_FILE = r"(?i)(^|[/\\])(id_rsa|id_ed25519|id_ecdsa|id_dsa)$|\.(pem|p12|key)$"
KEY_BLOCK = r"-----BEGIN [A-Z ]*PRIVATE KEY-----\s*[A-Za-z0-9+/]{16}"


def key_reads(obs: DataFrame) -> DataFrame:
    """Observations that show a private key: a key file read, or a key block with key material in a result."""
    read = (F.col("tool_kind") == "file_read") & F.col("file_path").rlike(KEY_FILE)
    return obs.where(F.coalesce(read, F.lit(False)) | F.coalesce(F.col("tool_result").rlike(KEY_BLOCK), F.lit(False)))


def downloaded_artifacts(stage_rows: DataFrame) -> DataFrame:
    """Download stages with ``artifact``: the file that they write; two names, standard output or shell variables give none."""
    def after(*flags):
        at = F.array_position(F.transform("tokens", F.lower), F.lit(flags[0]))
        out = F.when(at > 0, F.get("tokens", at.cast("int")))
        for f in flags[1:]:
            p = F.array_position(F.transform("tokens", F.lower) if f != "-O" else F.col("tokens"), F.lit(f))
            out = F.coalesce(out, F.when(p > 0, F.get("tokens", p.cast("int"))))
        return out

    url = F.get(F.filter("tokens", is_url), F.lit(0))
    base = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"^[a-z]+://[^/]+/(?:.*/)?([^/]+)$", 1)
    own = F.when(F.col("program") == "wget", F.coalesce(after("--output-document", "-O"), base)).otherwise(F.coalesce(after("-o", "--output", "-outfile"), F.when(F.exists("tokens", lambda t: t.isin("-O", "--remote-name")), base)))
    redirect = F.regexp_extract("text", r"(?<![0-9&])>{1,2}\s*([^\s>&|;]+)", 1)
    both = F.array_distinct(F.array_compact(F.array(F.when(own != "", own), F.when(redirect != "", redirect))))
    name = F.when(F.size(both) == 1, both[0])
    return stage_rows.where("kind = 'download'").withColumn("artifact", F.when(~name.rlike(r"[$`*?]") & ~name.isin("-", "/dev/stdout", "/dev/null"), F.regexp_replace(name, r"^\./", ""))).where("artifact is not null")


def executions(stage_rows: DataFrame) -> DataFrame:
    """Stages that run a file: (…, executed): the path itself, an interpreter's first operand, or PowerShell's -File."""
    operand = F.get(F.filter(F.slice("tokens", 2, F.size("tokens")), lambda t: ~t.startswith("-")), F.lit(0))
    runs = F.when(F.col("program").isin(*SHELLS, *INTERPRETERS, "source", "."), operand).otherwise(F.get("tokens", F.lit(0)))
    return stage_rows.withColumn("executed", F.regexp_replace(runs, r"^\./", "")).where("executed is not null")


def piped_download(stage_rows: DataFrame) -> DataFrame:
    """Observations whose command pipes a download into an interpreter, or runs a fetched script inline."""
    from pyspark.sql import Window as W

    w = W.partitionBy("observation_id").orderBy("stage_no")
    nxt = stage_rows.withColumns({"next_program": F.lead("program").over(w)})
    piped = (F.col("kind") == "download") & F.col("separator").isin("|", "|&") & F.col("next_program").isin(*SHELLS, *INTERPRETERS)
    inline = F.col("program").isin(*SHELLS, *INTERPRETERS) & F.col("text").rlike(r"(?i)(\$\(|<\(|`)\s*(curl|wget)\b[^)`]*https?://")
    return nxt.where(piped | inline).select("observation_id").distinct()
