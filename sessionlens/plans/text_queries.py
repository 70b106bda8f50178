"""Queries on documents and pages: predicates, paths, hosts, redaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionlens.functions import activity, privacy
from sessionlens.operators import predicates
from sessionlens.plans.inputs import table
from sessionlens.plans.registry import query


@query(r"""SELECT doc_id, text = 'x' AS p_equals, contains(text, 'the') AS p_contains, starts_with(text, 'T') AS p_starts, ends_with(text, '.') AS p_ends, regexp_matches(text, '[0-9]{4}') AS p_regex, regexp_full_match(lang, 'e.') AS p_glob, lang IN ('en', 'de') AS p_in, lang NOT IN ('en', 'de') AS p_not_in FROM documents""")
def text_predicates(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    t, lang, op = F.col("text"), F.col("lang"), predicates.op
    return d.select("doc_id", op("equals", t, "x").alias("p_equals"), op("contains", t, "the").alias("p_contains"), op("starts_with", t, "T").alias("p_starts"), op("ends_with", t, ".").alias("p_ends"), op("regex", t, "[0-9]{4}").alias("p_regex"), op("glob", lang, "e?").alias("p_glob"), op("in", lang, ["en", "de"]).alias("p_in"), op("not_in", lang, ["en", "de"]).alias("p_not_in"))


@query("""SELECT event_id, value > 50 AND (CASE WHEN event_type = 'error' THEN NULL ELSE event_id % 2 = 0 END) AS k_all, value > 50 OR (CASE WHEN event_type = 'error' THEN NULL ELSE event_id % 2 = 0 END) AS k_any, NOT (CASE WHEN event_type = 'error' THEN NULL ELSE event_id % 2 = 0 END) AS k_not FROM events""")
def kleene(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    a = predicates.op("gt", F.col("value"), 50)
    b = predicates.require(F.col("event_id") % 2 == 0, provenance=F.col("event_type") != "error")
    return e.select("event_id", predicates.all_of(a, b).alias("k_all"), predicates.any_of(a, b).alias("k_any"), predicates.not_(b).alias("k_not"))


CLASS_SQL = """CASE WHEN NOT (contains(l, '/') OR contains(l, '.')) OR t = '' OR starts_with(t, 'http://') OR starts_with(t, 'https://') THEN NULL
 WHEN contains(l, '.env') OR contains(l, 'id_rsa') OR contains(l, 'id_ed25519') OR contains(l, '.aws/credentials') OR contains(l, '.ssh/') OR contains(l, 'credentials') OR contains(l, 'token') THEN 'secret_store'
 WHEN starts_with(l, '/tmp/') OR starts_with(l, 'tmp/') OR starts_with(l, '/var/tmp/') OR ((starts_with(l, '/users/') OR starts_with(l, 'c:/users/')) AND contains(l, '/appdata/local/temp/')) THEN 'temp'
 WHEN starts_with(l, '~/') OR starts_with(l, '/home/') OR starts_with(l, '/users/') OR starts_with(l, 'c:/users/') OR starts_with(l, '$home/') THEN 'home'
 WHEN contains(l, '/test/') OR contains(l, '/tests/') OR starts_with(l, 'test/') OR starts_with(l, 'tests/') OR ends_with(l, '_test.rs') OR ends_with(l, '.test.js') OR ends_with(l, '.spec.ts') THEN 'test'
 WHEN ends_with(l, '.md') OR starts_with(l, 'docs/') OR contains(l, '/docs/') OR ends_with(l, '.rst') THEN 'documentation'
 WHEN ends_with(l, 'cargo.toml') OR ends_with(l, 'package.json') OR ends_with(l, 'pyproject.toml') OR ends_with(l, 'go.mod') OR ends_with(l, 'pom.xml') THEN 'build_manifest'
 WHEN ends_with(l, '.yaml') OR ends_with(l, '.yml') OR ends_with(l, '.toml') OR ends_with(l, '.json') OR ends_with(l, '.ini') OR ends_with(l, '.conf') THEN 'config'
 WHEN ends_with(l, '.rs') OR ends_with(l, '.py') OR ends_with(l, '.js') OR ends_with(l, '.ts') OR ends_with(l, '.tsx') OR ends_with(l, '.go') OR ends_with(l, '.java') OR ends_with(l, '.c') OR ends_with(l, '.cpp') OR ends_with(l, '.h') THEN 'source' ELSE 'other' END"""
TRIMMED_SQL = r"""regexp_replace(x, '^["''`,;:)(\[\]{}]+|["''`,;:)(\[\]{}]+$', '', 'g')"""


@query(f"""WITH w AS (SELECT page_id, unnest(string_split_regex(regexp_replace(url, '^https?:/', '') || ' /tmp/' || page_id || ' ~/p' || page_id || '.py (src/' || page_id || '.rs) docs/' || page_id || ' ./.env', '\\s+')) AS x FROM pages),
t AS (SELECT page_id, {TRIMMED_SQL} AS t FROM w), l AS (SELECT *, lower(t) AS l FROM t)
SELECT class, count(*) AS n FROM (SELECT {CLASS_SQL} AS class FROM l) WHERE class IS NOT NULL GROUP BY 1""")
def path_classes(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    text = F.concat(F.regexp_replace("url", "^https?:/", ""), F.lit(" /tmp/"), F.col("page_id"), F.lit(" ~/p"), F.col("page_id"), F.lit(".py (src/"), F.col("page_id"), F.lit(".rs) docs/"), F.col("page_id"), F.lit(" ./.env"))
    return p.select(F.explode(activity.path_classes(text)).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH t AS (SELECT doc_id, {TRIMMED_SQL} AS t FROM (SELECT doc_id, unnest(string_split_regex(text, '\\s+')) AS x FROM documents)), l AS (SELECT *, lower(t) AS l FROM t)
SELECT doc_id, class, count(*) AS n FROM (SELECT doc_id, {CLASS_SQL} AS class FROM l) WHERE class IS NOT NULL GROUP BY 1, 2""")
def document_paths(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.explode(activity.path_classes(F.col("text"))).alias("class")).groupBy("doc_id", "class").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) AS host, count(*) AS n, 'sha256:' || sha256(lower(regexp_extract(url, '^https?://([^/?#:]*)', 1))) AS identity FROM pages GROUP BY ALL""")
def network_hosts(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    hosts = p.select(F.explode(activity.network_hosts(F.col("url"))).alias("host")).groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    return hosts.withColumn("identity", activity.host_identity(F.col("host")))


@query("""SELECT page_id, url, 'out/' || page_id || '.txt' AS path FROM pages""")
def argument_facts(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    args = F.to_json(F.struct(F.col("url"), F.concat(F.lit("out/"), F.col("page_id"), F.lit(".txt")).alias("file_path"), F.lit("x").alias("content")))
    return p.select("page_id", F.get(activity.argument_urls(args), F.lit(0)).alias("url"), F.get(activity.written_paths(F.lit("fetch"), args), F.lit(0)).alias("path"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'shell' WHEN p_partkey % 4 = 1 THEN 'file_read' WHEN p_partkey % 4 = 2 THEN 'file_write' END AS kind FROM part""")
def tool_kinds(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    name = F.when(F.col("p_partkey") % 4 == 0, "Bash").when(F.col("p_partkey") % 4 == 1, "Read").when(F.col("p_partkey") % 4 == 2, "MultiEdit").otherwise(F.col("p_name"))
    return p.select("p_partkey", activity.tool_kind(name).alias("kind"))


@query(r"""SELECT doc_id, sha256(regexp_replace(text, '(?i)(["'']?\b[a-z0-9_-]*(?:password|passwd|secret|token|api_?key|authorization|credential)[a-z0-9_-]*["'']?\s*[:=]\s*)("[^"]*"|''[^'']*''|[^\s,;}\]]+)', '\1[redacted-secret]', 'g')) AS redacted FROM documents""")
def redact_assignments(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(privacy.redact_assignments(F.col("text")), 256).alias("redacted"))


@query("""SELECT page_id, sha256(regexp_replace(regexp_replace(url, '([?&][^=\\s&#"''<>]+)=[^\\s&#"''<>]*', '\\1=[redacted]', 'g'), '(?i)\\b([a-z][a-z0-9+.-]*://[^\\s/?#<>"'']+)/[^\\s?#<>"'']+', '\\1/[redacted-url]', 'g')) AS redacted FROM pages""")
def redact_urls(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.sha2(privacy.redact_urls(F.col("url")), 256).alias("redacted"))


@query()
def sanitised_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", privacy.sanitise_for(F.col("text"), ("evidence", "summary")).alias("s")).select("doc_id", "s.*")


#: The shapes for DuckDB, which has no look-behind: a mark or the start stands before them. Where a key's block ends doesn't matter here.
_SHAPES = [p.replace(r"(?<![A-Za-z0-9_])", "(?:^|[^A-Za-z0-9_])").removesuffix(r"(?:-----\s*END\b[^-]*PRIVATE\s+KEY[^-]*-----|\z)") for p in privacy.CREDENTIALS]
CREDENTIAL_SQL = "SELECT doc_id, coalesce(" + " OR ".join(f"regexp_matches(text, '{p}')" for p in _SHAPES) + ", false) AS has_credential FROM documents"


@query(CREDENTIAL_SQL)
def credential_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.coalesce(privacy.has_credential(F.col("text")), F.lit(False)).alias("has_credential"))


@query("""SELECT s_suppkey, '[supplier:' || sha256(s_name) || ']' AS opaque_name FROM supplier""")
def opaque_identifiers(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", privacy.safe_identifier("supplier", F.col("s_name")).alias("opaque_name"))


@query("""SELECT n_nationkey, lower(replace(replace(n_name, '.', '_'), '-', '_')) AS process FROM nation""")
def process_names(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", activity.process_name(F.concat(F.lit("C:\\Windows\\"), F.col("n_name"), F.lit(".EXE"))).alias("process"))


@query("""SELECT doc_id, CASE WHEN n_chars >= 90 THEN 'critical' WHEN n_chars >= 70 THEN 'high' WHEN n_chars >= 50 THEN 'medium' WHEN n_chars >= 20 THEN 'low' ELSE 'informational' END AS severity FROM documents""")
def severity_bands(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", activity.severity(F.col("n_chars")).alias("severity"))
