"""Personal data: base patterns, and terms that the corpus shows to give protected entities away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlens.llm.common import cut

KINDS = ("email", "ip", "card", "phone")
#: Each matches what its greedy form matches from the left; possessive runs and the look-behind keep long texts linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BYTE = r"0*+(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5]|)"
TERM = r"[\p{L}\p{N}]+"


def luhn(digits: Column) -> Column:
    """True if a string of digits passes the Luhn check."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def occurrences(text: Column, pattern: str) -> Column:
    """All matches from the left as structs of start, end (code points, end exclusive) and value.

    The pieces between the matches and the matches themselves alternate, so their lengths add up to the places.
    """
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    pieces = F.transform(F.split(text, pattern, -1), F.length)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.slice(pieces, 1, F.size(values)).alias("gap"), values.alias("value"))
    placed = F.aggregate(
        pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda a, x: F.struct((a["at"] + x["gap"] + F.length(x["value"])).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + F.length(x["value"])).alias("end"), x["value"].alias("value")))).alias("out")),
    )["out"]
    return F.when(text.rlike(pattern), placed).otherwise(empty)


def standing(text: Column, terms: Column) -> Column:
    """Places (start, end) of all words of ``text`` that are among ``terms`` in lower case."""
    words = F.regexp_extract_all(text, F.lit(TERM), F.lit(0))
    gaps = F.transform(F.split(text, TERM, -1), F.length)
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(a, x):
        start, end = a["at"] + x["gap"], a["at"] + x["gap"] + F.length(x["value"])
        return F.struct(end.alias("at"), F.when(F.array_contains(terms, F.lower(x["value"])), F.concat(a["out"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(a["out"]).alias("out"))

    return F.aggregate(F.arrays_zip(F.slice(gaps, 1, F.size(words)).alias("gap"), words.alias("value")), F.struct(F.lit(0).alias("at"), none.alias("out")), step)["out"]


def base_matches(text: Column, kind: str) -> Column:
    found = F.filter(occurrences(text, PATTERNS[kind]), lambda m: valid(kind, m["value"]))
    if kind == "email":
        none = F.array().cast("array<struct<start:int,end:int,value:string>>")
        return F.when(F.contains(text, F.lit("@")), found).otherwise(none)
    return found


def window_terms(text: Column, kind: str, match: Column, width: int) -> Column:
    """Terms that lie whole within ``width`` characters before or after a match, with kind, entity and place."""
    before = F.greatest(match["start"] - width, F.lit(0))
    entity = F.xxhash64(match["value"])

    def terms(start: Column, length: Column, cut_left: Column, cut_right: Column, size: Column) -> Column:
        found = occurrences(F.substring(text, start + 1, length), TERM)
        inside = F.filter(found, lambda t: ~(cut_left & (t["start"] == 0)) & ~(cut_right & (t["end"] == size)))
        return F.transform(inside, lambda t: F.struct(F.lit(kind).alias("kind"), entity.alias("entity"), F.lower(t["value"]).alias("term"), (start + t["start"]).alias("start"), (start + t["end"]).alias("end")))

    n = match["start"] - before
    left = terms(before, n, before > 0, F.lit(False), n)
    m = F.least(F.length(text) - match["end"], F.lit(width))
    right = terms(match["end"], m, F.lit(False), match["end"] + m < F.length(text), m)
    return F.concat(left, right)


def near_match(kind: str, width: int):
    return lambda match: window_terms(F.col("text"), kind, match, width)


def found_in(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """A row number, the id, base matches of each kind, the terms of their windows, and the text."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.withColumns({k: base_matches(F.col("text"), k) for k in KINDS})
    near = F.concat(*[F.flatten(F.transform(F.col(k), near_match(k, width))) for k in KINDS])
    near = F.array_distinct(F.transform(near, lambda t: F.struct(t["kind"], t["entity"], t["term"])))
    return rows.select("row", "doc_id", *KINDS, near.alias("near"), "text")


def entities_in() -> Column:
    """The different protected entities of a row of :func:`found_in`, as structs of kind and entity."""
    named = lambda k: F.transform(F.col(k), lambda m: F.struct(F.lit(k).alias("kind"), F.xxhash64(m["value"]).alias("entity")))
    return F.array_distinct(F.concat(*[named(k) for k in KINDS]))


def terms_of(text: Column) -> Column:
    """The different terms of a text in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def term_shares(found: DataFrame, least_entities: int = 5) -> tuple[DataFrame, int]:
    """(term, share, free), and the number of documents without an entity.

    share is how much of a protected entity's information a term gives away: the pointwise mutual information of the
    term and the entity over the information of the entity, -log2 of the share of documents that hold it. It is 1 for a
    term that no document without the entity holds, and falls by one bit's part each time the documents that hold the
    term double. A document counts for a term and an entity when the term stands in a window beside the entity. Copies of
    a document raise all these counts alike, so they change no share of an entity that only they hold. The largest share
    over all entities counts, single ones and, for terms beside ``least_entities`` of them, all of a kind taken as one.
    free is the number of documents that hold the term and no entity at all.
    """
    one = F.count(F.lit(1))
    holds = F.size(entities_in()) > 0
    seen = found.agg(one.alias("n"), F.count_if(~holds).alias("free")).first()
    near = found.where(F.size("near") > 0)
    of_one = cut(near.select(F.explode("near").alias("t")).groupBy("t.kind", "t.entity", "t.term").agg(one.alias("together")))
    kind_terms = F.array_distinct(F.transform("near", lambda t: F.struct(t["kind"], t["term"])))
    of_kind = near.select(F.explode(kind_terms).alias("t")).groupBy("t.kind", "t.term").agg(one.alias("together"))
    usual = of_one.groupBy("kind", "term").agg(one.alias("entities")).where(F.col("entities") >= least_entities)
    of_kind = of_kind.join(usual.select("kind", "term"), ["kind", "term"])

    held = found.select(F.explode(entities_in()).alias("e")).groupBy("e.kind", "e.entity").agg(one.alias("holding"))
    kinds = found.select(F.explode(F.array_distinct(F.transform(entities_in(), lambda e: e["kind"]))).alias("kind")).groupBy("kind").agg(one.alias("holding"))
    pairs = of_one.join(held, ["kind", "entity"]).select("term", "together", "holding")
    pairs = pairs.unionByName(of_kind.join(kinds, "kind").select("term", "together", "holding"))

    vocabulary = found.select(F.explode(terms_of(F.col("text"))).alias("word"), holds.alias("holds"))
    vocabulary = vocabulary.groupBy("word").agg(one.alias("texts"), F.count_if(~F.col("holds")).alias("free"))
    n = F.lit(float(max(1, seen["n"])))
    bits = F.log2(F.col("together") * n / (F.col("holding") * F.col("texts")))
    share = bits / F.greatest(F.log2(n / F.col("holding")), F.lit(1e-9))
    joined = pairs.join(vocabulary, F.col("term") == F.col("word")).select("term", share.alias("share"), "free")
    return cut(joined.groupBy("term").agg(F.max("share").alias("share"), F.max("free").alias("free"))), seen["free"]


def disclosing_terms(found: DataFrame, least_entities: int = 5, tolerance: float = 0.001, least_share: float = 0.5) -> DataFrame:
    """(term, share): terms that give more of an entity away than the corpus lets pass.

    The threshold comes from the corpus: the lowest share, ``least_share`` at least, from which on all terms together
    stand in no more than ``tolerance`` of the documents without an entity. It is found among 1,000 steps of the share.
    """
    shares, free = term_shares(found, least_entities)
    step = F.floor(F.col("share") * 1000)
    steps = shares.where(F.col("share") >= least_share).groupBy(step.alias("step")).agg(F.sum("free").alias("free")).collect()
    threshold, passed = 2.0, 0
    for r in sorted(steps, key=lambda r: -r["step"]):
        passed += r["free"]
        if passed > tolerance * free:
            break
        threshold = r["step"] / 1000
    return shares.where(step / 1000 >= threshold).select("term", "share")


def sendable(df: DataFrame, most: int) -> DataFrame:
    """``df`` with a hint to broadcast it if it has no more than ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 48, least_entities: int = 5, tolerance: float = 0.001, least_share: float = 0.5, keep_row: bool = False, most_sent: int = 500_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term, n_base.

    spans lists kind:start:end by kind (email, ip, card, phone, term), then start, in code points, end exclusive.
    `term` spans are the disclosing terms of :func:`disclosing_terms` wherever they stand in a text, unless a base span
    holds them: that goes anyway. n_base is the number of base spans. Terms, and the rows that hold them, are sent to all
    tasks up to ``most_sent`` of them, which is counted before; beyond that they are joined by shuffle.
    Null and empty texts have no spans; whole texts are read; repeated rows are read alike; empty in, empty out.
    """
    found = cut(found_in(docs, id_col, text_col, width))
    terms = sendable(disclosing_terms(found, least_entities, tolerance, least_share).select("term"), most_sent)
    own = found.select("row", F.explode(terms_of(F.col("text"))).alias("term"))
    own = cut(own.join(terms, "term", "left_semi"))
    hits = own.groupBy(F.col("row").alias("_row")).agg(F.collect_set("term").alias("terms"))
    if own.limit(most_sent + 1).count() <= most_sent:
        hits = F.broadcast(hits)
    base_spans = F.concat(*[F.transform(F.col(k), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))) for k in KINDS])
    stands = F.filter(standing(F.col("text"), F.col("terms")), lambda t: ~F.exists(base_spans, lambda b: (b["start"] <= t["start"]) & (t["end"] <= b["end"])))
    out = found.join(hits, F.col("row") == F.col("_row"), "left").withColumn("term_spans", F.when(F.col("terms").isNotNull(), stands))
    said = lambda k, c: F.transform(c, lambda m: F.concat_ws(":", F.lit(k), m["start"].cast("string"), m["end"].cast("string")))
    base = F.array_join(F.concat(*[said(k, F.col(k)) for k in KINDS]), ",")
    every = F.coalesce("term_spans", F.array().cast("array<struct<start:int,end:int>>"))
    return out.select(
        *["row"] * keep_row, "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(base, 256).alias("base_sha256"),
        F.array_join(F.concat(*[said(k, F.col(k)) for k in KINDS], said("term", every)), ",").alias("spans"),
        F.size(every).cast("long").alias("n_term"), sum((F.size(k) for k in KINDS), F.lit(0)).cast("long").alias("n_base"),
    )


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with its text sanitised: entities become their kind in capitals, disclosing terms are removed.

    Rows keep all their columns. Where spans overlap the first one wins. Rows are told apart by a key of their own, so each is
    cleaned by its own spans, whatever its id: null, repeated or unique. Columns travel in a struct, so none of their names can
    clash. A null text stays null.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = cut(docs.select(whole, F.monotonically_increasing_id().alias("nth")))
    text = F.col("row").getField(text_col).cast("string")
    spans = find_pii(rows.select("nth", text.alias("text")), "nth", "text", **options).where("spans <> ''").select(F.col("doc_id").alias("nth"), F.col("spans").alias("_spans"))
    parts = F.transform(F.split("_spans", ","), lambda s: F.struct(F.split(s, ":")[1].cast("int").alias("a"), F.split(s, ":")[2].cast("int").alias("b"), F.split(s, ":")[0].alias("k")))
    label = lambda k: F.when(k == "term", "").otherwise(F.concat(F.lit("["), F.upper(k), F.lit("]")))
    step = lambda acc, s: F.when(s["a"] < acc["at"], acc).otherwise(F.struct(s["b"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["a"] - acc["at"]), label(s["k"])).alias("out")))
    done = F.aggregate(F.array_sort(parts), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    clean = F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))
    out = rows.join(spans, "nth", "left").withColumn("clean", F.when(F.col("_spans").isNull() | text.isNull(), text).otherwise(clean))
    return out.select(*[F.col("clean").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
