"""Ordered work inside and across sessions: positions, links, chains, suppression, correlation."""

from __future__ import annotations

import bisect
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionlens.operators import carried
from sessionlens.operators.scoring import sendable
from sessionlens.storage import cut

#: Windows in seconds, least risk and sessions of a correlation, cap of sequence points, calls of a link.
CHAIN_WINDOW, REPEAT_WINDOW, CORRELATION_WINDOW = 900, 3600, 3600
CORRELATION_RISK, CORRELATION_SESSIONS = 70, 2
#: Seconds of a bucket in the running sums of a correlation.
CORRELATION_BUCKET = 4096
SEQUENCE_CAP, MOST_LINK_CALLS = 150, 10


def session_window(keys=("source_instance", "session_id")):
    """A session in order: missing times last, then time, sequence (missing first), child and id."""
    return W.partitionBy(*keys).orderBy(F.asc_nulls_last("occurred_at"), F.asc_nulls_first("source_sequence"), F.asc_nulls_first("child_ordinal"), "observation_id")


def timeline_index(obs: DataFrame) -> DataFrame:
    """``obs`` with ``idx``, its place in the session from 0."""
    return obs.withColumn("idx", (F.row_number().over(session_window()) - 1).cast("int"))


def call_positions(obs: DataFrame) -> DataFrame:
    """``obs`` with ``pos``, its place among the tool calls of its session, from 0.

    Records of one call id share the place of the first of them, whether call or result; a call without an id takes the next
    place, a result without one that of the call before, and messages and all other records that of the next call.
    """
    tool, has_id = F.col("family") == "tool", F.col("call_id").isNotNull()
    # a record without an id joins the call before it only as a returned result; a completed or failed call is one of its own
    is_result = F.coalesce(F.col("stage") == "result", F.lit(False))
    order = W.partitionBy("source_instance", "session_id").orderBy("idx")
    by_id = W.partitionBy("source_instance", "session_id", "call_id")
    df = timeline_index(obs).withColumn("_nth", F.row_number().over(W.partitionBy("source_instance", "session_id", tool, "call_id").orderBy("idx")))
    df = df.withColumn("_new", F.coalesce(tool & F.when(has_id, F.col("_nth") == 1).otherwise(~is_result), F.lit(False)))
    df = df.withColumn("_next", F.sum(F.col("_new").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    first = F.min(F.when(F.col("_new"), F.col("_next") - 1)).over(by_id)
    pos = F.when(tool & has_id, first).when(F.col("_new"), F.col("_next") - 1).when(tool, F.greatest(F.col("_next") - 1, F.lit(0))).otherwise(F.col("_next"))
    return df.withColumn("pos", pos.cast("int")).drop("_nth", "_new", "_next")


def call_links(obs: DataFrame) -> DataFrame:
    """(session, call_id, call_observation, result_observation): pairs where one call and one result share an id and the call comes first."""
    df = timeline_index(obs).where("family = 'tool' and call_id is not null")
    result = F.coalesce(F.col("stage").isin("result", "completed", "failed"), F.lit(False))
    per = df.groupBy("source_instance", "session_id", "call_id").agg(
        F.count_if(~result).alias("calls"), F.count_if(result).alias("results"), F.min(F.when(~result, F.struct("idx", "observation_id"))).alias("c"), F.min(F.when(result, F.struct("idx", "observation_id"))).alias("r"))
    return per.where("calls = 1 and results = 1 and c.idx < r.idx").select("source_instance", "session_id", "call_id", F.col("c.observation_id").alias("call_observation"), F.col("r.observation_id").alias("result_observation"))


def _place(row: tuple) -> tuple:
    """(call position, place in the session)."""
    return row[:2]


class LinkSearch:
    """The linked steps of one chain among a session's matched observations near each other.

    Observations come in order; each is told by the numbers of the requirements that it meets. What has come so far is held
    by requirement in order of (call position, place in the session), so the nearest on either side is a bisection away.
    """

    def __init__(self, requirements: int, calls: int, ordered: bool, micros: int | None):
        self.calls, self.ordered, self.micros = calls, ordered, micros
        self.seen: list[list[tuple]] = [[] for _ in range(requirements)]

    def _before(self, r: int, key: tuple, end: tuple) -> tuple | None:
        """The latest observation for requirement ``r`` not after ``key``."""
        rows = self.seen[r]
        for i in range(bisect.bisect_right(rows, key[:2], key=_place) - 1, -1, -1):
            if end[0] - rows[i][0] > self.calls:
                return None
            if self._timely(rows[i], end):
                return rows[i]
        return None

    def _after(self, r: int, key: tuple, end: tuple) -> tuple | None:
        """The earliest one not before ``key``."""
        rows = self.seen[r]
        for i in range(bisect.bisect_left(rows, key[:2], key=_place), len(rows)):
            if rows[i][0] - end[0] > self.calls:
                return None
            if self._timely(rows[i], end):
                return rows[i]
        return None

    def _timely(self, row: tuple, end: tuple) -> bool:
        return self.micros is None or row[2] is None or end[2] is None or abs(end[2] - row[2]) <= self.micros

    def add(self, pos: int, idx: int, at: int | None, meets: list[int]) -> bool:
        """Whether the observation completes the chain with earlier ones."""
        end = (pos, idx, at)
        for r in meets:
            bisect.insort(self.seen[r], end, key=_place)
        return any(self._in_order(end, r) if self.ordered else self._around(end, r) for r in meets)

    def _in_order(self, end: tuple, own: int) -> bool:
        low = high = end
        for r in range(own - 1, -1, -1):
            low = self._before(r, low, end)
            if low is None:
                return False
        for r in range(own + 1, len(self.seen)):
            high = self._after(r, high, end)
            if high is None:
                return False
        return high[0] - low[0] <= self.calls

    def _around(self, end: tuple, own: int) -> bool:
        """Whether all other requirements fit a window of the calls: those within its left part there, the rest in its right part."""
        far = self.calls + 1
        sides = []
        for r in range(len(self.seen)):
            if r != own:
                left, right = self._before(r, end, end), self._after(r, end, end)
                sides.append((far if left is None else end[0] - left[0], far if right is None else right[0] - end[0]))
        return any(reach + max((right for left, right in sides if left > reach), default=0) <= self.calls for reach in {0, *(left for left, _ in sides)})


#: Call positions that one task searches at once, beside those within reach of them.
LINK_BLOCK = 64


def search_links(hits: DataFrame, chains: list[dict], keys=("source_instance", "session_id"), block: int = LINK_BLOCK) -> DataFrame:
    """(keys…, chain_id, observation_id, points): observations that complete a chain whose steps stand within its number of tool calls.

    ``hits`` has the keys, observation_id, pos, idx, at (microseconds or null), and the sets rule_ids and categories. A chain is
    {id, score, categories, rule_ids, calls, order, minutes}; its requirements are the categories, then the rule ids, any
    number of them. All steps lie at or before the completing observation, in declared order by call position or in any,
    and within ``minutes`` of it where both have a time. One observation may fill several steps.

    A session is searched in blocks of call positions, each with the positions within reach of it on both sides, so a long
    session spreads over tasks and a task holds the matches of one block.
    """
    for c in chains:
        if not 0 <= c["calls"] <= MOST_LINK_CALLS:
            raise ValueError(f"links span 0 to {MOST_LINK_CALLS} calls")
    reach = max((c["calls"] for c in chains), default=0)
    names = lambda kind: sorted({n for c in chains for n in c.get(kind) or ()})
    wanted = [F.arrays_overlap(col, F.array(*[F.lit(n) for n in some])) for col, some in (("categories", names("categories")), ("rule_ids", names("rule_ids"))) if some]
    near = hits.where(wanted[0] | wanted[-1] if wanted else F.lit(False))
    blocks = F.sequence(F.floor((F.col("pos") - reach) / block), F.floor((F.col("pos") + reach) / block))
    near = near.select(*keys, F.explode(blocks).alias("_block"), "idx", "pos", "at", "observation_id", "rule_ids", "categories")
    requirements = [[("categories", n) for n in c.get("categories") or ()] + [("rule_ids", n) for n in c.get("rule_ids") or ()] for c in chains]

    def search(frames):
        now, state = None, []
        for pdf in frames:
            out = []
            for row in pdf.itertuples(index=False):
                group = tuple(row[: len(keys) + 1])
                if group != now:
                    now = group
                    state = [LinkSearch(len(r), c["calls"], c["order"] != "any", None if c.get("minutes") is None else c["minutes"] * 60 * carried.MICROS) for c, r in zip(chains, requirements, strict=True)]
                own = {"categories": set(row.categories), "rule_ids": set(row.rule_ids)}
                for c, r, s in zip(chains, requirements, state, strict=True):
                    meets = [n for n, (kind, name) in enumerate(r) if name in own[kind]]
                    if meets and s.add(int(row.pos), int(row.idx), None if pd.isna(row.at) else int(row.at), meets) and row.pos // block == group[-1]:
                        out.append((*now[:-1], c["id"], row.observation_id, c["score"]))
            yield pd.DataFrame(out, columns=[*keys, "chain_id", "observation_id", "points"])

    kinds = {f.name: f.dataType.simpleString() for f in hits.schema}
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "chain_id string", f"observation_id {kinds['observation_id']}", "points long"])
    # null keys can't be told from each other by equality in Python; such rows have no session and link to nothing
    held = near.where(" and ".join(f"{k} is not null" for k in keys))
    return held.repartition(*keys, "_block").sortWithinPartitions(*keys, "_block", "idx").mapInPandas(search, schema)


def linked_chains(steps: DataFrame, chain_id: str, order: list[str], calls: int, ordered: bool = True, minutes: int | None = None, keys=("source_instance", "session_id"), score: int = 0) -> DataFrame:
    """(keys…, chain_id, observation_id): rows that complete the steps in ``order`` within ``calls`` tool calls; any number of steps.

    ``steps`` has step, pos, observation_id and epoch, a timestamp or seconds, and idx, the place in the session, else rows
    count in order of epoch and id. One observation may be several steps.
    """
    if "idx" in steps.columns:
        idx = F.col("idx")
    else:
        idx = F.dense_rank().over(W.partitionBy(*keys).orderBy("epoch", "observation_id"))
    rows = steps.where(F.col("step").isin(*order)).withColumn("idx", idx)
    hits = rows.groupBy(*keys, "observation_id", "pos", "idx", carried.micros(steps, "epoch").alias("at")).agg(F.collect_set("step").alias("rule_ids")).withColumn("categories", F.array().cast("array<string>"))
    chain = {"id": chain_id, "score": score, "rule_ids": order, "calls": calls, "order": "declared" if ordered else "any", "minutes": minutes}
    return search_links(hits, [chain], keys).select(*keys, "chain_id", "observation_id")


def linked_chain_table(matches: DataFrame, positions: DataFrame, rules: DataFrame, chain_rows, keys=("source_instance", "session_id")) -> DataFrame:
    """(keys…, chain_id, observation_id, points) of every chain with a link in ``chain_rows``, all searched in one pass.

    ``matches`` has rule_id and observation_id, ``positions`` is :func:`call_positions`, ``rules`` a dimension of some hundred rows.
    """
    chains = [{"id": i, "score": score, "categories": categories, "rule_ids": rule_ids, "calls": link[0], "order": link[1], "minutes": link[2]} for i, score, categories, rule_ids, link, *_ in chain_rows if link]
    at = positions.select(*keys, "observation_id", "pos", "idx", F.unix_micros("occurred_at").alias("at"))
    hits = matches.select(*keys, "observation_id", "rule_id").distinct().join(sendable(rules.select("rule_id", "category")), "rule_id").join(at, [*keys, "observation_id"])
    hits = hits.groupBy(*keys, "observation_id", "pos", "idx", "at").agg(F.collect_set("rule_id").alias("rule_ids"), F.collect_set("category").alias("categories"))
    return search_links(hits, chains, keys)


class ChainSearch:
    """What one session's steps within the window say, in order of time; finds the chains that a step completes.

    Going back from the completing observation, each step takes the latest one before that fits and is no later in time;
    the first step also must not have served before. Only observations inside the window are kept.
    """

    def __init__(self, order: list[str], window: int, history=()):
        self.order, self.window, self.history = order, window, [list(h) for h in history]  # [epoch, steps, used]

    def add(self, epoch: int, steps: set) -> int | None:
        """The start's epoch if the observation completes a chain, else None."""
        self.history = [h for h in self.history if epoch - h[0] <= self.window]
        self.history.append([epoch, set(steps), False])
        if self.order[-1] not in steps:
            return None
        left = len(self.order) - 1
        for at in range(len(self.history) - 1, -1, -1):
            own = self.history[at]
            if self.order[left] in own[1] and not (left == 0 and own[2]):
                if left == 0:
                    own[2] = True
                    return own[0]
                left -= 1
        return None


#: Columns that order a session's rows of one time, as far as there are any: place in the source, place in the record, id.
SESSION_TIES = ("source_sequence", "child_ordinal", "observation_id")


def action_chains(steps: DataFrame, chain_id: str, order: list[str], window: int = CHAIN_WINDOW, keys=("source_instance", "session_id")) -> DataFrame:
    """(keys…, chain_id, start_epoch, end_epoch, observation_id): the steps in order within ``window`` seconds, ending at the completing row.

    ``steps`` has step, epoch, a timestamp or seconds with fractions, and observation_id; source_sequence and child_ordinal, if
    there, order the rows of one time as in :func:`session_window`. Rows without a time or a session take no part. Each start
    serves once. Sessions come sorted through their partitions, and only what lies within the window is held of one, however long it is.
    """
    usable = steps.where(F.col("epoch").isNotNull() & F.col(keys[-1]).isNotNull() & F.col("step").isin(*order))
    ties = [c for c in SESSION_TIES if c in steps.columns]
    usable = usable.groupBy(*keys, carried.micros(steps, "epoch").alias("_at"), *ties).agg(F.collect_set("step").alias("steps"))
    sort = [*keys, "_at", *ties]

    def search(frames):
        now, state = None, None
        for pdf in frames:
            out = []
            for row in pdf[[*sort, "steps"]].itertuples(index=False):
                if tuple(row[: len(keys)]) != now:
                    now, state = tuple(row[: len(keys)]), ChainSearch(order, window * carried.MICROS)
                start = state.add(row[len(keys)], set(row[-1]))
                if start is not None:
                    out.append((*now, chain_id, start, row[len(keys)], row[-2]))
            yield pd.DataFrame(out, columns=[*keys, "chain_id", "_start", "_end", "observation_id"])

    kinds = {f.name: f.dataType.simpleString() for f in steps.schema}
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "chain_id string", "_start long", "_end long", f"observation_id {kinds['observation_id']}"])
    found = usable.repartition(*keys).sortWithinPartitions(*keys, "_at", *[F.asc_nulls_first(c) for c in ties]).mapInPandas(search, schema)
    return found.select(*keys, "chain_id", carried.as_given(steps, "epoch", F.col("_start")).alias("start_epoch"), carried.as_given(steps, "epoch", F.col("_end")).alias("end_epoch"), "observation_id")


def context_window(obs: DataFrame, anchors: DataFrame, before: int, after: int) -> DataFrame:
    """(anchor_id, idx, observation_id): rows around each anchor observation of the same session, by place, the anchor included."""
    rows = timeline_index(obs).select("source_instance", "session_id", "idx", "observation_id")
    at = rows.join(anchors.select("observation_id").distinct(), "observation_id", "left_semi").select("source_instance", "session_id", F.col("observation_id").alias("anchor_id"), F.explode(F.sequence(F.col("idx") - before, F.col("idx") + after)).alias("idx"))
    return at.join(rows, ["source_instance", "session_id", "idx"]).select("anchor_id", "idx", "observation_id")


def correlate_sessions(events: DataFrame, window: int = CORRELATION_WINDOW, least_risk: int = CORRELATION_RISK, least_sessions: int = CORRELATION_SESSIONS) -> DataFrame:
    """Detections of one actor that share a rule in at least ``least_sessions`` sessions within ``window`` seconds.

    For each actor and rule the window with most detections counts, the earliest of equals; windows of one actor over the same
    sessions are one row: client, agent, model, provider, session_ids, rule_ids, window_start, window_end, risk_score.

    A detection adds one at its second and takes it back when it leaves the window, so the number in a window is a running
    sum. Sums go through buckets of time, and no task holds more than the seconds of one bucket, or one number a bucket, of a key.
    """
    actor = ["client", "agent", "model", "provider"]
    key = [*actor, "rule_id"]
    bucket = lambda at: F.floor(at / CORRELATION_BUCKET).cast("long")
    rows = events.where((F.col("event_type") == "detection") & (F.col("risk_score") >= least_risk) & F.col("event_time").isNotNull() & F.col("session_id").isNotNull())
    rows = rows.select(*actor, F.explode(F.array_distinct("rule_ids")).alias("rule_id"), F.col("event_time").cast("long").alias("at"), "session_id", "event_id", "risk_score").where("rule_id is not null")
    change = lambda at, by: F.struct(at.alias("at"), F.lit(by).cast("long").alias("by"))
    moves = rows.select(*key, F.explode(F.array(change(F.col("at"), 1), change(F.col("at") + window + 1, -1))).alias("c"))
    moves = moves.groupBy(*key, "c.at").agg(F.sum("c.by").alias("by"), F.max(F.col("c.by") > 0).alias("seen")).withColumn("bucket", bucket(F.col("at")))

    def met(columns: list[str]) -> Column:
        return reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns])

    sums = moves.groupBy(*key, "bucket").agg(F.sum("by").alias("by"))
    earlier = W.partitionBy(*key).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select(*[F.col(c).alias(f"_{c}") for c in (*key, "bucket")], F.coalesce(F.sum("by").over(earlier), F.lit(0)).alias("before"))
    own = W.partitionBy(*key, "bucket").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    counted = moves.withColumn("n", F.sum("by").over(own)).where("seen").join(before, met([*key, "bucket"]))
    top = counted.groupBy(*key).agg(F.max(F.struct(F.expr("n + before").alias("n"), (-F.col("at")).alias("end"))).alias("most"))
    top = top.select(*[F.col(c).alias(f"_{c}") for c in key], (-F.col("most.end")).alias("_end"))
    top = top.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("_end") - window), bucket(F.col("_end")))))
    inside = rows.withColumn("bucket", bucket(F.col("at"))).join(top, met([*key, "bucket"]) & F.col("at").between(F.col("_end") - window, F.col("_end")))
    inside = inside.groupBy(*key, "session_id").agg(F.min("at").alias("start"), F.max("at").alias("end"), F.max("risk_score").alias("risk"), F.collect_set("event_id").alias("ids"))
    inside = inside.groupBy(*key).agg(F.array_sort(F.collect_list("session_id")).alias("session_ids"), F.min("start").alias("start"), F.max("end").alias("end"), F.max("risk").alias("risk"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
    merged = inside.where(F.size("session_ids") >= least_sessions).groupBy(*actor, "session_ids").agg(
        F.array_sort(F.collect_set("rule_id")).alias("rule_ids"), F.timestamp_seconds(F.min("start")).alias("window_start"), F.timestamp_seconds(F.max("end")).alias("window_end"),
        F.max("risk").alias("risk_score"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("related_event_ids"))
    return merged


def suppress_repeats(df: DataFrame, keys: list[str], at: str = "epoch", window: int = REPEAT_WINDOW, order: tuple[str, ...] = ()) -> DataFrame:
    """First rows of each key and their repeats' number: a repeat within ``window`` seconds of its anchor, edge included, collapses into it.

    The window starts at the anchor, not at the last repeat. ``at`` is a timestamp or seconds, of which fractions count to
    the microsecond. Rows with a null key or time are kept as they are. A key's times are spread over parts of bounded size
    (:func:`~sessionlens.operators.carried.anchored_repeats`), whatever their number.
    """
    known = F.col(at).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    # rows of one time are counted before they meet, so what is sorted grows with a key's different times only
    t = carried.micros(df, at)
    seen = df.where(known).groupBy(*keys, t.alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    anchors = carried.anchored_repeats(seen, keys, window * carried.MICROS)
    first = df.where(known).withColumn("_t", t)
    # of equal times one row stays: the least by ``order``, found by a partial minimum and not by a sort of the key
    columns = [c for c in df.columns if c not in keys]
    firsts = first.groupBy(*keys, "_t").agg(F.min_by(F.struct(*columns), F.struct(*(order or keys))).alias("_row")).select(*keys, "_t", *[F.col("_row").getField(c).alias(c) for c in columns])
    kept = firsts.join(anchors, [*keys, "_t"]).select(*df.columns, "repeats")
    return kept.unionByName(df.where(~F.coalesce(known, F.lit(False))).withColumn("repeats", F.lit(0).cast("long")))


def correlate_sequences(df: DataFrame, sequences: list[dict], entity: str = "entity", cap: int = SEQUENCE_CAP) -> DataFrame:
    """(entity, rule_id, start_epoch, end_epoch, points): each sequence whose steps an entity takes in order within its window.

    A sequence is {id, score, window_seconds, steps: [{any_category, any_rule_id, any_child}]}. Every row anchors a search, also one that
    matches no step; a row fills one step at most; the first anchor that completes counts, once for a rule and entity. Rows are
    in order of ``epoch``, a timestamp or seconds, then ``ord``. Rules count in order of id: one whose score would lift an
    entity above ``cap`` gives no points, but its result stays.

    The first row that ends a sequence comes from one pass over parts of bounded size (:func:`~sessionlens.operators.carried.first_ends`);
    the search began at the entity's first row within the window before it, since all earlier anchors end there too or earlier.
    """
    if not sequences:
        return df.limit(0).select(entity, F.lit("").alias("rule_id"), F.col("epoch").alias("start_epoch"), F.col("epoch").alias("end_epoch"), F.lit(0).cast("long").alias("points"))
    rules = sorted(sequences, key=lambda s: s["id"])
    usable = df.where(F.col(entity).isNotNull() & F.col("epoch").isNotNull()).withColumn("at", carried.micros(df, "epoch"))

    def fits(step: dict) -> Column:
        met = F.lit(True)
        for name, column in (("any_category", "category"), ("any_rule_id", "rule_id"), ("any_child", "child")):
            if step.get(name):
                met = met & F.coalesce(F.col(column).isin(*step[name]), F.lit(False))
        return met

    masks = F.array(*[sum((F.when(fits(step), F.lit(1 << k)).otherwise(F.lit(0)) for k, step in enumerate(s["steps"])), F.lit(0)).cast("long") for s in rules])
    stepped = usable.select(entity, "at", "ord", masks.alias("masks")).where(F.exists("masks", lambda m: m > 0))
    ends = carried.first_ends(stepped, [len(s["steps"]) for s in rules], [s["window_seconds"] * carried.MICROS for s in rules], entity)
    table = df.sparkSession.createDataFrame([(n, s["id"], s["score"], s["window_seconds"] * carried.MICROS) for n, s in enumerate(rules)], "seq int, rule_id string, score long, _window long")
    ends = cut(ends.join(F.broadcast(table), "seq").select(F.col(entity).alias("_entity"), "seq", "rule_id", "score", F.col("at").alias("_end"), (F.col("at") - F.col("_window")).alias("_from")))
    starts = usable.select(entity, "at").join(ends, (F.col(entity) == F.col("_entity")) & F.col("at").between(F.col("_from"), F.col("_end")))
    found = starts.groupBy("_entity", "seq", "rule_id", "score", "_end").agg(F.min("at").alias("_start"))
    # an entity has one row a sequence at most
    per = found.groupBy("_entity").agg(F.array_sort(F.collect_list(F.struct("seq", "rule_id", "score", "_start", "_end"))).alias("_found"))
    kind = "array<struct<rule_id:string,start:bigint,end:bigint,points:bigint>>"
    nothing = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast(kind).alias("out"))

    def count(acc, x):
        points = F.when(acc["total"] + x["score"] > cap, F.lit(0).cast("long")).otherwise(x["score"])
        return F.struct((acc["total"] + points).alias("total"), F.concat(acc["out"], F.array(F.struct(x["rule_id"].alias("rule_id"), x["_start"].alias("start"), x["_end"].alias("end"), points.alias("points")))).alias("out"))

    out = per.select(F.col("_entity").alias(entity), F.explode(F.aggregate("_found", nothing, count, lambda acc: acc["out"])).alias("x"))
    return out.select(entity, "x.rule_id", carried.as_given(df, "epoch", F.col("x.start")).alias("start_epoch"), carried.as_given(df, "epoch", F.col("x.end")).alias("end_epoch"), "x.points")


def download_execute(artifacts: DataFrame, executed: DataFrame, window: int = CHAIN_WINDOW) -> DataFrame:
    """(session, download, execution, artifact): a downloaded file run later in the session, or later in the same command, within ``window`` seconds.

    Both have source_instance, session_id, observation_id, idx, epoch and stage_no. Each download links once, to its earliest run; rows without a time or session don't link.
    """
    a = artifacts.where("session_id is not null and epoch is not null").select("source_instance", "session_id", "artifact", F.col("observation_id").alias("download"), F.col("idx").alias("d_idx"), F.col("stage_no").alias("d_stage"), F.col("epoch").alias("d_epoch"))
    e = executed.where("session_id is not null and epoch is not null").select("source_instance", "session_id", F.col("executed").alias("artifact"), F.col("observation_id").alias("execution"), "idx", "stage_no", "epoch")
    pairs = a.join(e, ["source_instance", "session_id", "artifact"]).where("(idx > d_idx or (idx = d_idx and stage_no > d_stage)) and epoch - d_epoch between 0 and " + str(window))
    first = W.partitionBy("source_instance", "session_id", "download", "artifact").orderBy("idx", "stage_no")
    return pairs.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").select("source_instance", "session_id", "download", "execution", "artifact")


def armed_sessions(linked: DataFrame, piped: DataFrame) -> DataFrame:
    """Sessions with a downloaded file that was run, or a download piped into an interpreter."""
    keys = ["source_instance", "session_id"]
    return linked.select(*keys).unionByName(piped.select(*keys)).distinct()
