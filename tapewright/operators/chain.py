"""Hash chains over canonical JSON: appending, and verifying in parallel."""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import json
import uuid
from collections.abc import Iterator
from json.encoder import encode_basestring
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contracts import DOMAINS

#: The fields of an audit event that its digest covers.
EVENT_FIELDS = ("id", "event_type", "entity_type", "entity_id", "loan_id", "actor_id", "actor_type", "before_value", "after_value", "reason", "ai_metadata", "created_at")
#: Those of them that hold JSON, and the name under which the digest covers the previous one.
EVENT_JSON = ("before_value", "after_value", "ai_metadata")
PREV = "prev_event_hash"
#: Numbers of a chain's order that are compared in one task.
RANGE = 1 << 16


def plain_value(x: Any) -> Any:
    """A value as JSON holds it: times in UTC, decimals and other scalars as text."""
    if isinstance(x, dict):
        return {str(k): plain_value(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [plain_value(v) for v in x]
    if isinstance(x, dt.datetime):
        return (x.replace(tzinfo=dt.UTC) if x.tzinfo is None else x.astimezone(dt.UTC)).isoformat()
    if isinstance(x, dt.date):
        return x.isoformat()
    if isinstance(x, (decimal.Decimal, uuid.UUID)):
        return str(x)
    if x is None or isinstance(x, (str, int, float, bool)):
        return x
    raise TypeError(f"no canonical form for {type(x).__name__}")


_in_order = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode


def canonical_json(x: Any) -> str:
    """Keys sorted at every level, no blanks, non-ASCII as it is."""
    return _in_order(plain_value(x))


def _reordered(text: str) -> str:
    """JSON text in canonical form: what is read from JSON is plain already."""
    return _in_order(json.loads(text))


def _quoted(text: str | None) -> str:
    return "null" if text is None else encode_basestring(text)


@F.pandas_udf(T.StringType())
def canonical_text(texts: pd.Series) -> pd.Series:
    """JSON text brought into canonical form; Spark's own writer neither sorts keys nor prints doubles alike.

    Not over an iterator: of those every column has a step and a worker of its own, of these all columns share one.
    """
    told = {s: None if s is None else _reordered(s) for s in texts.unique()}  # many rows of a batch say the same
    return pd.Series([told[s] for s in texts.tolist()], dtype=object)


def event_time(at: Column) -> Column:
    """A timestamp (of a session in UTC) as the digest's text: microseconds only if there are any."""
    whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.unix_micros(at.cast("timestamp")) % 1_000_000
    return F.concat(whole, F.when(micros != 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise(""), F.lit("+00:00"))


def digest(fields: list[str], prev: Column, nested: tuple[str, ...] = (), named: str = PREV) -> Column:
    """SHA-256 of the canonical JSON of string columns, ``nested`` ones of JSON text, and the previous digest under the name ``named``."""
    keys = sorted([*fields, named])
    quoted = lambda c: F.coalesce(F.to_json(F.array(c.cast("string"))), F.lit("[null]"))
    text = lambda k: F.regexp_extract(quoted(prev if k == named else F.col(k)), r"(?s)^\[(.*)\]$", 1)
    item = lambda k: F.coalesce(canonical_text(F.col(k)), F.lit("null")) if k in nested else text(k)
    body = F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), item(k)) for k in keys))
    return F.sha2(F.concat(F.lit("{"), body, F.lit("}")), 256)


def appended(events: DataFrame, chain: list[str], order: list[str], fields: list[str], tips: DataFrame | None = None, nested: tuple[str, ...] = ()) -> DataFrame:
    """``events`` with prev_hash and hash, linked in ``order`` within each ``chain``.

    Linking is sequential by nature: each chain is folded in order by one task, which keeps
    nothing but the last digest.  ``tips`` (chain, hash) are the ends of existing chains;
    without one a chain's first event has no previous digest.  One global chain is one task's
    work.  Events with an unknown type or actor end the job.
    """
    if {"event_type", "actor_type"} <= set(fields):
        named = F.col("event_type").isin(*DOMAINS["event_type"]) & F.col("actor_type").isin(*DOMAINS["actor_type"])
        events = events.filter(F.when(named, True).otherwise(F.raise_error(F.lit("unknown event type or actor type"))))
    rows = events.join(tips.withColumnRenamed("hash", "_tip"), chain, "left") if tips is not None else events.withColumn("_tip", F.lit(None).cast("string"))
    ordered = rows.repartition(*chain).sortWithinPartitions(*chain, *order)
    keys, names = sorted([*fields, PREV]), events.columns
    place = keys.index(PREV)
    schema = ", ".join(f"`{c}` {t}" for c, t in events.dtypes) + ", prev_hash string, hash string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: Any = object()
        last: str | None = None
        for batch in batches:
            prevs, hashes = [], []
            tips = batch["_tip"].tolist()
            # all but the previous digest is brought into its form by column
            pieces = {f: [f'"{f}":' + (_quoted(x) if f not in nested else "null" if x is None else _reordered(x)) for x in batch[f"_text_{f}"].tolist()] for f in fields}
            heads, tails = ([",".join(some) for some in zip(*(pieces[k] for k in part), strict=True)] or [""] * len(batch) for part in (keys[:place], keys[place + 1 :]))
            for i, (who, head, tail) in enumerate(zip(zip(*(batch[c].tolist() for c in chain), strict=True), heads, tails, strict=True)):
                if who != at:
                    at, last = who, tips[i]
                prevs.append(last)
                text = ",".join(x for x in (head, f'"{PREV}":{_quoted(last)}', tail) if x)
                last = hashlib.sha256(f"{{{text}}}".encode()).hexdigest()
                hashes.append(last)
            yield batch[names].assign(prev_hash=prevs, hash=hashes)

    texts = ordered.select("*", *(F.col(f).cast("string").alias(f"_text_{f}") for f in fields))
    return texts.mapInPandas(run, schema)


def _packed(digest: Column) -> Column:
    """A digest as binary, equal for equal text only: half as long if it is lower-case hex of whole bytes."""
    short = F.unhex(digest)
    return F.when(F.lower(F.hex(short)) == digest, F.concat(F.unhex(F.lit("00")), short)).otherwise(F.concat(F.unhex(F.lit("01")), digest.cast("binary")))


def checked(
    events: DataFrame, chain: list[str], order: list[str], fields: list[str], prev: str = "prev_hash", own: str = "hash", nested: tuple[str, ...] = (), named: str = PREV, marks: DataFrame | None = None,
) -> DataFrame:
    """``events`` with ``problem``: "broken link", "hash mismatch" or null.

    Digests are recomputed from the stored previous one, so rows are checked in parallel;
    only the comparison with the row before needs an order.  A chain ordered by one whole
    number is cut into ranges of it, whose last digests are handed on.  Digests move as bytes.

    With ``marks`` (see ``marked``) only what came after a chain's mark is looked at: the first of
    it must name the marked digest.  Whether what lies before still stands, a check without marks tells.
    """
    marked_ = F.lit(None).cast("binary")
    if marks is not None:
        events = events.join(marks.select(*chain, F.col("at").alias("_mark"), F.col("tip").alias("_marked")), chain, "left").filter(F.col("_mark").isNull() | (F.col(order[0]) > F.col("_mark")))
        marked_ = _packed(F.col("_marked"))
    ranged = len(order) == 1 and dict(events.dtypes)[order[0]] in ("tinyint", "smallint", "int", "bigint")
    names = [c for c in events.columns if c not in ("_mark", "_marked")]
    # digests need no order: what they cover doesn't move with the rows
    wrong = ~F.col(own).eqNullSafe(digest(fields, F.col(prev), nested, named))
    part = F.floor(F.col(order[0]) / RANGE) if ranged else F.lit(0)
    rows = events.withColumns({"_wrong": wrong, "_marked": marked_, "_prev": _packed(F.col(prev)), "_own": _packed(F.col(own)), "_part": part, "_tip": F.lit(None).cast("binary"), "_row": F.lit(True)})
    given = [*names, "_wrong", "_marked", "_prev", "_own", "_part", "_tip", "_row"]
    rows = rows.select(*given)
    if ranged:
        # the last digest of a range goes before the first row of the chain's next one
        ends = rows.groupBy(*chain, "_part").agg(F.max_by("_own", F.struct(order[0])).alias("_end"))
        along = Window.partitionBy(*chain).orderBy("_part")
        ends = ends.withColumn("_tip", F.lag(F.struct("_end")).over(along)).filter("_tip is not null").select(*chain, "_part", F.col("_tip._end").alias("_tip"), F.lit(False).alias("_row"))
        kinds = {f.name: f.dataType for f in rows.schema}
        rows = rows.unionByName(ends.select(*(F.col(c) if c in ends.columns else F.lit(None).cast(kinds[c]).alias(c) for c in given)))
    along = Window.partitionBy(*chain, "_part").orderBy("_row", *order)
    before = F.lag(F.struct(F.coalesce("_tip", "_own").alias("x"))).over(along)
    rows = rows.withColumn("_before", before).filter("_row")
    linked = F.col("_prev").eqNullSafe(F.when(F.col("_before").isNull(), F.col("_marked")).otherwise(F.col("_before.x")))
    problem = F.when(~linked, "broken link").when(F.col("_wrong"), "hash mismatch")
    return rows.withColumn("problem", problem).select(*names, "problem")


def marked(events: DataFrame, chain: list[str], order: str, own: str = "hash", problems: DataFrame | None = None, marks: DataFrame | None = None) -> DataFrame:
    """Marks up to which chains are known to hold: (chain, at, tip, seen).

    ``events`` are those that were checked now, after ``marks`` if there are any.  Chains with one of
    ``problems`` keep the mark they had.
    """
    good = events if problems is None else events.join(problems.select(*chain).distinct(), chain, "left_anti")
    new = good.groupBy(*chain).agg(F.max(order).alias("at"), F.max_by(own, order).alias("tip"), F.count(F.lit(1)).alias("seen"))
    if marks is None:
        return new
    both = marks.join(new.select(*chain, *(F.col(c).alias(f"_{c}") for c in ("at", "tip", "seen"))), chain, "full")
    return both.select(*chain, F.coalesce("_at", "at").alias("at"), F.coalesce("_tip", "tip").alias("tip"), (F.coalesce("seen", F.lit(0)) + F.coalesce("_seen", F.lit(0))).alias("seen"))


def report(**problems: DataFrame) -> DataFrame:
    """One row for each named set of checked events: ok, how many problems there are, and the first of them as text.

    Each frame holds ``problem`` and what tells the place; a set is ok if none has a problem.
    """
    out = None
    for name, rows in problems.items():
        bad = rows.filter("problem is not null")
        place = F.to_json(F.struct(*bad.columns))
        one = bad.agg(F.count(F.lit(1)).alias("problems"), F.min(place).alias("first")).select(F.lit(name).alias("chain"), (F.col("problems") == 0).alias("ok"), "problems", "first")
        out = one if out is None else out.unionByName(one)
    return out


def first_break(events: DataFrame, chain: list[str], order: list[str], fields: list[str], prev: str = "prev_hash", own: str = "hash", nested: tuple[str, ...] = (), marks: DataFrame | None = None) -> DataFrame:
    """The first problem of each chain that has one."""
    bad = checked(events, chain, order, fields, prev, own, nested, marks=marks).filter("problem is not null")
    return bad.groupBy(*chain).agg(F.min_by(F.struct(*order, "problem"), F.struct(*order)).alias("x")).select(*chain, "x.*")


def intact(events: DataFrame, chain: list[str], order: list[str], fields: list[str]) -> bool:
    return first_break(events, chain, order, fields).isEmpty()


def unknown_events(events: DataFrame) -> DataFrame:
    """Events whose type or actor is not in the vocabulary: an append refuses them."""
    return events.filter(~F.col("event_type").isin(*DOMAINS["event_type"]) | ~F.col("actor_type").isin(*DOMAINS["actor_type"]))
