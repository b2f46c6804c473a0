"""Cohort retention, kept up to date by signed deltas.

A client's start is its earliest known click of kind error; its clicks from there on fall into periods of a week. ``state`` builds the
contributions of one state, a row for each client and period, and ``cells`` sums them. ``deltas`` reads late clicks: clients whose
start they move have their old contributions retracted (sign -1) and are added again under the new start from all that is known of
them; the late clicks of all others are increments. ``apply`` turns deltas into changes of cells: a client counts in a cell while its
number of clicks there is above zero, so users come and go where that number leaves or reaches zero. State 1 is state 0's cells plus
those changes, and no client that late rows leave alone is read again.

Clicks meet their client's start by ``meet``: the starts of the few clients that hold more than a thousandth of the clicks are
broadcast (fewer than a thousand rows), the others meet by a shuffle. After that, rows are one for each client and period.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import meet, stored

CUTOFF = datetime.datetime(2024, 2, 1)
START_KIND = "error"
DAY_US = 86_400_000_000
NEEDED = ("click_id", "ts", "arrived_at", "client_id", "kind", "value")


def micros(when: Column) -> Column:
    """Microseconds since 1970 of the wall clock time as it stands, whatever the session's zone."""
    t = when.cast("timestamp_ntz")
    seconds = (F.hour(t) * 3600 + F.minute(t) * 60).cast("long")
    return F.unix_date(t.cast("date")).cast("long") * DAY_US + seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), t) * 1_000_000).cast("long")


def events(clicks: DataFrame, cutoff: datetime.datetime = CUTOFF) -> DataFrame:
    """(client_id, ts, late, start, cents): distinct rows with a time and a client; ts in microseconds, late if unknown before cutoff.

    Rows are equal if all columns are; those beside the needed ones take part by a hash, which only has to tell apart rows that agree
    in all the others. A click without click_id arrives when it arrived; one without arrived_at is late. Values that are null or not
    finite are 0 cents.
    """
    needed = {c.lower() for c in NEEDED}
    others = [F.to_json(F.struct(F.col(f"`{c}`"))) if t.startswith(("map", "struct", "array", "variant")) else F.col(f"`{c}`") for c, t in clicks.dtypes if c.lower() not in needed]
    rest = F.xxhash64(*others, *[c.isNull() for c in others]) if others else F.lit(0).cast("long")
    once = clicks.filter("ts IS NOT NULL AND client_id IS NOT NULL").select(*NEEDED, rest.alias("rest")).distinct()
    h = F.crc32(F.col("click_id").cast("string"))
    shift = F.when(h % 3 == 0, h % 100).otherwise(0) * DAY_US
    arrives = micros(F.col("arrived_at")) + F.coalesce(shift, F.lit(0))
    x = F.col("value").cast("double") * 100 + 0.5
    return once.select(
        F.col("client_id").cast("long").alias("client_id"),
        micros(F.col("ts")).alias("ts"),
        F.coalesce(arrives >= F.lit(_us(cutoff)), F.lit(True)).alias("late"),
        F.coalesce(F.col("kind") == START_KIND, F.lit(False)).alias("start"),
        F.when(F.abs(x) < 9e18, F.floor(x)).otherwise(0).cast("long").alias("cents"),
    )


def _us(when: datetime.datetime) -> int:
    return (when - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1)


def starts(rows: DataFrame) -> DataFrame:
    """(client_id, start, n): the earliest start of each client, null where it has none, and its number of rows."""
    return rows.groupBy("client_id").agg(F.min(F.when(F.col("start"), F.col("ts"))).alias("start"), F.count("*").alias("n"))


def segments(clients: DataFrame) -> DataFrame:
    """(client_id, segment): the source of each client, of several the least; '' where it has none."""
    known = clients.select(F.col("client_id").cast("long").alias("client_id"), "source").filter("client_id IS NOT NULL")
    return known.groupBy("client_id").agg(F.coalesce(F.min("source"), F.lit("")).alias("segment"))


def _cohort(start: str) -> Column:
    return _div(_div(F.col(start), DAY_US), 7)


def _div(a: Column, by: int) -> Column:
    """a / by, rounded down, on integers."""
    by = F.lit(by).cast("long")
    return F.call_function("div", a - F.pmod(a, by), by)


def contributions(rows: DataFrame, people: DataFrame, total: int) -> DataFrame:
    """(client_id, segment, cohort, period, clicks, cents): what rows from the start on give, a row for each client and period.

    people: (client_id, start, segment, n, ...), n being how many of the `total` rows a client has; its other columns are kept.
    """
    kept = [c for c in people.columns if c not in ("start", "n")]
    joined = meet(rows.select("client_id", "ts", "cents"), people, "client_id", "n", total, hint="merge").filter("ts >= start")
    placed = joined.select(*kept, _cohort("start").alias("cohort"), _div(F.col("ts") - F.col("start"), 7 * DAY_US).alias("period"), "cents")
    return placed.groupBy(*kept, "cohort", "period").agg(F.count("*").alias("clicks"), F.try_sum("cents").alias("cents"))


def cells(parts: DataFrame) -> DataFrame:
    """Contributions as cells: each row of parts is another client of its cell."""
    crc = F.crc32(F.col("client_id").cast("string"))
    return parts.groupBy("segment", "cohort", "period").agg(F.count("*").alias("users"), F.sum(crc).alias("users_crc32"), F.try_sum("cents").alias("cents"))


def deltas(state0: DataFrame, people0: DataFrame, late: DataFrame, known: DataFrame, named: DataFrame) -> DataFrame:
    """Signed contributions that lead from state 0 to state 1: those of state0's columns, with sign and moved.

    people0: (client_id, start, n) of the early rows; late: the late rows; known: all rows; named: (client_id, segment).
    moved: the client has a start in both states and these lie in different cohorts.
    """
    fresh_starts = starts(late).select("client_id", F.col("start").alias("late_start"), F.col("n").alias("n_late"))
    both = people0.select("client_id", F.col("start").alias("start0"), "n").hint("merge").join(fresh_starts, "client_id", "right")
    after = both.withColumn("start", F.least("start0", "late_start")).filter("start IS NOT NULL")
    after = after.join(named.hint("merge"), "client_id", "left").withColumn("segment", F.coalesce("segment", F.lit("")))
    moved = F.coalesce(_cohort("start0") != _cohort("start"), F.lit(False))
    after = stored(after.select("client_id", "segment", "start", "start0", F.coalesce("n", F.lit(0)).alias("n_early"), "n_late", moved.alias("moved")), "cohort-after")
    shifted, same = after.filter("start0 IS NULL OR start < start0"), after.filter("start = start0")
    retracted = state0.join(shifted.filter("start0 IS NOT NULL").select("client_id", "moved").hint("merge"), "client_id")
    again = contributions(known, shifted.select("client_id", "segment", "start", (F.col("n_early") + F.col("n_late")).alias("n"), "moved"), known.count())
    more = contributions(late, same.select("client_id", "segment", "start", F.col("n_late").alias("n"), "moved"), late.count())
    columns = ["client_id", "segment", "cohort", "period", "clicks", "cents", "moved"]
    signed = [(retracted, -1), (again, 1), (more, 1)]
    parts = [d.select(*columns).withColumn("sign", F.lit(s)) for d, s in signed]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def apply(state0: DataFrame, changes: DataFrame) -> DataFrame:
    """(segment, cohort, period, users, users_crc32, cents, moved): by how much the changes alter each cell."""
    key = ["client_id", "segment", "cohort", "period"]
    touched = changes.groupBy(*key).agg(
        F.sum(F.col("sign") * F.col("clicks")).alias("more"),
        F.try_sum(F.col("sign") * F.col("cents")).alias("cents"),
        F.max(F.when(F.col("sign") > 0, F.col("moved")).otherwise(False)).alias("moved"),
    )
    base = state0.select("client_id", "cohort", "period", "clicks")
    met = touched.join(base.hint("merge"), ["client_id", "cohort", "period"], "left").withColumn("had", F.coalesce("clicks", F.lit(0)))
    flip = ((F.col("had") + F.col("more")) > 0).cast("long") - (F.col("had") > 0).cast("long")
    crc = F.crc32(F.col("client_id").cast("string"))
    return met.groupBy("segment", "cohort", "period").agg(
        F.sum(flip).alias("users"), F.sum(flip * crc).alias("users_crc32"), F.try_sum("cents").alias("cents"), F.sum(F.col("moved").cast("long")).alias("moved")
    )


def retention(clicks: DataFrame, clients: DataFrame, cutoff: datetime.datetime = CUTOFF) -> DataFrame:
    """(state, segment, cohort, period, users, users_crc32, moved, cents): one row for each cell that has a user.

    Equal rows of clicks count once; rows without a time or a client don't count. A client without a start has no cell. Clients that
    the second table doesn't know, or whose source is null, have segment ''; of several rows of a client the least source counts.
    Clicks at the same microsecond as the start belong to period 0. Sums of cents beyond a long are null. Empty tables give no rows;
    other columns of clicks only tell rows apart, those of clients play no part.
    """
    known = stored(events(clicks, cutoff), "cohort-clicks")
    early, late = known.filter("NOT late"), known.filter("late")
    named = segments(clients)
    people0 = stored(starts(early), "cohort-people")
    begun = people0.filter("start IS NOT NULL").join(named.hint("merge"), "client_id", "left").withColumn("segment", F.coalesce("segment", F.lit("")))
    state0 = stored(contributions(early, begun, early.count()), "cohort-state0")
    cells0 = cells(state0)
    changes = stored(deltas(state0, people0, late, known, named), "cohort-deltas")
    place = ["segment", "cohort", "period"]
    left = changes.filter("sign < 0 AND moved").groupBy(*place).agg(F.count("*").alias("moved"))
    first = cells0.join(left, place, "left").withColumn("moved", F.coalesce("moved", F.lit(0)))
    both = cells0.withColumn("moved", F.lit(0).cast("long")).unionByName(apply(state0, changes))
    sums = [F.sum("users").alias("users"), F.sum("users_crc32").alias("users_crc32"), F.sum("moved").alias("moved"), F.try_sum("cents").alias("cents")]
    second = both.groupBy(*place).agg(*sums).filter("users > 0")
    columns = [*place, "users", "users_crc32", "moved", "cents"]
    return first.select(F.lit(0).alias("state"), *columns).unionByName(second.select(F.lit(1).alias("state"), *columns))
