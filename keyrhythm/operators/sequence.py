"""Previous-row logic over long per-entity sequences, and keystrokes from raw key events.

``lag`` over one entity runs in one task. Sequences are therefore cut into time chunks: the lag is
taken inside each chunk, and the first row of a chunk takes the last row of the chunk before it
from a small table with one row per (entity, chunk).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from keyrhythm.functions.keys import hand_of
from keyrhythm.functions.numeric import all_known
from keyrhythm.operators.ranges import with_range

CHUNK = "_chunk"


def with_previous(df: DataFrame, key: str, order: Sequence[str], carried: Sequence[str],
                  chunk: Column | None = None, previous: str = "previous", position: str | None = None,
                  known: Sequence[str] = ()) -> DataFrame:
    """Add a struct of the previous row's ``carried`` columns (NULL on an entity's first row).

    ``chunk`` must never decrease along ``order``; ``order`` must be unique per entity. Without one, the
    order is cut at sampled borders, so an entity with a third of all rows gets its share of the chunks,
    and one that has them in a short time does too. Rows without an entity or a time belong to no
    sequence and are left out.
    ``position`` also adds the 1-based place of the row in its entity's sequence, and ``known`` adds
    ``last_<column>``, the last earlier value that is not NULL, of each listed column.

    Both uses of the rows read every column, so Spark shuffles them once and reads the input once;
    select the columns that are needed beforehand.
    """
    cut = with_range(df, CHUNK, order, [key, *order]) if chunk is None else df.withColumn(CHUNK, chunk)
    chunked = cut.where(all_known([key, CHUNK])).repartition(key, CHUNK)
    tail = F.struct(*carried)
    whole = F.struct(*[c for c in df.columns if c != key])
    ends = chunked.groupBy(key, CHUNK).agg(
        F.max_by(whole, F.struct(*order)).alias("_tail"), F.count("*").alias("_rows"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(f"_last_{c}") for c in known],
    )
    by_entity = Window.partitionBy(key).orderBy(CHUNK)
    earlier = by_entity.rowsBetween(Window.unboundedPreceding, -1)
    bridge = ends.select(
        key,
        CHUNK,
        F.lag(F.struct(*[F.col(f"_tail.{c}").alias(c) for c in carried])).over(by_entity).alias("_bridge"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        *[F.last(f"_last_{c}", ignorenulls=True).over(earlier).alias(f"_last_{c}") for c in known],
    )
    in_chunk = Window.partitionBy(key, CHUNK).orderBy(*order)
    out = chunked.join(bridge, [key, CHUNK]).withColumn(
        previous, F.coalesce(F.lag(tail).over(in_chunk), F.col("_bridge"))
    )
    if position:
        out = out.withColumn(position, F.row_number().over(in_chunk) + F.col("_before"))
    so_far = in_chunk.rowsBetween(Window.unboundedPreceding, -1)
    for c in known:
        last = F.coalesce(F.last(c, ignorenulls=True).over(so_far), F.col(f"_last_{c}"))
        out = out.withColumn(f"last_{c}", last)
    return out.drop(CHUNK, "_bridge", "_before", *[f"_last_{c}" for c in known])


def milliseconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(1000.0)


def latencies(df: DataFrame, key: str, ts: str, category: str, order: Sequence[str],
              chunk: Column | None = None, pairs: str = "sliding", separator: str = "") -> DataFrame:
    """Transition and elapsed time from the previous row of the same entity.

    ``pairs="sliding"`` compares every row with the one before; ``"disjoint"`` only every second
    row, so that no row is used twice. An entity's first row has no transition and is left out.
    """
    seen = with_previous(df, key, order, [ts, category], chunk, position="_at")
    if pairs == "disjoint":
        seen = seen.where(F.col("_at") % 2 == 0)
    return (
        seen.where(F.col("previous").isNotNull())
        .withColumn("direction", F.concat_ws(separator, F.col(f"previous.{category}"), F.col(category)))
        .withColumn("latency_ms", milliseconds_between(F.col(ts), F.col(f"previous.{ts}")))
        .drop("previous", "_at")
    )


def with_hold(used: DataFrame, key: str, ts: str, seq: str, code: str, action: str, chunk: Column | None) -> DataFrame:
    """Add ``hold`` to every key-up: the time since its key's first accepted down after its last up.

    A key-up whose key has no accepted down has no hold. Key-downs get NULL.
    """
    own = used.withColumn("_key", F.struct(key, code))
    seen = with_previous(own, "_key", [ts, seq], [action], chunk, "_same")
    first = (F.col(action) == "up") | F.col("_same").isNull() | (F.col(f"_same.{action}") == "up")
    timed = with_previous(seen.where(first).drop("_same"), "_key", [ts, seq], [action, ts], chunk, "_same")
    started = F.when(F.col(f"_same.{action}") == "down", F.col(f"_same.{ts}"))
    ups = timed.where(F.col(action) == "up").withColumn("hold", milliseconds_between(F.col(ts), started))
    downs = used.where(F.col(action) == "down").withColumn("hold", F.lit(None).cast("double"))
    return downs.unionByName(ups.drop("_same", "_key"))


def accepted_presses(events: DataFrame, key: str = "user_id", ts: str = "ts", seq: str = "seq",
                     code: str = "key_code", action: str = "action", chunk: Column | None = None,
                     side: str = "current") -> DataFrame:
    """Key-down and key-up events -> rows (key, down, seq, code, last_up, hold), one per press.

    A down counts only if no other down came since the last up of any key. ``last_up`` is the time of
    the last up before the press. ``side="current"``: ``hold`` is the press's own time until the first
    up, NULL if that up is another key's; a press without an up is left out. ``side="previous"``:
    ``hold`` is that of the last up before the press, NULL if that up had no accepted down.
    """
    # A person types a bounded number of keys in an hour, so an hour is a fair chunk of any typist's events.
    chunk = F.date_trunc("hour", F.col(ts)) if chunk is None else chunk
    order = [ts, seq]
    known = with_previous(events.select(key, ts, seq, code, action), key, order, [action, ts], chunk)
    down, up = F.col(action) == "down", F.col(action) == "up"
    opens = down & (F.col("previous").isNull() | (F.col(f"previous.{action}") == "up"))
    used = known.where(opens | up).withColumn("last_up", F.when(down, F.col(f"previous.{ts}"))).drop("previous")
    if side == "previous":
        timed = with_hold(used, key, ts, seq, code, action, chunk)
        paired = with_previous(timed, key, order, ["hold"], chunk)
        return paired.where(down).select(
            key, F.col(ts).alias("down"), F.col(seq).alias("seq"), F.col(code).alias("code"), "last_up",
            F.col("previous.hold").alias("hold"),
        )
    paired = with_previous(used, key, order, [action, ts, seq, code, "last_up"], chunk)
    same = F.col(f"previous.{code}") == F.col(code)
    return paired.where(up & (F.col(f"previous.{action}") == "down")).select(
        key,
        F.col(f"previous.{ts}").alias("down"),
        F.col(f"previous.{seq}").alias("seq"),
        F.col(f"previous.{code}").alias("code"),
        F.col("previous.last_up").alias("last_up"),
        F.when(same, milliseconds_between(F.col(ts), F.col(f"previous.{ts}"))).alias("hold"),
    )


def keystrokes_from_key_events(events: DataFrame, key: str = "user_id", ts: str = "ts", seq: str = "seq",
                               code: str = "key_code", action: str = "action", pairs: str = "sliding",
                               side: str = "current", chunk: Column | None = None,
                               unknown: str = "null") -> DataFrame:
    """Keystroke rows (Hand, Hold time, Direction, Latency time, Flight time) from key events.

    ``side="current"`` describes the later key of each pair, as the recorded logs do;
    ``"previous"`` gives the hand of the earlier key and the hold of the last key-up before the later
    one. Flight time runs from that last key-up, whichever key it belongs to. A key that belongs to no
    hand leaves Hand and Direction empty; with ``unknown="typed"`` it stands as ``L`` when it is the
    later key, and as the last known hand (``L`` at the start) when it is the earlier one.
    """
    presses = accepted_presses(events, key, ts, seq, code, action, chunk, side).withColumn("hand", hand_of("code"))
    by_hour = F.date_trunc("hour", F.col("down")) if chunk is None else chunk
    typed = unknown == "typed"
    seen = with_previous(presses, key, ["down", "seq"], ["down", "hand"], by_hour, position="_at",
                         known=["hand"] if typed else ())
    if pairs == "disjoint":
        seen = seen.where(F.col("_at") % 2 == 0)
    earlier = F.col("previous")
    before = F.coalesce("last_hand", F.lit("L")) if typed else earlier["hand"]
    later = F.coalesce("hand", F.lit("L")) if typed else F.col("hand")
    return seen.where(earlier.isNotNull()).select(
        key,
        F.col("down").alias("ts"),
        (before if side == "previous" else later).alias("Hand"),
        F.col("hold").alias("Hold time"),
        F.concat(before, later).alias("Direction"),
        milliseconds_between(F.col("down"), earlier["down"]).alias("Latency time"),
        milliseconds_between(F.col("down"), F.col("last_up")).alias("Flight time"),
    )
