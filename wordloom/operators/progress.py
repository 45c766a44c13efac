"""Learners' records: commit of rounds, merge of replicas, logs that keep their last rows, campaigns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.plans.ordinals import with_place

#: Runs into which a key's events are cut by order, so that no row gathers them all.
_SHIFT = "struct<shift:int,low:int,high:int>"


def _then(a: Column, b: Column) -> Column:
    """The clamped shift ``b`` after ``a``: x -> min(max(x + shift, low), high) composes to one of its kind."""
    low = F.least(F.greatest(a["low"] + b["shift"], b["low"]), b["high"])
    high = F.least(F.greatest(a["high"] + b["shift"], b["low"]), b["high"])
    return F.struct((a["shift"] + b["shift"]).cast("int").alias("shift"), low.cast("int").alias("low"), high.cast("int").alias("high"))


def committed(events: DataFrame, keys: list[str], *order: str, run: int = 1000) -> DataFrame:
    """Records of each key after its events: seen, first, ever, wrong, level (0 to 3), last and t0.

    An event has ``attempts`` (0: shown, not answered), ``mastered``, ``first_try`` and ``retry``. Every event counts as
    seen. An answer on the first try sets a new item's level to 3 and raises others by one, but not in a retry round; a
    later success and a failure lower it by one. ``t0`` is the time of the first answer, if that wasn't right at once.

    A key's events are numbered in order from range partitions and cut into runs of ``run``. Each run's level steps compose to one clamped shift,
    and the runs' shifts compose in order, so a key with very many events never stands in one row.
    """
    right = F.col("mastered") & F.col("first_try")
    answered = F.col("attempts") > 0
    at = with_place(events, keys, *map(F.col, order), name="_n")
    new = F.col("_n") == 0
    # what an event does to the level
    step = F.when(~answered, 0).when(right & F.col("retry"), 0).when(right, 1).otherwise(-1)
    fixed = answered & right & ~F.col("retry") & new
    shift = F.when(fixed, F.struct(F.lit(0).alias("shift"), F.lit(3).alias("low"), F.lit(3).alias("high"))).otherwise(F.struct(step.alias("shift"), F.lit(0).alias("low"), F.lit(3).alias("high")))
    rows = at.select(*keys, "_n", F.floor(F.col("_n") / run).alias("_run"), F.col(order[0]).alias("_t"), "attempts", "mastered", "first_try", shift.alias("s"), right.alias("right"), answered.alias("answered"))
    identity = F.struct(F.lit(0).alias("shift"), F.lit(0).alias("low"), F.lit(3).alias("high")).cast(_SHIFT)
    fold = lambda c: F.aggregate(F.transform(F.array_sort(c), lambda x: x["s"]), identity, lambda a, b: _then(a, b.cast(_SHIFT)).cast(_SHIFT))
    good = F.col("answered") & F.col("mastered")
    runs = rows.groupBy(*keys, "_run").agg(
        F.count("*").alias("seen"),
        F.count_if(F.col("answered") & F.col("right")).alias("first"),
        F.count_if(good).alias("ever"),
        F.sum(F.when(F.col("answered") & ~F.col("right"), F.when(F.col("mastered"), F.greatest(F.col("attempts") - 1, F.lit(0))).otherwise(1)).otherwise(0)).alias("wrong"),
        F.max("_t").alias("last"),
        F.min(F.when(F.col("answered"), F.struct("_n", "right", "_t"))).alias("head"),
        fold(F.collect_list(F.struct("_n", "s"))).alias("s"),
    )
    whole = runs.groupBy(*keys).agg(F.sum("seen").alias("seen"), F.sum("first").alias("first"), F.sum("ever").alias("ever"), F.sum("wrong").alias("wrong"), F.max("last").alias("last"), F.min("head").alias("head"), fold(F.collect_list(F.struct("_run", "s"))).alias("s"))
    level = F.least(F.greatest(F.col("s.shift"), F.col("s.low")), F.col("s.high"))
    return whole.select(*keys, "seen", "first", "ever", "wrong", level.cast("int").alias("level"), "last", F.when(~F.col("head.right"), F.col("head._t")).alias("t0"))


def merged(local: DataFrame, remote: DataFrame, keys: list[str], now: Column, restored: DataFrame | None = None) -> DataFrame:
    """Two replicas' records as one: seen, first, ever, wrong, level, last, t0, src, sens, k0.

    Counters and k0 take the larger value, level and src the record written last (a tie: local; a side without a record has
    no say), t0 the earliest, sens the sorted union. A clock ahead of ``now`` by more than five minutes counts as that. A
    remote record that a level test wrote is left out where its key was ``restored`` and local has none.
    """
    l, r = (x.select(*keys, F.struct(*[c for c in x.columns if c not in keys]).alias(n)) for x, n in ((local, "l"), (remote, "r")))
    both = l.join(r, keys, "full_outer")
    if restored is not None:
        both = both.join(restored.select(*keys).distinct().withColumn("_back", F.lit(True)), keys, "left")
        both = both.filter(~(F.col("l").isNull() & (F.col("r.src") == "lv") & F.col("_back")) | F.col("_back").isNull() | F.col("l").isNotNull() | F.col("r.src").isNull())
    cap = now + F.expr("INTERVAL 5 MINUTES")
    # least() passes over nulls, and a side without a record must not get the cap for a clock
    la, ra = (F.when(F.col(f"{x}.last").isNotNull(), F.least(F.col(f"{x}.last"), cap)) for x in "lr")
    newer_remote = F.col("l").isNull() | (F.col("r").isNotNull() & F.coalesce(ra > la, la.isNull() & ra.isNotNull()))
    pick = lambda c: F.when(newer_remote, F.col(f"r.{c}")).otherwise(F.col(f"l.{c}"))
    none = F.array().cast("array<int>")
    sens = F.array_sort(F.array_distinct(F.concat(F.coalesce("l.sens", none), F.coalesce("r.sens", none))))
    return both.select(*keys, *[F.greatest(f"l.{c}", f"r.{c}").alias(c) for c in ("seen", "first", "ever", "wrong")], pick("level").alias("level"), F.greatest(la, ra).alias("last"), F.least("l.t0", "r.t0").alias("t0"), pick("src").alias("src"), F.when(F.size(sens) > 0, sens).alias("sens"), F.greatest("l.k0", "r.k0").alias("k0"))


def merged_sessions(local: DataFrame, remote: DataFrame, user: str, most: int = 200) -> DataFrame:
    """Rounds (rid, t, scope, total, correct) of both replicas: of equal rid the fuller, then the later one (a tie: local);
    rows without a rid once for each (t, scope, total, correct); each user's last ``most`` by time."""
    both = local.withColumn("_side", F.lit(1)).unionByName(remote.withColumn("_side", F.lit(0)))
    named = F.col("rid").isNotNull()
    key = F.when(named, F.concat(F.lit("r:"), "rid")).otherwise(F.concat_ws("|", F.lit("legacy"), "t", "scope", "total", "correct"))
    rest = [c for c in local.columns if c != user]
    once = both.withColumn("_key", key).groupBy(user, "_key").agg(F.max_by(F.struct(*rest), F.struct("total", "t", "_side")).alias("x")).select(user, "x.*", "_key")
    rn = F.row_number().over(Window.partitionBy(user).orderBy(F.desc("t"), F.desc("_key")))
    return once.withColumn("_rn", rn).filter(F.col("_rn") <= most).drop("_rn", "_key")


def ring(rows: DataFrame, order: list[str], most: int) -> DataFrame:
    """The last ``most`` rows of a log. A top-k."""
    return rows.orderBy(*[F.desc(c) for c in order]).limit(most)


def flagged(log: DataFrame, marks: DataFrame, id_: str, flag: str) -> DataFrame:
    """The log with the flags that came later, by id; rows without one keep theirs."""
    return log.join(marks.select(id_, F.col(flag).alias("_flag")), id_, "left").withColumn(flag, F.coalesce("_flag", flag)).drop("_flag")


def due(users: DataFrame, sent: DataFrame, user: str, last_seen: str, now: Column, quiet_days: int = 7, cool_days: int = 7, most: int = 4) -> DataFrame:
    """Users who may be written to: away for the quiet period, not written to within the cool-down, fewer than ``most`` times."""
    s = sent.groupBy(user).agg(F.max("sent_at").alias("_last"), F.count("*").alias("_n"))
    days = lambda c: F.floor((F.unix_micros(now) - F.unix_micros(c)) / 86_400_000_000)
    rows = users.join(s, user, "left")
    return rows.filter((days(F.col(last_seen)) >= quiet_days) & (F.col("_last").isNull() | (days(F.col("_last")) >= cool_days)) & (F.coalesce("_n", F.lit(0)) < most)).drop("_last", "_n")


def ladder(answers: DataFrame, user: str, right: str, *order: str, start: int = 3, top: int = 6, run: int = 1000) -> DataFrame:
    """The band after all of a user's answers, one up for a right one and one down for a wrong one within 1 and ``top``."""
    step = F.struct(F.when(F.col(right), 1).otherwise(-1).alias("shift"), F.lit(1).alias("low"), F.lit(top).alias("high")).cast(_SHIFT)
    rows = with_place(answers, [user], *map(F.col, order), name="_n").select(user, "_n", step.alias("s")).withColumn("_run", F.floor(F.col("_n") / run))
    identity = F.struct(F.lit(0).alias("shift"), F.lit(1).alias("low"), F.lit(top).alias("high")).cast(_SHIFT)
    fold = lambda c: F.aggregate(F.transform(F.array_sort(c), lambda x: x["s"]), identity, lambda a, b: _then(a, b).cast(_SHIFT))
    runs = rows.groupBy(user, "_run").agg(fold(F.collect_list(F.struct("_n", "s"))).alias("s"))
    whole = runs.groupBy(user).agg(fold(F.collect_list(F.struct("_run", "s"))).alias("s"))
    return whole.select(user, F.least(F.greatest(F.lit(start) + F.col("s.shift"), F.col("s.low")), F.col("s.high")).cast("int").alias("band"))
