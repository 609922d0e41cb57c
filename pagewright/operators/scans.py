"""Smoothed rates of progress over events of jobs of any length, as a scan in blocks.

What an event does to a job's state is a map, and maps compose: it sets the beginning of a stage and the rate to nothing,
takes a share of the rate and adds to it, or leaves it. Events are numbered within their job and cut into blocks; a block's
map is folded from its events, the maps of a job's blocks one after another give the state before each block, and each
event's state is its map so far on that. A task holds a block, or one entry for each block of a job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import let, running
from pagewright.operators.pages import with_group_number

#: Fixed value: how fast the rate follows.
ALPHA = 0.3
BLOCK = 4096


def _blocks(events: DataFrame, by: str, stage: Column, done: Column, now: Column, order: list[str], carried: list[str], block: int) -> DataFrame:
    """job, block and the block's events in order: stage, done, now, and the columns carried."""
    numbered = with_group_number(events, by, order, "place")
    e = F.struct("place", stage.alias("stage"), done.cast("double").alias("done"), now.cast("double").alias("now"), *carried)
    return numbered.groupBy(F.col(by).alias("job"), F.floor((F.col("place") - 1) / block).alias("block")).agg(F.array_sort(F.collect_list(e)).alias("e"))


def _moved(events: Column, before: Column) -> Column:
    """For each event whether its stage is new, and what was done since the event before it, and in what time."""

    def seen(x, i):
        last = F.when(i == 0, before).otherwise(F.get(events, i - 1))
        new = last.isNull() | ~x["stage"].eqNullSafe(last["stage"])
        return F.struct(x["now"].alias("now"), new.alias("new"), (x["now"] - last["now"]).alias("gone"), (x["done"] - last["done"]).alias("made"))

    return F.transform(events, seen)


def _maps(moves: Column) -> Column:
    """The map from the state before the block to the state after each event: a rate r > 0 becomes share * r + more, none
    becomes fresh; begun is null while the stage goes on."""
    kinds = {"begun": None, "share": 1.0, "more": 0.0, "fresh": 0.0}
    zero = F.struct(*[F.lit(v).cast("double").alias(k) for k, v in kinds.items()])

    def step(a, x):
        inst = x["made"] / x["gone"]
        # Where share is 0 the rate before does not matter, and none is kept until something is made.
        more = F.when((a["share"] == 0) & (a["more"] <= 0), inst).otherwise(ALPHA * inst + (1 - ALPHA) * a["more"])
        fresh = F.when(a["fresh"] <= 0, inst).otherwise(ALPHA * inst + (1 - ALPHA) * a["fresh"])
        made = F.struct(a["begun"].alias("begun"), ((1 - ALPHA) * a["share"]).alias("share"), more.alias("more"), fresh.alias("fresh"))
        reset = F.struct(x["now"].alias("begun"), *[F.lit(0.0).alias(n) for n in ("share", "more", "fresh")])
        return F.when(x["new"], reset).when((x["gone"] > 0) & (x["made"] > 0), made).otherwise(a)

    return running(moves, zero, step)


def _state(of: Column, rate: Column, begun: Column) -> Column:
    """A map on a state."""
    after = F.when(rate > 0, of["share"] * rate + of["more"]).otherwise(of["fresh"])
    return F.struct(after.alias("rate"), F.coalesce(of["begun"], begun).alias("begun"))


def rates(events: DataFrame, by: str, stage: str, done: str, now: str, order: list[str], block: int = BLOCK) -> DataFrame:
    """``events`` with ``rate`` and ``begun`` (when the stage began) after each, in an order within each job.

    A stage begins with nothing done and no rate; null is a stage like any other.
    """
    carried = events.columns
    blocks = _blocks(events, by, F.col(stage), F.col(done), F.col(now), order, [F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carried)]).alias("row")], block)
    w = Window.partitionBy("job").orderBy("block")
    lasts = blocks.select("job", "block", F.struct(*[F.element_at("e", -1)[n].alias(n) for n in ("stage", "done", "now")]).alias("last"))
    befores = lasts.select(F.col("job").alias("j"), F.col("block").alias("b"), F.lag("last").over(w).alias("before"))
    met = blocks.join(befores, F.col("job").eqNullSafe(F.col("j")) & (F.col("block") == F.col("b"))).drop("j", "b")
    plain = F.transform("e", lambda x: F.struct(*[x[n].alias(n) for n in ("stage", "done", "now")]))
    mapped = met.withColumn("m", let(plain, lambda e: _maps(_moved(e, F.col("before"))))).drop("before")
    ends = mapped.groupBy("job").agg(F.array_sort(F.collect_list(F.struct("block", F.element_at("m", -1).alias("m")))).alias("s"))
    none = F.struct(F.lit(0.0).alias("rate"), F.lit(None).cast("double").alias("begun"))
    after = running(F.col("s"), none, lambda a, x: _state(x["m"], a["rate"], a["begun"]))
    states = ends.select("job", "s", after.alias("a")).select("job", F.posexplode(F.arrays_zip("s", "a")).alias("i", "x"))
    # The state after a block is the one before the next; blocks of a job are numbered from 0 without a gap.
    starts = states.select(F.col("job").alias("j"), (F.col("x.s.block") + 1).alias("b"), F.col("x.a").alias("from"))
    rows = mapped.join(starts, F.col("job").eqNullSafe(F.col("j")) & (F.col("block") == F.col("b")), "left")
    rows = rows.select("from", F.explode(F.arrays_zip("e", "m")).alias("x"))
    told = rows.select("x.e.row", _state(F.col("x.m"), F.coalesce("from.rate", F.lit(0.0)), F.col("from.begun")).alias("t"))
    return told.select(*[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(carried)], "t.rate", "t.begun")


def final_rate(events: DataFrame, by: str, stage: str, done: str, now: str) -> DataFrame:
    """The smoothed rate of each job after its last event, in order of time; of events of one time the further one is later."""
    rated = rates(events, by, stage, done, now, [now, done])
    return rated.groupBy(by).agg(F.max_by("rate", F.struct(now, done)).alias("rate"))
