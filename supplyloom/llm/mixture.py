"""Mixing sources under weight schedules that change during training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from supplyloom.llm.running import hash_buckets, running_sum
from supplyloom.sources.storage import settle

#: A word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def integrate_schedules(schedule: DataFrame) -> DataFrame:
    """Piecewise linear schedules (source, t, weight) as (source, integral, pieces).

    A piece holds its start ``t``, length ``h``, weights ``a`` and ``b`` at its
    ends and the integral ``c`` before it.  A schedule has a bounded number of
    knots, so one row per source holds it.
    """
    knots = Window.partitionBy("source").orderBy("t")
    pieces = (
        schedule.select(
            "source",
            "t",
            F.col("weight").alias("a"),
            F.lead("weight").over(knots).alias("b"),
            (F.lead("t").over(knots) - F.col("t")).alias("h"),
        )
        .filter(F.col("h") > 0)
        .withColumn("area", (F.col("a") + F.col("b")) / 2 * F.col("h"))
        .withColumn("c", F.sum("area").over(knots) - F.col("area"))
    )
    return pieces.groupBy("source").agg(
        F.sum("area").alias("integral"),
        F.sort_array(F.collect_list(F.struct("t", "h", "a", "b", "c"))).alias("pieces"),
    )


def invert_demand(pieces: Column, demand: Column) -> Column:
    """The time at which a schedule's integral reaches ``demand``."""
    piece = F.element_at(F.filter(pieces, lambda p: p["c"] <= demand), -1)
    rest = demand - piece["c"]
    slope = (piece["b"] - piece["a"]) / piece["h"]
    root = F.sqrt(F.greatest(piece["a"] * piece["a"] + 2 * slope * rest, F.lit(0.0)))
    step = F.coalesce(F.try_divide(2 * rest, piece["a"] + root), F.lit(0.0))
    return piece["t"] + F.least(step, piece["h"])


def source_targets(sizes: DataFrame, schedules: DataFrame, max_repeats: int) -> DataFrame:
    """Share the words of all sources by weight, none above its cap.

    ``sizes`` has (source, source_size).  Sources in rising order of cap per
    weight: a source is capped while its cap is below the weight's share of what
    the capped ones before it leave.  One row per source passes the window.
    """
    joined = sizes.join(
        schedules.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left"
    ).drop("_s")
    ready = joined.withColumns(
        {
            "_w": F.coalesce(F.greatest(F.col("integral"), F.lit(0.0)), F.lit(0.0)),
            "_cap": F.col("source_size").cast("double") * max_repeats,
        }
    ).withColumn("_r", F.coalesce(F.try_divide(F.col("_cap"), F.col("_w")), F.lit(float("inf"))))
    order = Window.orderBy("_r", F.col("source").asc_nulls_last())
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (
        ready.withColumns(
            {
                "_all": F.sum("source_size").over(everything).cast("double"),
                "_taken": F.sum("_cap").over(upto) - F.col("_cap"),
                "_left": F.sum("_w").over(after),
            }
        )
        .withColumn("_level", F.try_divide(F.col("_all") - F.col("_taken"), F.col("_left")))
        .withColumn("_fill", F.min(F.when(F.col("_r") >= F.col("_level"), F.struct("_r", "_level"))).over(everything))
    )
    target = F.when(
        F.col("_w") > 0,
        F.least(F.col("_cap"), F.coalesce(F.col("_fill._level") * F.col("_w"), F.col("_cap"))),
    ).otherwise(F.lit(0.0))
    return level.select("source", "source_size", target.alias("target"), "integral", "pieces")


def _closing(read: DataFrame) -> DataFrame:
    """Documents that close what the last round leaves of each source: _g, _i, _z.

    Twice the largest document that fits, then the one that comes closest.  A step
    is one aggregation; only one row per source and step is kept.
    """
    chosen = None
    gaps = read.groupBy(F.col("source").alias("_g")).agg(
        (F.first("_rest") - F.sum(F.when(F.col("_extra"), F.col("_words")).otherwise(0))).alias("_gap")
    )
    gaps = settle(gaps, "gaps")
    for room in (1, 1, 2):
        open_rows = read.filter(~F.col("_extra") & (F.col("_words") > 0))
        if chosen is not None:
            open_rows = open_rows.join(chosen, _same_document(), "left_anti")
        near = open_rows.join(gaps, F.col("source").eqNullSafe(F.col("_g")) & (F.col("_words") <= room * F.col("_gap")))
        choice = F.struct(F.abs(F.col("_words") - F.col("_gap")), F.col("_hash"), F.col("_id").alias("i"), F.col("size").alias("z"), F.col("_words").alias("w"))
        best = near.groupBy("_g").agg(F.min(choice).alias("_b"), F.first("_gap").alias("_gap"))
        best = settle(best.select("_g", F.col("_b.i").alias("_i"), F.col("_b.z").alias("_z"), (F.col("_gap") - F.col("_b.w")).alias("_left")), "closing")
        chosen = best.drop("_left") if chosen is None else chosen.unionByName(best.drop("_left"))
        left = best.select(F.col("_g").alias("_h"), "_left")
        gaps = gaps.join(left, F.col("_g").eqNullSafe(F.col("_h")), "left").select(
            "_g", F.coalesce("_left", "_gap").alias("_gap")
        )
    return chosen


def _same_document():
    return (
        F.col("source").eqNullSafe(F.col("_g")) & F.col("_id").eqNullSafe(F.col("_i")) & (F.col("size") == F.col("_z"))
    )


def curriculum(
    df: DataFrame,
    schedule: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    max_repeats: int = 3,
    rows_per_bucket: int = 10_000,
) -> DataFrame:
    """Passes and training positions of every document under the schedule.

    ``schedule`` has knots (source, t, weight); weights are linear between knots
    and a source's share is their integral.  Words are split among sources by
    share; a source gives at most ``max_repeats`` times its words.  A source's
    documents, in the order of a hash of id and size, form a stream that is read
    over and over until the target: ``passes`` is how often a document is read.
    The last, partial round takes the documents that end before the target, then
    few that close what is left.  The demand for a source's words over time is its schedule's
    integral, so inverting it at the middle of each reading gives ``positions``
    (0 to 1, rising).  Rows are range-sorted by first position, unread ones last.

    One row per (id, source, size) with its number of ``copies``: rows that agree
    in all three are read equally often.  Null texts have size 0; a document
    without words is never read.  A null source is a source; one without a
    schedule has weight 0.  An empty table gives no rows.
    """
    sized = df.select(
        F.col(id_col).alias("_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size")
    )
    rows = settle(
        sized.groupBy("_id", "source", "size")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumns(
            {"_words": F.col("size") * F.col("copies"), "_hash": F.xxhash64("_id", "size", F.lit("mix"))}
        ),
        "mixture",
    )
    sizes = rows.groupBy("source").agg(F.sum("_words").alias("source_size"))
    targets = settle(source_targets(sizes, integrate_schedules(schedule), max_repeats), "targets")
    buckets = hash_buckets(rows.count(), rows_per_bucket)
    streamed = running_sum(rows, "source", "_hash", ["_id", "size"], "_words", "_start", buckets)
    by_source = targets.withColumnRenamed("source", "_s")
    rounds = F.floor(F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0)))
    read = (
        streamed.join(by_source, F.col("source").eqNullSafe(F.col("_s")))
        .drop("_s")
        .withColumn("_rounds", rounds)
        .withColumn("_rest", F.col("target") - F.col("_rounds") * F.col("source_size"))
        .withColumn("_extra", F.col("_start") + F.col("_words") <= F.col("_rest"))
    )
    read = settle(read, "rounds")
    closing = read.join(_closing(read), _same_document(), "left")
    read = closing.withColumn("_extra", F.col("_extra") | F.col("_z").isNotNull()).drop("_g", "_i", "_z")

    passes = F.when(F.col("size") > 0, F.col("_rounds") + F.col("_extra").cast("int")).otherwise(0)
    middle = F.col("_start") + F.col("_words") / 2
    # A document that fills a gap lies beyond the rest; it is read within the last round.
    late = F.try_divide((middle - F.col("_rest")) * F.col("_rest"), F.col("source_size") - F.col("_rest"))
    last = F.when(middle <= F.col("_rest"), middle).otherwise(F.coalesce(late, middle))
    read = read.withColumn("passes", passes.cast("int")).withColumns({"_middle": middle, "_last": last})
    share = lambda turn: F.least(
        (turn * F.col("source_size") + F.when(turn < F.col("_rounds"), F.col("_middle")).otherwise(F.col("_last")))
        / F.col("target"),
        F.lit(1.0),
    )
    positions = F.transform(
        F.sequence(F.lit(0), F.col("passes") - 1),
        lambda turn: invert_demand(F.col("pieces"), share(turn) * F.col("integral")),
    )
    placed = read.withColumn("positions", F.when(F.col("passes") > 0, positions).otherwise(F.array().cast("array<double>")))
    return placed.select(
        F.col("_id").alias(id_col), "source", "size", "copies", "source_size", "target", "passes", "positions"
    ).orderBy(F.get("positions", F.lit(0)).asc_nulls_last(), "_id", "size")


def training_order(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per reading, range-sorted by training position."""
    readings = mixed.select(
        id_col, "source", "size", "copies", F.posexplode("positions").alias("reading", "position")
    )
    return readings.orderBy("position", id_col, "size", "reading")


def mix_documents(df: DataFrame, schedule: DataFrame, max_repeats: int = 3) -> DataFrame:
    """The documents as often as the mixture reads them, with their own columns.

    A document that is read twice comes twice; one that is not read is left out.
    """
    read = curriculum(df, schedule, max_repeats=max_repeats).filter("passes > 0")
    read = read.select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), "passes"
    ).withColumnRenamed("passes", "_passes")
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"),
        F.col("doc_id").alias("_d"),
        F.col("source").alias("_s"),
        word_count("text").alias("_w"),
    )
    same = (
        F.col("_d").eqNullSafe(F.col("_id"))
        & F.col("_s").eqNullSafe(F.col("_source"))
        & (F.col("_w") == F.col("_size"))
    )
    turns = rows.join(read, same).select("_row", F.explode(F.sequence(F.lit(1), F.col("_passes"))).alias("_turn"))
    return turns.select(*[F.col(f"_row.`{c}`").alias(c) for c in df.columns])


def ranked_schedule(df: DataFrame, source_col: str = "source", weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """Schedules whose integrals are the weights, dealt by source in code point order.

    Null comes last.  Odd sources start at 1.5 times their weight and end at half
    of it, even ones the other way round; one row per source passes the window.
    """
    sources = df.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("_n"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    choice = F.array(*[F.lit(float(w)) for w in weights])
    dealt = sources.select("source", rank.alias("_rank")).withColumn(
        "_w", F.get(choice, (F.col("_rank") % len(weights)).cast("int"))
    )
    tilt = F.when(F.col("_rank") % 2 == 0, F.lit(0.5)).otherwise(F.lit(-0.5))
    knot = lambda t: F.struct(F.lit(t).alias("t"), (F.col("_w") * (1 + tilt * (1 - 2 * F.lit(t)))).alias("weight"))
    return dealt.select("source", F.explode(F.array(knot(0.0), knot(0.5), knot(1.0))).alias("k")).select(
        "source", "k.t", "k.weight"
    )
