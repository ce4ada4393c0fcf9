"""Mixing sources to target weights along a curriculum that changes with time.

Every source has a schedule: its weight at some moments of the training, from 0 to 1, linear between
them. The integral of a source's schedule is its share of the mix. Shares become targets in words; no
source gives more than its cap, and what is above is shared again by weight among the others.

A source's demand up to a moment is its target times the part of its integral that lies before the
moment. Its documents stand in a random but fixed order, one pass after the other; where the words
before a document begin, the demand is inverted to the moment at which the document is due. Sorting
all documents by that moment gives the training order, in which the sources are mixed at every moment
as their schedules say. The last document of a source is cut where its demand ends, so that each
source gives its target to the word.

All of this is columns, joins and sums; no row leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airlock.llm.ranks import ranked
from airlock.llm.store import written

#: Weights of the sources in their order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Words of the mix, as a share of all words, and the most that a source gives, as a share of its own.
BUDGET, MOST_PASSES = 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a source that are put in order together, about; a source has at most 2 ** 16 such groups.
_GROUP_ROWS, _GROUP_BITS = 1024, 16
#: Sources that are broadcast to their documents; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000
KNOTS = "array<struct<at: double, weight: double>>"


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(_id, _source, size, _key) of every row; null texts have size 0. _key orders documents at random."""
    key = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"), size.alias("size"), key.alias("_key"))


def turning_schedules(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """sources (with their `rank`) and `knots`, a schedule whose integral is the source's weight: every
    other source comes early (its weight falls from 3/2 to 1/2 of its mean), the others late."""
    weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), ((F.col("rank") - 1) % len(weights)).cast("int"))
    knot = lambda at, w: F.struct(F.lit(at).alias("at"), w.alias("weight"))
    slope = lambda a, b: F.array(knot(0.0, weight * a), knot(1.0, weight * b))
    return sources.withColumn("knots", F.when(F.col("rank") % 2 == 1, slope(1.5, 0.5)).otherwise(slope(0.5, 1.5)))


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _area(a: Column, b: Column) -> Column:
    return (b["at"] - a["at"]) * (a["weight"] + b["weight"]) / 2


def integrated(knots: Column) -> Column:
    """Segments (at, until, weight, slope, before) of a schedule: `before` is the integral up to `at`."""
    n = F.size(knots)
    pairs = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.struct(F.get(knots, i).alias("a"), F.get(knots, i + 1).alias("b")))
    start = F.array().cast("array<struct<at: double, until: double, weight: double, slope: double, before: double, area: double>>")

    def more(done: Column, p: Column) -> Column:
        last = F.element_at(done, -1)
        before = F.when(F.size(done) > 0, last["before"] + last["area"]).otherwise(0.0)
        slope = (p["b"]["weight"] - p["a"]["weight"]) / (p["b"]["at"] - p["a"]["at"])
        item = F.struct(p["a"]["at"].alias("at"), p["b"]["at"].alias("until"), p["a"]["weight"].alias("weight"), slope.alias("slope"), before.alias("before"), _area(p["a"], p["b"]).alias("area"))
        return F.concat(done, F.array(item))

    return F.aggregate(pairs, start, more)


def share(segments: Column) -> Column:
    """The integral of the whole schedule."""
    last = F.element_at(segments, -1)
    return last["before"] + last["area"]


def due(segments: Column, demand: Column) -> Column:
    """The moment at which the integral reaches `demand`: the root of a quadratic in its segment."""

    def moment(x: Column) -> Column:
        s, rest = x["s"], x["demand"] - x["s"]["before"]
        # The stable form of the root holds for a slope of 0 as well.
        root = F.sqrt(F.greatest(s["weight"] * s["weight"] + 2 * s["slope"] * rest, F.lit(0.0)))
        return F.least(s["at"] + F.when(rest <= 0, 0.0).otherwise(2 * rest / (s["weight"] + root)), s["until"])

    inside = lambda d: F.element_at(F.filter(segments, lambda s: s["before"] <= d), -1)
    return _let(_let(demand, lambda d: F.struct(d.alias("demand"), inside(d).alias("s"))), moment)


def targets(sources: DataFrame, budget: float = BUDGET, most: float = MOST_PASSES) -> DataFrame:
    """sources (source_size, share) with `target`, in words.

    The budget is shared by weight. Sources above their cap get it, and the rest is shared among the
    others, until none is above: each round is one sum over the sources, of which the driver sees the
    common level (words for each unit of weight).
    """
    cap = F.col("source_size") * F.lit(float(most))
    level, full = 0.0, -1
    while True:
        over = cap <= F.lit(level) * F.col("share")
        row = sources.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(over, cap)).alias("capped"),
            F.sum(F.when(~over, F.col("share"))).alias("open"),
            F.count_if(over).alias("full"),
        ).first()
        if row["full"] == full or not row["open"]:
            break
        full = row["full"]
        level = (budget * row["all"] - (row["capped"] or 0.0)) / row["open"]
    rest, open_share = budget * (row["all"] or 0) - (row["capped"] or 0.0), row["open"] or 1.0
    return sources.withColumn("target", F.when(over, cap).otherwise(F.col("share") * F.lit(rest) / F.lit(open_share)))


def placed(docs: DataFrame, budget: float = BUDGET, most: int = MOST_PASSES, schedules=turning_schedules, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id_col, source_col, size, source_size, target, taken, copies) of every row of docs.

    `copies` lists (due, words) of each pass in which the mix takes words of the document, `due`
    being its place in the training, from 0 to 1. `schedules` adds `knots` to a table of sources; a
    schedule's weights are not negative, and its moments rise from 0 to 1. A null source is a source.
    Null and empty texts have no words: they take no part and have no copies. Rows that share an id
    are documents of their own. The order within a source follows from the ids alone, so reruns agree.
    An empty table gives an empty one; other columns are not read, whatever their names.
    """
    kind = docs.schema[id_col].dataType
    rows = written(sized(docs, id_col, text_col, source_col), "sized")
    sources = rows.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    sources = ranked(sources, [], [F.col("_source").isNull().asc(), F.col("_source").asc()], "sources")
    sources = schedules(sources).withColumn("segments", integrated(F.col("knots").cast(KNOTS)))
    sources = targets(written(sources.withColumn("share", share(F.col("segments"))), "shares", small=True), budget, most)
    bits = F.greatest(F.lit(0), F.least(F.lit(_GROUP_BITS), F.ceil(F.log2(F.col("_rows") / _GROUP_ROWS)).cast("int")))
    groups = F.pow(F.lit(2.0), bits).cast("long")
    sources = written(sources.select("_source", F.col("rank").alias("_no"), "source_size", "target", "share", "segments", groups.alias("_groups")), "targets", small=True)
    few = F.broadcast if sources.count() <= BROADCAST_SOURCES else lambda x: x

    # The first 32 bits of the key, cut into the source's groups, keep the order of the keys.
    group = F.shiftright(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * F.col("_groups"), 32)
    named = few(sources.select(F.col("_source").alias("_of"), "_no", "_groups"))
    dealt = rows.join(named, F.col("_source").eqNullSafe(F.col("_of"))).select("_id", "size", "_key", "_no", group.alias("_group"))
    inside = Window.partitionBy("_no", "_group").orderBy("_key", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("_no").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("_no", "_group").agg(F.sum("size").alias("_sum")).select("_no", "_group", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    begun = dealt.select("_id", "size", "_no", "_group", F.coalesce(F.sum("size").over(inside), F.lit(0)).alias("_inner"))
    begun = begun.join(bases, ["_no", "_group"]).select("_id", "size", "_no", (F.col("_inner") + F.col("_base")).alias("_start"))
    told = begun.join(few(sources.drop("_groups")), "_no")

    end = F.floor("target")
    passes = F.transform(F.sequence(F.lit(0), F.lit(int(most) - 1)), lambda p: F.col("_start") + p.cast("long") * F.col("source_size"))
    copy = lambda at: F.struct(
        due(F.col("segments"), at / F.col("target") * F.col("share")).alias("due"),
        F.least(F.greatest(end - at, F.lit(0).cast("long")), F.col("size")).alias("words"),
    )
    copies = F.filter(F.transform(F.filter(passes, lambda at: at < end), copy), lambda c: c["words"] > 0)
    result = told.withColumn("copies", copies)
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"])
    return result.select(F.col("_id").cast(kind).alias(id_col), F.col("_source").alias(source_col), "size", "source_size", "target", taken.alias("taken"), "copies")


def training_order(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, due, words), a row for each copy in the mix, sorted by the moment it is due."""
    copies = mixed.select(id_col, F.inline("copies"))
    return copies.orderBy("due", id_col)
