"""Mixing sources to target weights: words a source, repetition rates, then whole copies of documents and one by chance.

A document's size is its number of words. Each source has a share of all words by its weight; a target stops at ``most`` times its
source's size, and the excess is shared again by weight until no target is above. The rate of a source is its target over its size. A
document is taken floor(rate) times, and once more if a number drawn from a hash of its id, its text and the seed lies below the
fraction. Runs with the same seed agree, whatever the partitions; a source's expected words are its target, and with documents of
sizes x and a fraction f their standard deviation is the root of f (1 - f) sum(x * x).

Only DataFrame functions are used. Sizes are summed before the exchange; sources are numbered by a range sort and kept in a written
table, so their number has no bound; documents meet their source by a broadcast of the sources that hold a large share of the
rows (of all of them where they are few), so a hot source is not gathered.

Edge cases: a null or blank text has size 0 and is taken as its source's rate says; a null source is a source of its own, the last; a
source without words has target and rate 0; rows that repeat an id and a text share one draw, other rows have their own; an empty table
gives an empty result; other columns are carried through, result names replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SMALL, join_counted, written

RESULTS = ("size", "source_size", "target", "rate", "copies")
#: Hexadecimal digits of the digest that make up a draw: 52 bits, which a double holds.
DIGITS = 13


def words_in(text: Column) -> Column:
    """Stretches without space, tab, line feed, vertical tab, form feed or return; a null text has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t-\r]+")).cast("long")


def draw(seed: int, *values: Column) -> Column:
    """A number from 0 to below 1 for a row, fixed by its values and the seed."""
    key = F.concat_ws("/", F.lit(str(seed)), *[F.coalesce(v.cast("string"), F.lit("")) for v in values])
    return F.conv(F.substring(F.md5(F.encode(key, "UTF-8")), 1, DIGITS), 16, 10).cast("long") / F.lit(float(16**DIGITS))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Adds ``ord``, from 0 in the order of unique columns: a range sort, and the number of rows in the partitions before."""
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.monotonically_increasing_id().alias("_at"))
    kept = written(sorted_)
    part, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND(2**33 - 1)
    counts = kept.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).drop("_n")  # a row for each partition
    joined = kept.withColumn("_part", part).join(F.broadcast(before), "_part")
    return joined.withColumn("ord", F.coalesce("_before", F.lit(0)) + at).drop("_part", "_at", "_before")


def targets(sources: DataFrame, weight: Column, most: int = 3) -> DataFrame:
    """``sources`` (with ``source_size``) and ``target``: shares of all words by weight, whole numbers, that stop at ``most`` times the size.

    Each round shares what the stopped targets leave; a target that once lies above its bound stays at it, as shares only grow. Shares
    follow the slope of a concave function to its root, so rounds are few.
    """
    rows = written(sources.withColumn("_w", weight.cast("long")).withColumn("_cap", F.col("source_size") * most))
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    stopped, rest, share = F.lit(False), total, None
    while True:
        taken, weights = rows.agg(F.sum(F.when(stopped, F.col("_cap")).otherwise(0)), F.sum(F.when(~stopped, F.col("_w")).otherwise(0))).first()
        if not weights:
            break
        rest, before = total - (taken or 0), share
        share = (rest, weights)
        if share == before:
            break
        stopped = F.col("_cap").cast("decimal(38,0)") * F.lit(weights) < F.col("_w").cast("decimal(20,0)") * F.lit(rest)
    own = F.lit(0.0) if share is None else (F.col("_w") * F.lit(share[0])).cast("double") / F.lit(float(share[1]))
    return rows.withColumn("target", F.when(stopped, F.col("_cap").cast("double")).otherwise(own)).drop("_w", "_cap")


def rates(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 0) -> DataFrame:
    """The columns of ``docs``, size, source_size, target and rate (of its source), copies (how often the mix takes the row).

    The weights are dealt to the sources in the order of their names by code point, null last, and again from the first.
    """
    if not weights or min(weights) <= 0 or most < 1:
        raise ValueError("weights are above 0, and a source holds at least itself")
    names = [n for n in docs.columns if n not in RESULTS]
    source = F.col(f"`{source_col}`").cast("string")
    sized = docs.select(*[F.col(f"`{n}`").alias(f"_c{i}") for i, n in enumerate(names)], words_in(F.col(f"`{text_col}`")).alias("size"), source.isNull().alias("_none"), F.coalesce(source, F.lit("")).alias("_source"))
    sums = docs.select(words_in(F.col(f"`{text_col}`")).alias("size"), source.isNull().alias("_none"), F.coalesce(source, F.lit("")).alias("_source"))
    sums = written(sums.groupBy("_none", "_source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows")))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("ord") % len(weights) + 1).cast("int"))
    known = targets(numbered(sums, "_none", "_source"), weight, most).drop("ord")
    known = written(known.withColumn("rate", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)))
    n, rows = known.agg(F.count("*"), F.sum("_rows")).first()
    on = ["_none", "_source"]
    met = sized.join(F.broadcast(known), on) if n <= SMALL else join_counted(sized, known, on, "_rows", rows or 0)
    own = {n: F.col(f"_c{i}") for i, n in enumerate(names)}
    chance = draw(seed, own.get(id_col, F.lit(None)), own.get(text_col, F.lit(None)))
    copies = F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long")
    return met.select(*[c.alias(n) for n, c in own.items()], "size", "source_size", "target", "rate", copies.alias("copies"))


def mixed(rated: DataFrame) -> DataFrame:
    """The mix: each row of ``rates`` as often as its copies say, with ``copy`` from 0."""
    some = rated.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return some.drop("copies")
