"""Components of links that are found by comparing the members of lists, without sending all pairs of a list anywhere.

``connect`` takes lists of members in blocks of bounded size and goes on only with what is still apart:

1. Each block meets in one task: every member is sent once for each list. The blocks of a long list share a few members, so the
   trees of its blocks mostly grow together at once.
2. Where that leaves lists with many trees, the heads of the trees (one member for each) meet, block by block.
3. Where a list still holds several trees, members outside its largest tree meet all others, block by block; ``sift`` may first tell,
   by a small sketch, which of them can have a partner in another tree.

So every two members that may be linked and are not yet connected are compared, in lists of any length, while a list whose members
are mostly connected costs about two rows a member. Only links to the smallest member of each tree leave a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SMALL, components, if_small, paired_blocks, tidy, written

LINKS = "a binary, b binary"


def in_cells(df: DataFrame) -> DataFrame:
    """Cells dealt to tasks and lying together there, under names of 96 bits."""
    named = df.withColumns({"cell_id": F.xxhash64("cell"), "cell_tag": F.hash("cell")}).drop("cell")
    return named.repartition("cell_id").sortWithinPartitions("cell_id", "cell_tag", "side")


def by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that hold whole cells, of input that comes from ``in_cells``."""
    left: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(batch.schema.get_field_index("cell_id")).to_numpy()
        end = int(np.searchsorted(ids, ids[-1]))
        if end or left and left[-1].column(batch.schema.get_field_index("cell_id"))[-1].as_py() != ids[0]:
            yield pa.Table.from_batches([*left, batch.slice(0, end)]).combine_chunks()
            left = []
        left.append(batch.slice(end))
    if left:
        yield pa.Table.from_batches(left).combine_chunks()


def bounds(table: pa.Table) -> np.ndarray:
    """Where cells begin, and the end."""
    ids, tags = table["cell_id"].to_numpy(), table["cell_tag"].to_numpy()
    return np.append(np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])])), len(ids)) if len(ids) else np.zeros(1, np.int64)


def links_batch(out: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([y for _, y in out], pa.binary())], ["a", "b"])


def parts_of(blocks: Column) -> Column:
    """A power of two, so that lists of about one length have the same blocks and their links fall together."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(blocks.cast("double"), F.lit(1.0))))).cast("long")


def block_of(parts: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64("digest", F.lit(seed)), parts.cast("long")).cast("int")


def with_trees(spots: DataFrame, linked: DataFrame) -> DataFrame:
    """Members outside all links are trees of their own."""
    return spots.join(linked.select(F.col("node").alias("digest"), F.col("root").alias("tree")), "digest", "left").withColumn("tree", F.coalesce("tree", "digest"))


def open_lists(members: DataFrame) -> DataFrame:
    """(list, n, most, largest) of lists that hold several trees: members, those of the largest tree, and its name."""
    trees = members.groupBy("list", "tree").agg(F.count("*").alias("k"))
    lists = trees.groupBy("list").agg(F.sum("k").alias("n"), F.max("k").alias("most"), F.max_by("tree", F.struct("k", "tree")).alias("largest"))
    return written(lists.where("n > most"))


def across(members: DataFrame, lists: DataFrame) -> DataFrame:
    """Cells in which members outside the largest tree of a list meet all members."""
    some = members.join(if_small(lists), "list")
    each = F.col("parts") / F.col("c")  # parts for each member
    some = some.withColumns({"_all": parts_of(F.col("n") * each).cast("int"), "_rest": parts_of((F.col("n") - F.col("most")) * each).cast("int")})
    high = some.withColumns({"low": block_of(F.col("_all"), 17), "high": F.explode(F.expr("sequence(0, _rest - 1)")), "side": F.lit(0)})
    rest = some.where("tree <> largest").withColumns({"low": F.explode(F.expr("sequence(0, _all - 1)")), "high": block_of(F.col("_rest"), 23), "side": F.lit(1)})
    return high.unionByName(rest).select(F.struct("list", "low", "high").alias("cell"), "side", F.lit(False).alias("whole"), "digest", "tree")


def shared_members(wide: DataFrame) -> DataFrame:
    """Up to six members of each long list."""
    some = F.array(F.min("digest"), F.max("digest"), *[F.min_by("digest", F.xxhash64("digest", F.lit(k))) for k in range(4)])
    picked = wide.groupBy("list").agg(F.first("parts").alias("parts"), F.array_distinct(some).alias("digest"))
    return picked.select("list", "parts", F.explode("digest").alias("digest"))


def connect(spots: DataFrame, carried: DataFrame, links: Callable, sketches: DataFrame | None = None, sift: Callable | None = None) -> DataFrame:
    """(node, root) for all members that are linked; root is the smallest one.

    ``spots``: (list, c, parts, digest), c members of a list in so many blocks. ``carried``: digest and what ``links`` compares, a function
    on batches of whole cells (side, whole, digest, tree) that gives links; ``whole`` cells compare all their members, others those of
    different sides. ``sift`` works on cells with ``sketches`` in place of ``carried`` and gives the members (digest) to go on with.
    """

    def met(cells: DataFrame) -> DataFrame:
        return written(in_cells(carried.join(cells, "digest")).mapInArrow(tidy(links), LINKS))

    def with_more(linked: DataFrame, cells: DataFrame) -> DataFrame:
        return components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(met(if_small(written(cells)))))

    own, wide = block_of(F.col("parts"), 17), spots.where("parts > 1")
    more = shared_members(wide).withColumn("block", F.explode(F.expr("sequence(0, cast(parts as int) - 1)"))).where(F.col("block") != own)
    inside = spots.select("list", "digest", own.alias("block")).unionByName(more.select("list", "digest", "block"))
    cells = inside.select(F.struct("list", F.col("block").alias("low"), F.col("block").alias("high")).alias("cell"), F.lit(0).alias("side"), F.lit(True).alias("whole"), "digest", F.lit(None).cast("binary").alias("tree"))
    linked = components(met(F.broadcast(cells) if spots.count() <= SMALL else cells))
    if wide.isEmpty():
        return linked
    linked = written(linked)
    members = written(with_trees(wide, linked).select("list", "c", "parts", "digest", "tree"))
    lists = open_lists(members)
    sent = members.join(if_small(lists), "list").select("list", "parts", "c", "n", "most").distinct().agg(F.sum(F.col("n") - F.col("most")).alias("rest"), F.sum((F.col("n") - F.col("most")) * F.col("parts")).alias("rows"), F.sum("n").alias("n")).first()
    if not sent["rest"]:
        return linked
    if sent["rows"] > 2 * sent["n"]:
        heads = members.join(if_small(lists.select("list")), "list").groupBy("list", "tree").agg(F.min("digest").alias("digest"), F.first("c").alias("c"), F.first("parts").alias("parts"))
        several = heads.groupBy("list").agg(F.count("*").alias("trees"))
        heads = paired_blocks(heads.join(several, "list"), "list", F.ceil(F.col("trees") * F.col("parts") / F.col("c")), F.col("digest"), 1)
        linked = written(with_more(linked, heads.select("cell", "side", F.expr("cell.low = cell.high").alias("whole"), "digest", "tree")))
        members = written(with_trees(wide, linked).select("list", "c", "parts", "digest", "tree"))
        lists = open_lists(members)
        if lists.isEmpty():
            return linked
    cells = across(members, lists)
    if sift is not None:
        some = written(in_cells(sketches.join(if_small(written(cells)), "digest")).mapInArrow(tidy(sift), "digest binary").distinct())
        members = members.join(if_small(some), "digest")
        lists = open_lists(members)
        if lists.isEmpty():
            return linked
        cells = across(members, lists)
    return with_more(linked, cells)
