"""Connected components by alternating large-star and small-star steps over a table of links.

Links never reach the driver: each round is one job that is written to the shared folder, and the
driver sees only a count and a checksum. A link is kept as (child, parent) with parent < child, so
the smallest member of a component ends up as the parent of all others, and no step groups by that
hub: its many links stand on the streamed side of a join that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangescan.llm.common import cut, discard


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("child", "parent").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(pairs: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(child, parent): for every id in ``pairs`` but the smallest of its component, that smallest id.

    Nulls and self-links are ignored; repeated links count once; an empty table gives an empty table.
    """
    links = pairs.select(F.greatest(a, b).alias("child"), F.least(a, b).alias("parent")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("child") != F.col("parent")))
    links = cut(links.distinct(), "links")
    seen = _state(links)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        low = links.groupBy(F.col("child").alias("node")).agg(F.min("parent").alias("low"))
        # large-star: the parent of a link gives way to its own smallest parent
        far = links.join(low, links.parent == low.node, "left").select("child", F.coalesce("low", "parent").alias("parent"))
        # small-star: all parents of a child hang below the smallest of them
        least = far.groupBy(F.col("child").alias("node")).agg(F.min("parent").alias("low"))
        near = far.join(least, far.child == least.node).select("child", "parent", "low")
        moved = near.where("parent <> low").select(F.col("parent").alias("child"), F.col("low").alias("parent"))
        before, links = links, cut(near.select("child", F.col("low").alias("parent")).union(moved).distinct(), "links")
        discard(before)
        now = _state(links)
        if now == seen:
            return links
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return links
