"""Which of two events is earlier, by labels instead of a table of all pairs.

Events stand in chains, each in its own order (native streams). Every other edge is a jump. For each
place from which jumps leave, a label says per chain the earliest place that can be reached from there or
later in its chain; labels are composed with themselves, so those over n jumps take log2(n) rounds. Their
number is jumps times chains that they reach, never pairs of events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .durable import cut


def _tightest(rows: DataFrame) -> DataFrame:
    """Labels (chain, place, to_chain, earliest) that no other one from the same place or later is as good as."""
    best = rows.groupBy("chain", "place", "to_chain").agg(F.min("earliest").alias("earliest"))
    later = Window.partitionBy("chain", "to_chain").orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, -1)
    return best.withColumn("known", F.min("earliest").over(later)).filter("known is null or earliest < known").drop("known")


def labels(places: DataFrame, edges: DataFrame) -> DataFrame:
    """(chain, place, to_chain, earliest): from this place or before it, to_chain is reached at earliest and after it.

    places (event_id, chain, place) names an event's place once; an edge (src, dst) to the next place of a
    chain adds nothing to the chain's own order.
    """
    at = lambda end, chain, place: places.select(F.col("event_id").alias(end), F.col("chain").alias(chain), F.col("place").alias(place))
    jumps = edges.select("src", "dst").join(at("src", "chain", "place"), "src").join(at("dst", "to_chain", "earliest"), "dst")
    jumps = jumps.filter("chain <> to_chain or earliest <= place").select("chain", "place", "to_chain", "earliest")
    now = cut(_tightest(jumps))
    size = now.count()
    while size:
        step = now.select(F.col("chain").alias("to_chain"), F.col("place").alias("from"), F.col("to_chain").alias("end_chain"), F.col("earliest").alias("end"))
        onward = now.join(step, "to_chain").filter("from >= earliest").groupBy("chain", "place", "end_chain").agg(F.min("end").alias("earliest")).withColumnRenamed("end_chain", "to_chain")
        after = cut(_tightest(now.unionByName(onward)))
        more = after.join(now, ["chain", "place", "to_chain", "earliest"], "left_anti").isEmpty()
        now = after
        if more:
            break
    return now


def earlier(pairs: DataFrame, known: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with the column earlier: is the event at (a_chain, a_place) before the one at (b_chain, b_place)?

    Columns are named by the prefixes a and b; a null place is before nothing.
    """
    ends = pairs.select(f"{a}_chain", f"{b}_chain").distinct()
    mine = ends.join(known, (F.col("chain") == F.col(f"{a}_chain")) & (F.col("to_chain") == F.col(f"{b}_chain"))).select(f"{a}_chain", f"{b}_chain", F.struct("place", "earliest").alias("l"))
    lists = mine.groupBy(f"{a}_chain", f"{b}_chain").agg(F.sort_array(F.collect_list("l")).alias("l"))  # jumps between two chains, tightest only
    straight = (F.col(f"{a}_chain") == F.col(f"{b}_chain")) & (F.col(f"{a}_place") < F.col(f"{b}_place"))
    jump = F.exists("l", lambda x: (x.place >= F.col(f"{a}_place")) & (x.earliest <= F.col(f"{b}_place")))
    no = lambda c: F.coalesce(c, F.lit(False))
    return pairs.join(lists, [f"{a}_chain", f"{b}_chain"], "left").withColumn("earlier", no(straight) | no(jump)).drop("l")
