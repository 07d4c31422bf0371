"""Untrusted windows to components, and components to regions of suspect bases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def components(positions: DataFrame, k: int, *keep: str) -> DataFrame:
    """(read_id, *keep, component, starts): runs of untrusted starts that overlap.

    A run ends where the next window begins behind the end of the last one.
    `keep` are columns that depend on the read only.
    """
    by = Window.partitionBy("read_id").orderBy("pos")
    gap = F.lag("pos").over(by) + (k - 1) < F.col("pos")
    rows = positions.withColumn("__new", F.coalesce(gap, F.lit(False)).cast("int"))
    rows = rows.withColumn("component", F.sum("__new").over(by).cast("int"))
    return rows.groupBy("read_id", *keep, "component").agg(F.array_sort(F.collect_list("pos")).alias("starts"))


def with_core(comps: DataFrame, k: int) -> DataFrame:
    """comps with intersect (empty array if the windows share no base), union_, and core.

    The core is the intersection if there is one, else the union, which is one
    range, as each window of a component overlaps the next.
    """
    first, last = "starts[0]", "starts[size(starts) - 1]"
    return comps.withColumns({
        "intersect": F.expr(f"IF({last} <= {first} + {k - 1}, sequence({last}, {first} + {k - 1}), CAST(array() AS ARRAY<INT>))"),
        "union_": F.expr(f"sequence({first}, {last} + {k - 1})"),
    }).withColumn("core", F.expr("IF(size(intersect) > 0, intersect, union_)"))


def _down(upto: str) -> str:
    return f"IF({upto} > 0, sequence({upto} - 1, 0), CAST(array() AS ARRAY<INT>))"


def _up(after: str) -> str:
    return f"IF({after} + 1 <= trim_len - 1, sequence({after} + 1, trim_len - 1), CAST(array() AS ARRAY<INT>))"


def error_region(comps: DataFrame, k: int) -> DataFrame:
    """comps (with core and trim_len) with region: the core, extended to an end that a window of it reaches.

    The order counts: core first, then to the 5' end, then to the 3' end.
    """
    front, back = "core[0]", "core[size(core) - 1]"
    none = "CAST(array() AS ARRAY<INT>)"
    return comps.withColumn("region", F.expr(f"concat(core, IF({k - 1} >= {front}, {_down(front)}, {none}), IF(trim_len - {k} <= {back}, {_up(back)}, {none}))"))


def error_region_chop(comps: DataFrame, k: int) -> DataFrame:
    """comps (with core, trim_len and probs) with chopped: the core without bases that the
    trusted windows next to it vouch for.

    One base before the core comes back if it is doubtful (below .99) or no
    better than the next.  Where there is no window on a side, the region
    extends to that end.  A core that the chopping empties stays empty, and
    each base occurs once.
    """
    first, last = "starts[0]", "starts[size(starts) - 1]"
    rows = comps.withColumn("__cut", F.expr(f"IF({first} > 0, filter(core, i -> i > {first} + {k - 2}), core)"))
    doubtful = "__cut[0] > 0 AND (probs[__cut[0] - 1] < 0.99D OR probs[__cut[0] - 1] <= probs[__cut[0]])"
    rows = rows.withColumn("__front", F.expr(
        f"CASE WHEN size(__cut) = 0 THEN __cut WHEN {first} > 0 THEN IF({doubtful}, concat(array(__cut[0] - 1), __cut), __cut) ELSE concat(__cut, {_down('__cut[0]')}) END"
    ))
    back = f"CASE WHEN size(__front) = 0 THEN __front WHEN {last} + {k} < trim_len THEN filter(__front, i -> i < {last} + 1) ELSE concat(__front, {_up('array_max(__front)')}) END"
    return rows.withColumn("chopped", F.expr(back)).drop("__cut", "__front")
