"""Joins of the workspace.

No join here emits all pairs of a group. Hot keys (an owner or parent holding a
third of the rows) are left to AQE's skew-join splitting, which the session
helper enables; a side is broadcast only when its size is bounded by
construction (a one-row lookup or a fixed preset list).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def join_owner_filter(children: DataFrame, parents: DataFrame, child_fk: str, parent_key: str,
                      owner_col: str, owner) -> DataFrame:
    """Children whose parent belongs to ``owner``. The owner predicate is
    applied to the parents before the join (and reaches the parent scan)."""
    p = parents.where(F.col(owner_col) == F.lit(owner)).select(parent_key, owner_col)
    return children.join(p, children[child_fk] == p[parent_key], "inner").drop(parent_key)


def join_star(fact: DataFrame, dims: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Fact table joined to each dimension on (fact column, dimension key).
    Catalyst/AQE pick broadcast for a dimension under the broadcast threshold at run time."""
    out = fact
    for dim, fk, pk in dims:
        out = out.join(dim, out[fk] == dim[pk], "inner")
    return out


def join_three_hop_filter(leaf: DataFrame, hops: list[tuple[DataFrame, str, str]], predicate: Column) -> DataFrame:
    """Chain of equi joins leaf -> hop1 -> hop2 -> hop3 with a filter on the
    last hop (pushed below the joins by the optimizer)."""
    out = leaf
    for dim, fk, pk in hops:
        out = out.join(dim, out[fk] == dim[pk], "inner")
    return out.where(predicate)


def left_join_rollup(parents: DataFrame, parent_key: str, children: DataFrame, child_fk: str,
                     child_ts: str) -> DataFrame:
    """(key, n, max_ts) for every parent, n = 0 without children.
    Children are pre-aggregated to one row per key, then left-joined."""
    agg = children.groupBy(F.col(child_fk).alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.max(child_ts).alias("max_ts"))
    return (parents.select(F.col(parent_key).alias("key")).join(agg, "key", "left")
            .select("key", F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"), "max_ts"))


def left_join_optional(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left outer join on a nullable foreign key."""
    return left.join(right, key, "left")


def related_items(items: DataFrame, parent: str, id_cols: list[str], item: DataFrame) -> DataFrame:
    """The other items of the same parent as each item of ``item`` (the
    requested item(s)). ``item`` is a lookup of requested ids; items are matched
    through their parent, then the requested item itself is excluded."""
    req = item.select(*[F.col(c).alias(f"req_{c}") for c in id_cols], F.col(parent).alias("req_parent"))
    joined = items.join(req, items[parent] == req["req_parent"], "inner")
    same = F.lit(True)
    for c in id_cols:
        same = same & (F.col(c) == F.col(f"req_{c}"))
    return joined.where(~same).drop("req_parent")


def related_counts(items: DataFrame, parent: str, id_cols: list[str]) -> DataFrame:
    """J6 in bulk: for every item, how many other items share its parent.
    Group sizes are partially aggregated, then joined back (linear output)."""
    sizes = items.groupBy(parent).agg(F.count(F.lit(1)).alias("group_size"))
    return items.select(*id_cols, parent).join(sizes, parent, "inner").select(
        *id_cols, parent, (F.col("group_size") - 1).alias("n_related"))


def similar_items(items: DataFrame, group_cols: list[str], id_col: str, order: list[Column], n: int = 4) -> DataFrame:
    """For every item the ``n`` first other items of its group under ``order``
    (e.g. newest first), as (id, similar_id, rank).

    An item's n first peers are among its group's n+1 first members, so each
    item joins only those n+1 rows (a partial WindowGroupLimit keeps them per
    task before the shuffle): output and shuffle stay linear in the items,
    never quadratic in a group.
    """
    w = Window.partitionBy(*group_cols).orderBy(*order)
    heads = (items.withColumn("_gr", F.row_number().over(w)).where(F.col("_gr") <= n + 1)
             .groupBy(*[F.col(g).alias(f"_h_{g}") for g in group_cols])
             .agg(F.sort_array(F.collect_list(F.struct("_gr", F.col(id_col).alias("id")))).alias("_heads")))
    cond = [items[g] == heads[f"_h_{g}"] for g in group_cols]
    others = F.slice(F.filter("_heads", lambda h: h["id"] != F.col(id_col)), 1, n)
    return (items.select(*group_cols, id_col).join(heads, cond, "inner")
            .select(id_col, F.posexplode(others).alias("_at", "_head"))
            .select(id_col, F.col("_head.id").alias("similar_id"), (F.col("_at") + 1).cast("bigint").alias("rank")))


def preset_eligibility(profiles: DataFrame, presets: DataFrame) -> DataFrame:
    """Theta join -- presets whose minimum column counts a dataset meets.
    Catalyst broadcasts ``presets`` if its size allows."""
    cond = ((profiles["numeric_columns"] >= presets["min_numeric_columns"])
            & (profiles["categorical_columns"] >= presets["min_categorical_columns"]))
    return profiles.join(presets, cond, "inner")
