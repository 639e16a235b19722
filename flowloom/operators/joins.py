"""Joins of case tables. Small sides are left to Spark's size estimate; only rows of a stated number are broadcast by hint."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def zero_filled(df: DataFrame, other: DataFrame, on: Sequence[str], fill: Sequence[str]) -> DataFrame:
    """Left join with zero for what is missing."""
    return df.join(other, list(on), "left").fillna(0, subset=list(fill))


def lookup_join(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Many-to-one left join; raises if the dimension repeats a key (one aggregate over the dimension)."""
    twice = dim.groupBy(key).count().where("count > 1").select(key).first()
    if twice is not None:
        raise ValueError(f"{key} {twice[0]!r} is there more than once in the dimension")
    return df.join(dim, key, "left")


def latest_per_key(df: DataFrame, key: Sequence[str], ts: str) -> DataFrame:
    """All rows with a key's largest ts; ties are kept."""
    w = Window.partitionBy(*key).orderBy(F.desc(ts))
    return df.withColumn("rk_", F.rank().over(w)).where("rk_ = 1").drop("rk_")


def active_reductions(reductions: DataFrame, clients: DataFrame, as_of: str, client: str, rid: str, start: str, end: str) -> DataFrame:
    """The reduction valid on a day with the highest id for each client, for clients that finance knows."""
    day = F.lit(as_of).cast("date")
    valid = reductions.where((F.col(start) <= day) & (F.col(end).isNull() | (F.col(end) >= day)))
    return valid.groupBy(client).agg(F.max(rid).alias(rid)).join(clients.select(client).distinct(), client)


def overlay(df: DataFrame, ext: DataFrame, on: Sequence[str], fill: Mapping[str, str], when: str) -> DataFrame:
    """Columns filled from an external table where a row matches and the SQL condition holds; other rows stay."""
    side = ext.select(*on, *(F.col(s).alias(f"{t}_ext") for t, s in fill.items()), F.lit(True).alias("matched_"))
    d = df.join(side, list(on), "left").withColumn("use_", F.coalesce("matched_", F.lit(False)) & F.coalesce(F.expr(when), F.lit(False)))
    return d.withColumns({t: F.when(F.col("use_"), F.col(f"{t}_ext")).otherwise(F.col(t)) for t in fill}).drop("matched_", "use_", *(f"{t}_ext" for t in fill))


def first_attribute(df: DataFrame, key: str, attribute: str, order: Sequence[str]) -> DataFrame:
    """df joined with the attribute of each key's first row."""
    return df.join(df.groupBy(key).agg(F.min_by(attribute, F.struct(*order)).alias(f"first_{attribute}")), key, "left")


def order_list(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Rows of each key as one array, sorted by their fields."""
    return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("items"))


def pin_snapshots(tables: Mapping[str, tuple[DataFrame, str]], anchor: str) -> dict[str, DataFrame]:
    """Each table at its latest export day not after the anchor table's latest: one literal day a table, so partitions are pruned."""
    df, c = tables[anchor]
    target = df.agg(F.max(c)).first()[0]
    out = {}
    for name, (t, col) in tables.items():
        day = t.where(F.col(col) <= F.lit(target)).agg(F.max(col)).first()[0]
        out[name] = t.where(F.col(col) == F.lit(day))
    return out


def caseload_extract(clients: DataFrame, addresses: DataFrame, deaths: DataFrame, reductions: DataFrame, orders: DataFrame, levels: DataFrame) -> DataFrame:
    """One row for each client: address, payer's name (a client), death day, reduction, first order, number of orders, latest level.

    order_list() gives the orders themselves, for a join on the client.

    clients: client_id, name, payer_id; addresses: client_id, address; deaths: client_id, died;
    reductions: client_id, reduction_id; orders: client_id, order_id, made; levels: client_id, level, created.
    Every side is aggregated to one row a client before it is joined.
    """
    payer = clients.select(F.col("client_id").alias("payer_id"), F.col("name").alias("payer_name"))
    one = lambda df, c, f=F.min: df.groupBy("client_id").agg(f(c).alias(c))
    made = orders.groupBy("client_id").agg(F.min("made").alias("first_order"), F.count("*").alias("n_orders"))
    level = latest_per_key(levels, ["client_id"], "created").groupBy("client_id").agg(F.max("level").alias("level"))
    out = clients.join(payer, "payer_id", "left")
    for side in (one(addresses, "address"), one(deaths, "died"), one(reductions, "reduction_id", F.max), made, level):
        out = out.join(side, "client_id", "left")
    return out.fillna({"n_orders": 0})
