"""Scans by range parts: running sums and products, row positions, neighbouring rows and exact quantiles.

No task gets a whole column or group to sort. Values are cut into range parts at quantiles of theirs,
which become literals of the plan: a part depends on the value alone, however rows are dealt or computed
anew. What a scan reads twice is written to the shared folder once. Tables of WHOLE rows or fewer are
scanned in one window, with the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

#: Rows, or distinct values, that one task may hold.
WHOLE = 100_000
#: Distinct values of a group that one task may hold for its quantiles, some tens of megabytes.
HELD = 1_000_000
#: Range parts of a column.
PARTS = 64


def kept(df: DataFrame, name: str = "scan") -> DataFrame:
    """df written to the shared folder and read back: computed once, and whole after the loss of an executor."""
    from ..sources.tables import scratch

    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing will read again."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def part_of(df: DataFrame, v: str, by: str | None = None, parts: int = PARTS) -> Column:
    """The range part of v, a number or a day; with by (few keys), parts of each key's own values."""
    points = [k / parts for k in range(1, parts)]
    among = lambda cuts: F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(v))) if cuts else F.lit(0)
    if by is None:
        return among(sorted(set(df.agg(F.percentile_approx(v, points).alias("q")).first().q or [])))
    out = F.lit(0)
    for r in df.groupBy(by).agg(F.percentile_approx(v, points).alias("q")).collect():  # one row a key
        out = F.when(F.col(by) == r[by], among(sorted(set(r.q or [])))).otherwise(out)
    return out


def running(
    n: DataFrame,
    v: str,
    sums: Sequence[str],
    descending: bool = False,
    by: Sequence[str] = (),
    products: Sequence[str] = (),
    own_parts: bool = False,
    parts: int = PARTS,
    whole: int = WHOLE,
) -> DataFrame:
    """n (one row for each value v, of each key) with to_c, the sum or product of c up to v, and all_c, that of all rows of the key.

    own_parts: parts follow each key's values; there must be one key column with few keys.
    """
    n = kept(n)
    kinds = {**dict.fromkeys(sums, F.sum), **dict.fromkeys(products, F.product)}
    order = F.desc(v) if descending else F.asc(v)
    group = Window.partitionBy(*by)
    if n.count() <= whole:
        w = group.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return n.withColumns({f"to_{c}": f(c).over(w) for c, f in kinds.items()} | {f"all_{c}": f(c).over(group) for c, f in kinds.items()})
    part = part_of(n, v, by[0] if own_parts else None, parts)
    dealt = n.withColumn("part_", -part if descending else part)
    w = Window.partitionBy(*by, "part_").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = group.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    sizes = dealt.groupBy(*by, "part_").agg(*(f(c).alias(f"part_{c}") for c, f in kinds.items())).select(
        *by,
        "part_",
        *(F.coalesce(f(f"part_{c}").over(before), F.lit(0 if f is F.sum else 1)).alias(f"before_{c}") for c, f in kinds.items()),
        *(f(f"part_{c}").over(group).alias(f"all_{c}") for c, f in kinds.items()),
    )
    keys = {k: f"key_{i}" for i, k in enumerate([*by, "part_"])}
    sizes = sizes.withColumnsRenamed(keys)
    same = [F.col(k).eqNullSafe(F.col(x)) for k, x in keys.items()]
    both = dealt.withColumns({f"to_{c}": f(c).over(w) for c, f in kinds.items()}).join(sizes if by and not own_parts else F.broadcast(sizes), same)
    met = {f"to_{c}": F.col(f"to_{c}") + F.col(f"before_{c}") if f is F.sum else F.col(f"to_{c}") * F.col(f"before_{c}") for c, f in kinds.items()}
    return both.withColumns(met).drop("part_", *keys.values(), *(f"before_{c}" for c in kinds))


def positions(df: DataFrame, order: str, by: Sequence[str] = (), parts: int = PARTS, whole: int = WHOLE) -> DataFrame:
    """df with pos_, the place of each row in its key's order, from 1; rows of a null order come first. Equal orders have no order of their own."""
    df = kept(df)
    if df.count() <= whole:
        return df.withColumn("pos_", F.row_number().over(Window.partitionBy(*by).orderBy(order)).cast("long"))
    part = F.when(F.col(order).isNull(), -1).otherwise(part_of(df, order, parts=parts))
    dealt = df.withColumn("part_", part)
    before = Window.partitionBy(*by).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(*by, "part_").agg(F.count("*").alias("n_"))
    keys = {k: f"key_{i}_" for i, k in enumerate([*by, "part_"])}
    sizes = sizes.withColumn("before_", F.coalesce(F.sum("n_").over(before), F.lit(0))).drop("n_").withColumnsRenamed(keys)
    numbered = dealt.withColumn("pos_", F.row_number().over(Window.partitionBy(*by, "part_").orderBy(order)).cast("long"))
    joined = numbered.join(sizes if by else F.broadcast(sizes), [F.col(k).eqNullSafe(F.col(x)) for k, x in keys.items()])
    return joined.withColumn("pos_", F.col("pos_") + F.col("before_")).drop("part_", "before_", *keys.values())


def over_rows(
    df: DataFrame,
    order: str,
    made: Callable[[WindowSpec], Mapping[str, Column]],
    back: int = 0,
    ahead: int = 0,
    by: Sequence[str] = (),
    size: int = WHOLE,
    parts: int = PARTS,
    whole: int = WHOLE,
) -> DataFrame:
    """df with pos_ and the columns that made(window) makes of rows up to `back` before and `ahead` after, in order.

    Rows are dealt by position into blocks of `size`; the rows next to a block join it as its halo, and go
    when the block's window is done.
    """
    size = max(size, back, ahead, 1)
    d = positions(df, order, by, parts, whole)
    own, place = F.floor((F.col("pos_") - 1) / size), (F.col("pos_") - 1) % size
    blocks = F.filter(F.array(own, F.when(place >= size - back, own + 1), F.when((place < ahead) & (own > 0), own - 1)), lambda b: b.isNotNull())
    dealt = d.withColumn("block_", F.explode(blocks))
    columns = made(Window.partitionBy(*by, "block_").orderBy("pos_"))
    return dealt.withColumns(dict(columns)).where(F.col("block_") == own).drop("block_")


def lagged(df: DataFrame, order: str, lags: Mapping[str, tuple[str, int]], by: Sequence[str] = (), **options) -> DataFrame:
    """df with pos_ and, for each name, a column's value so many rows before (or, if negative, after)."""
    ks = [k for _, k in lags.values()]
    made = lambda w: {n: F.lag(c, k).over(w) for n, (c, k) in lags.items()}
    return over_rows(df, order, made, max(0, *ks), max(0, *(-k for k in ks)), by, **options)


def grouped_quantiles(
    df: DataFrame, by: Sequence[str], c: str, qs: Mapping[str, float], small: int = HELD, buckets: int = PARTS
) -> DataFrame:
    """by, and for each name the exact quantile of c (between neighbours: linear), as percentile() gives it, in bounded memory.

    percentile() holds a group's distinct values at once. Where a group has more than `small`, ranks are
    selected instead: approximate quantiles cut a group into buckets, counts tell in which bucket each
    wanted rank lies, and only those buckets' rows go on, as groups of their own, until they are small or
    of one value. Null keys are a group; nulls of c are not seen; a group without values has nulls.
    """
    if not by:
        return grouped_quantiles(df.select(F.lit(0).alias("all_"), F.col(c).alias("v_")), ["all_"], "v_", qs, small, buckets).drop("all_")
    rows = df.select(*(F.col(k).alias(f"k{i}_") for i, k in enumerate(by)), F.col(c).cast("double").alias("v_"))
    keys = [f"k{i}_" for i in range(len(by))]
    names = {f"k{i}_": k for i, k in enumerate(by)}
    most = rows.groupBy(*keys).agg(F.approx_count_distinct("v_", 0.02).alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= small:
        plain = rows.groupBy(*keys).agg(F.percentile("v_", [float(q) for q in qs.values()]).alias("q_"))  # one buffer for all
        return plain.select(*(F.col(k).alias(n) for k, n in names.items()), *(F.get("q_", F.lit(i)).alias(n) for i, n in enumerate(qs)))
    rows = rows.withColumn("path_", F.lit(""))
    id_ = [*keys, "path_"]
    groups = kept(rows.groupBy(*id_).agg(F.count("v_").alias("n_")), "groups")
    place = {n: (F.col("n_") - 1) * F.lit(float(q)) for n, q in qs.items()}
    sides = [F.struct(F.lit(n).alias("name"), s.alias("side"), f(place[n]).cast("long").alias("rank_")) for n in qs for s, f in ((F.lit(0), F.floor), (F.lit(1), F.ceil))]
    wanted = groups.where("n_ > 0").select(*id_, F.explode(F.array(*sides)).alias("x")).select(*id_, "x.name", "x.side", "x.rank_")
    found = None
    level = 0
    while True:
        level += 1
        points = [k / buckets for k in range(buckets + 1)]
        # the largest value of each bucket; its last is the group's
        cut = kept(rows.where("v_ IS NOT NULL").groupBy(*id_).agg(F.array_distinct(F.percentile_approx("v_", points, 10 * buckets)).alias("cuts_")), "cuts")
        at = meet(rows.where("v_ IS NOT NULL"), cut, id_)
        at = at.withColumn("bucket_", F.size(F.filter("cuts_", lambda x: x < F.col("v_")))).drop("cuts_")
        counts = at.groupBy(*id_, "bucket_").agg(F.count("*").alias("n_"), F.min("v_").alias("lo_"), F.max("v_").alias("hi_"))
        before = Window.partitionBy(*id_).orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
        counts = counts.withColumn("before_", F.coalesce(F.sum("n_").over(before), F.lit(0)))
        hits = meet(wanted, counts, id_).where((F.col("rank_") >= F.col("before_")) & (F.col("rank_") < F.col("before_") + F.col("n_")))
        hits = kept(hits.withColumn("rank_", F.col("rank_") - F.col("before_")), "ranks")
        done = hits.where("lo_ = hi_").select(*keys, "name", "side", F.col("lo_").alias("v_"))
        found = done if found is None else found.unionAll(done)
        open_ = hits.where("lo_ < hi_")
        left = open_.agg(F.max("n_").alias("n"), F.count("*").alias("k")).first()
        if not left.k:
            break
        next_ = F.concat("path_", F.lit("/"), F.col("bucket_").cast("string"))
        at = meet(at, open_.select(*id_, "bucket_").distinct(), [*id_, "bucket_"])
        rows = kept(at.select(*keys, next_.alias("path_"), "v_"), "rows")
        wanted = open_.select(*keys, next_.alias("path_"), "name", "side", "rank_")
        if left.n <= small:
            sorted_ = rows.groupBy(*id_).agg(F.sort_array(F.collect_list("v_")).alias("all_"))  # `small` values at most
            last = meet(wanted, sorted_, id_).select(*keys, "name", "side", F.get("all_", F.col("rank_").cast("int")).alias("v_"))
            found = found.unionAll(last)
            break
    ends = found.groupBy(*keys, "name").agg(F.max(F.when(F.col("side") == 0, F.col("v_"))).alias("lo_"), F.max(F.when(F.col("side") == 1, F.col("v_"))).alias("hi_"))
    ends = meet(ends, groups.drop("path_"), keys)
    share = lambda n: place[n] - F.floor(place[n])
    value = {n: F.max(F.when(F.col("name") == n, (1 - share(n)) * F.col("lo_") + share(n) * F.col("hi_"))).alias(n) for n in qs}
    out = ends.groupBy(*keys).agg(*value.values())
    return meet(groups.select(*keys), out, keys, "left").withColumnsRenamed(names)


def meet(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on keys of which nulls are equal; the right side's keys go."""
    if not keys:
        return left.join(F.broadcast(right), how="cross" if how == "inner" else how)
    other = right.withColumnsRenamed({k: f"{k}other_" for k in keys})
    return left.join(other, [F.col(k).eqNullSafe(F.col(f"{k}other_")) for k in keys], how).drop(*(f"{k}other_" for k in keys))
