"""Readers and writers. Data never pass through the driver; only a byte sample does, to choose an encoding."""

from __future__ import annotations

import re
import uuid
import warnings
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENCODINGS = ("utf-8-sig", "utf-8", "cp1252", "latin1")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the one that the cluster shares: spark.checkpoint.dir. A local session that names none has its own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file:///tmp/checkpoints/flowloom"
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def normalise_headers(names: Sequence[str]) -> list[str]:
    """Lower case, runs of other signs as one underscore; later equals get __1, __2."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        base = re.sub(r"[^0-9a-z]+", "_", n.strip().lower()).strip("_") or "column"
        k = seen.get(base, 0)
        seen[base] = k + 1
        out.append(f"{base}__{k}" if k else base)
    return out


def snake_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*(re.sub(r"\s+", "_", c.strip().lower()) for c in df.columns))


def resolve(df: DataFrame, name: str):
    """The column of that name: exact, else one that holds it or that it holds, else a common beginning, else null."""
    wanted = normalise_headers([name])[0]
    by = dict(zip(normalise_headers(df.columns), df.columns, strict=True))
    for rule in (lambda c: c == wanted, lambda c: wanted in c or c in wanted, lambda c: c[:6] == wanted[:6]):
        for c, original in by.items():
            if rule(c):
                return F.col(f"`{original}`")
    return F.lit(None).cast("string")


def sniff(sample: bytes, encodings: Sequence[str] = ENCODINGS, cut: bool = True) -> tuple[str, str]:
    """Encoding and separator of a byte sample; cut: it may end inside a character."""
    for e in encodings:
        try:
            text = sample.decode(e)
            break
        except UnicodeDecodeError as x:
            if cut and x.start > len(sample) - 4:
                text = sample[: x.start].decode(e)
                break
    else:
        e, text = "utf-8", sample.decode("utf-8", "replace")
    head = text.split("\n", 1)[0]
    return e, max(",;\t|", key=head.count)


def head_of(spark: SparkSession, path: str, sample: int = 65536) -> bytes:
    """The first bytes of the first file under the path (by name) that holds any: one listing and one read of so many bytes."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted((f for f in store.globStatus(where) or []), key=lambda f: f.getPath().toString())
    files = [x for f in found for x in (store.listStatus(f.getPath()) if f.isDirectory() else [f])]
    for f in sorted(files, key=lambda f: f.getPath().toString()):
        if f.isFile() and f.getLen() and not f.getPath().getName().startswith(("_", ".")):
            stream = store.open(f.getPath())
            try:
                return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(sample, f.getLen())))
            finally:
                stream.close()
    return b""


def read_extract(spark: SparkSession, path: str, sep: str | None = None, encodings: Sequence[str] = ENCODINGS, sample: int = 65536) -> DataFrame:
    """Delimited text as trimmed strings with normalised headers, without rows and columns that are blank throughout."""
    head = head_of(spark, path, sample)
    encoding, found = sniff(head, encodings, len(head) == sample) if head else ("utf-8", ",")
    # Spark reads no windows-1252: it is read as latin1, and the bytes that differ are put right
    names = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "cp1252": "ISO-8859-1", "latin1": "ISO-8859-1"}
    odd = {chr(b): bytes([b]).decode("cp1252", "ignore") for b in range(128, 160)} if encoding == "cp1252" else {}
    odd = {a: b for a, b in odd.items() if b}
    df = spark.read.csv(path, header=True, inferSchema=False, sep=sep or found, encoding=names.get(encoding, encoding))
    df = df.toDF(*normalise_headers([c.lstrip("\ufeff").translate(str.maketrans(odd)) for c in df.columns]))

    def clean(c: str) -> Column:
        return F.nullif(F.trim(F.translate(c, "".join(odd), "".join(odd.values())) if odd else c), F.lit("")).alias(c)

    df = df.select(*map(clean, df.columns)).dropna(how="all")
    filled = df.agg(*(F.count(c).alias(c) for c in df.columns)).first()
    return df.select(*(c for c in df.columns if filled[c]))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=True) if path.endswith(".csv") else spark.read.parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    """Parquet for .parquet, else CSV."""
    if path.endswith(".parquet"):
        df.write.mode("overwrite").parquet(path)
    else:
        df.write.mode("overwrite").csv(path, header=True)


def write_bundle(tables: Mapping[str, DataFrame], folder: str) -> DataFrame:
    """Write each table under the folder and return name, rows; rows are counted in the written files, from their footers."""
    spark, counts = next(iter(tables.values())).sparkSession, {}
    for name, df in tables.items():
        path = f"{folder}/{name}.parquet"
        df.write.mode("overwrite").parquet(path)
        counts[name] = spark.read.schema(df.schema).parquet(path).count()
    meta = spark.createDataFrame(list(counts.items()), "name string, rows long")
    meta.coalesce(1).write.mode("overwrite").json(f"{folder}/metadata")
    return meta


def synth_cases(cases: DataFrame, seed: int, delays: str = "gamma") -> DataFrame:
    """A synthetic case for each real one: staff, team, type, risk and receipt as they are; delays, sign-off and legal review drawn.

    The mean and spread of the delays, the share signed off and the share with a review are those of
    the type and risk. delays: gamma (shape 2, by the mean) or normal (by mean and spread, not below 0).
    """
    if delays not in ("gamma", "normal"):
        raise ValueError(f"delays are gamma or normal, not {delays!r}")
    keys = ["case_type", "risk"]
    wait, work = F.datediff("dt_alloc", "dt_received"), F.datediff("dt_signoff", "dt_alloc")
    shape = cases.groupBy(*keys).agg(
        *(F.coalesce(f(x), F.lit(0.0)).alias(f"{n}_{k}") for k, x in (("wait", wait), ("work", work)) for n, f in (("mean", F.avg), ("sd", F.stddev_pop))),
        F.avg(F.col("dt_signoff").isNotNull().cast("int")).alias("signed"),
        F.avg("needs_legal_review").alias("reviewed"),
    )

    def drawn(k: str, at: int):
        if delays == "normal":
            return F.greatest(F.round(F.col(f"mean_{k}") + F.randn(seed + at) * F.col(f"sd_{k}")), F.lit(0.0)).cast("int")
        both = -F.log(1 - F.rand(seed + at)) - F.log(1 - F.rand(seed + at + 50))  # two exponentials: shape 2
        return F.round(F.col(f"mean_{k}") / 2 * both).cast("int")

    d = cases.select("case_id", "staff_id", "team", *keys, "dt_received").join(F.broadcast(shape), keys)  # one row a type and risk
    d = d.withColumn("dt_alloc", F.date_add("dt_received", drawn("wait", 1))).withColumn("end_", F.date_add("dt_alloc", drawn("work", 2)))
    return d.select(
        "case_id",
        "staff_id",
        "team",
        *keys,
        "dt_received",
        "dt_alloc",
        F.when(F.rand(seed + 3) < F.col("signed"), F.col("end_")).alias("dt_signoff"),
        (F.rand(seed + 4) < F.col("reviewed")).cast("int").alias("legal_review"),
    )


def run_all(spark: SparkSession, raw: str, folder: str, metric: str = "days_to_signoff", group: str = "case_type") -> DataFrame:
    """From a raw extract to a bundle: typed cases, events, backlog, panel, its summary, team trend of the last year, annual figures.

    Returns name, rows, first, last (days of receipt): a row for each table. The team trend is left out,
    with a warning, where it cannot be made; all else fails aloud.
    """
    from ..operators import aggregates, flow, quality
    from ..operators.scans import kept

    typed = f"{folder}/engineered.parquet"
    quality.engineer(read_extract(spark, raw)).write.mode("overwrite").parquet(typed)
    cases = spark.read.parquet(typed)
    h = kept(flow.date_horizon(cases), "horizon")
    panel = kept(flow.daily_panel(cases, h), "panel")  # its summary reads it too
    tables = {
        "events": flow.event_log(cases),
        "backlog": flow.backlog_series(cases, h),
        "panel": panel,
        "panel_summary": flow.panel_summary(panel, ["staff_id"]),
        "annual": aggregates.interval_change(cases, "dt_alloc", metric, group),
    }
    try:
        last = cases.agg(F.max("dt_alloc")).first()[0]
        recent = quality.filter_years(cases, "dt_alloc", str(last), 1) if last else cases.limit(0)
        tables["team_trend"] = aggregates.monthly_trend(recent, "dt_alloc", metric, by=["team"])
        tables["team_trend"].schema  # noqa: B018  the plan is checked here
    except AnalysisException as e:  # a column that the trend needs isn't there
        warnings.warn(f"team trend skipped: {e}", stacklevel=2)
    counts = write_bundle(tables, folder).unionByName(spark.createDataFrame([("engineered", cases.count())], "name string, rows long"))
    span = cases.agg(F.min("dt_received").alias("first"), F.max("dt_received").alias("last"))
    return counts.crossJoin(F.broadcast(span))


def save_model(model: PipelineModel, metrics: Mapping[str, float], path: str, spark: SparkSession) -> None:
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(k, float(v)) for k, v in metrics.items()], "metric string, value double").write.mode("overwrite").parquet(f"{path}/metrics.parquet")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, DataFrame]:
    """What save_model saved: the pipeline, and metric, value."""
    return PipelineModel.load(f"{path}/model"), spark.read.parquet(f"{path}/metrics.parquet")
