"""Sources and sinks: series files, edge files, GraphML, run log and result store."""

from __future__ import annotations

import json
import platform
import time
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import IDX, PLOT_LAG, PLOT_P, TS, UNIT, detect, numeric_columns
from .views import indexed

TIME_NAMES = ["time", "date", "datetime", "timestamp"]


def load_parquet(spark: SparkSession, path: str, sample_rows: int | None = None, seed: int = 42, key: list[str] | None = None) -> DataFrame:
    """A file or all files of a directory; optionally an exact, reproducible sample, by order of a hash of the key."""
    df = spark.read.parquet(path)
    if sample_rows is None:
        return df
    return sample_exact(df, sample_rows, key or df.columns, seed)


def sample_exact(df: DataFrame, n: int, key: list[str], seed: int = 42) -> DataFrame:
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key])), *key).limit(n)


def load_csv(spark: SparkSession, path: str, time_column: str | None = None, id_column: str | None = None, variable_column: str | None = None, value_column: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(series, one row of metadata). Rows whose time can't be read go; the layout, wide or long, follows from the columns given."""
    raw = spark.read.option("header", True).option("inferSchema", True).csv(path)
    time_column = time_column or next((c for c in raw.columns if c.lower() in TIME_NAMES), raw.columns[0])
    raw = raw.withColumn(time_column, F.try_to_timestamp(F.col(time_column).cast("string")).cast("timestamp_ntz")).where(F.col(time_column).isNotNull()).withColumnRenamed(time_column, TS)
    if variable_column and value_column:
        df = pivot_series(raw, id_column, variable_column, value_column)
    elif id_column and value_column:
        df = pivot_series(raw, None, id_column, value_column)
    else:
        df = raw.withColumn(UNIT, F.col(id_column).cast("string") if id_column else F.lit("all"))
    df = indexed(df)
    cols = numeric_columns(df)
    meta = df.agg(F.count("*").alias("n_rows"), F.lit(len(cols)).alias("n_variables"), F.lit(",".join(cols)).alias("variables"), F.countDistinct(UNIT).alias("n_ids"), F.lit("long" if value_column else "wide").alias("format"))
    return df, meta.crossJoin(sampling_interval(df))


def pivot_series(df: DataFrame, id_column: str | None, variable_column: str, value_column: str, values: list[str] | None = None) -> DataFrame:
    """Long to wide on the variable, or on id::variable; repeated cells are averaged. Give ``values`` to spare a pass."""
    key = F.concat_ws("::", F.col(id_column).cast("string"), F.col(variable_column).cast("string")) if id_column else F.col(variable_column).cast("string")
    return df.withColumn("_k", key).groupBy(TS).pivot("_k", values).agg(F.avg(value_column)).withColumn(UNIT, F.lit("all"))


def sampling_interval(df: DataFrame) -> DataFrame:
    """Mode of the whole days between rows (the smallest of equal ones); 1 where it is not positive."""
    from pyspark.sql import Window

    gap = F.floor((F.unix_micros(F.col(TS).cast("timestamp")) - F.unix_micros(F.lag(TS).over(Window.partitionBy(UNIT).orderBy(TS)).cast("timestamp"))) / 86_400_000_000)
    mode = df.select(gap.alias("d")).where("d is not null").groupBy("d").count().orderBy(F.desc("count"), "d").limit(1)
    return mode.agg(F.coalesce(F.max(F.when(F.col("d") > 0, F.col("d"))), F.lit(1)).cast("double").alias("sampling_days"))


def sampling_days(df: DataFrame, cols: list[str]) -> DataFrame:
    """Median gap in days over rows where all of cols are known; 1 under three rows or where not positive."""
    from pyspark.sql import Window

    gap = (F.unix_micros(F.col(TS).cast("timestamp")) - F.unix_micros(F.lag(TS).over(Window.partitionBy(UNIT).orderBy(TS)).cast("timestamp"))) / 86_400_000_000
    got = df.na.drop(subset=cols).select(gap.alias("d")).agg(F.count("*").alias("n"), F.median("d").alias("d"))
    return got.select(F.when((F.col("n") >= 3) & (F.col("d") > 0), F.col("d")).otherwise(1.0).alias("sampling_days"))


def harmonize(df: DataFrame, cols: list[str], days: int = 1, max_gap_days: float | None = None) -> DataFrame:
    """Put each unit on a regular grid of ``days`` from its first to its last row and fill linearly, at most
    max_gap_days / days + 1 cells in a row where given."""
    from ..operators.transforms import interpolate

    span = df.groupBy(UNIT).agg(F.min(TS).alias("a"), F.max(TS).alias("b"))
    grid = span.select(UNIT, F.explode(F.expr(f"sequence(a, b, interval {int(days)} days)")).alias(TS))
    limit = None if max_gap_days is None else int(max_gap_days / days) + 1
    return interpolate(indexed(grid.join(df.drop(IDX), [UNIT, TS], "left")), cols, limit=limit)


def edge_weight(q: Column, p: Column, alpha: float = 0.05) -> Column:
    return -F.log10(F.greatest(F.coalesce(q, p, F.lit(alpha)), F.lit(1e-10)))


def graphml_edges(consensus: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Edge attributes of the GraphML form; of several edges between the same ordered pair the last (largest lag) stays."""
    from ..functions.stats import first_by

    e = consensus.withColumn("_r", first_by(["source", "target"], [F.desc("lag_steps")])).where("_r = 1")
    return e.select("source", "target", edge_weight(F.col("best_q_value"), F.col("best_p_value"), alpha).alias("weight"), "lag_steps", "lag_days", F.col("agreeing_methods").alias("methods"), "vote_count")


def write_graphml(consensus: DataFrame, path: str, alpha: float = 0.05) -> str | None:
    """Write the graph; an edge table is bounded by the pairs of variables. No edges, no file."""
    from xml.sax.saxutils import quoteattr

    rows = graphml_edges(consensus, alpha).orderBy("source", "target").collect()
    if not rows:
        return None
    fields = [c for c in rows[0].__fields__ if c not in ("source", "target")]
    kinds = {"weight": "double", "lag_days": "double", "lag_steps": "int", "vote_count": "int"}
    out = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    out += [f'<key id="{f}" for="edge" attr.name="{f}" attr.type="{kinds.get(f, "string")}"/>' for f in fields] + ['<graph edgedefault="directed">']
    out += [f"<node id={quoteattr(n)}/>" for n in sorted({x for r in rows for x in (r.source, r.target)})]
    for r in rows:
        data = "".join(f'<data key="{f}">{r[f]}</data>' for f in fields if r[f] is not None)
        out.append(f"<edge source={quoteattr(r.source)} target={quoteattr(r.target)}>{data}</edge>")
    Path(path).write_text("\n".join([*out, "</graph>", "</graphml>"]))
    return path


def write_edges_csv(edges: DataFrame, path: str, one_file: bool = False) -> None:
    """Edges by p-value; parts are in order of their names. One file only where asked for: it is written by one task."""
    rows = edges.orderBy("p_value")
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").option("header", True).csv(path)


def edge_summary(edges: DataFrame) -> DataFrame:
    """One row: edges, significant ones, methods, mean p, range of lags."""
    return edges.agg(
        F.count("*").alias("n_edges"), F.count_if("is_significant").alias("n_significant"), F.array_join(F.array_sort(F.collect_set("method")), ",").alias("methods"),
        F.avg("p_value").alias("mean_p"), F.min("lag_steps").alias("lag_min"), F.max("lag_steps").alias("lag_max"),
    )


class Store:
    """Results of a run, one Parquet table a method, kept unless ``force``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def save(self, name: str, df: DataFrame, force: bool = False) -> None:
        df.write.mode("overwrite" if force else "ignore").parquet(f"{self.path}/{name}")

    def load(self, name: str) -> DataFrame | None:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.parquet(f"{self.path}/{name}")
        except AnalysisException:
            return None

    def methods(self) -> list[str]:
        """Names of the tables that have been saved, as the file system lists them."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()) if fs.exists(path) else []

    def metadata(self, name: str) -> dict | None:
        df = self.load(name)
        if df is None:
            return None
        return {"rows": df.count(), "columns": df.columns, "types": dict(df.dtypes), "p_column": detect(df, PLOT_P), "lag_column": detect(df, PLOT_LAG), "has_geographic": {"latitude", "longitude"} <= set(df.columns)}


class PlotLog:
    """Status of each chart of a run, the last one told."""

    def __init__(self) -> None:
        self.entries: dict[str, dict] = {}

    def tell(self, stage: str, method: str, plot: str, status: str = "success", error: str | None = None) -> None:
        self.entries[f"{stage}/{method}/{plot}"] = {"status": status, "error": error, "time": time.time()}

    def stats(self) -> dict[str, int]:
        found = [e["status"] for e in self.entries.values()]
        return {"total": len(found)} | {s: found.count(s) for s in ("success", "failed", "skipped")}


def code_version(folder: str = ".") -> dict[str, object]:
    """Commit, branch and whether files are changed, where the folder is under git; else nothing is known."""
    import subprocess

    def ask(*args: str) -> str | None:
        try:
            return subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True, check=True, timeout=10).stdout.strip()
        except (OSError, subprocess.SubprocessError):
            return None

    changed = ask("status", "--porcelain")
    return {"commit": ask("rev-parse", "HEAD"), "branch": ask("rev-parse", "--abbrev-ref", "HEAD"), "dirty": None if changed is None else bool(changed)}


class RunLog:
    """Parameters, data hashes, metrics, files and errors of a run, as JSON."""

    def __init__(self, name: str, description: str | None = None) -> None:
        self.log: dict = {"name": name, "description": description, "start": time.time(), "parameters": {}, "data": {}, "results": {}, "files": [], "metrics": {}, "errors": [], "system": {"platform": platform.platform(), "python": platform.python_version()}}

    def parameters(self, **params: object) -> None:
        self.log["parameters"].update(params)

    def data(self, df: DataFrame, name: str = "input_data") -> None:
        self.log["data"][name] = content_hash(df).first().asDict()

    def results(self, df: DataFrame, name: str = "consensus_edges") -> None:
        self.log["results"][name] = {"n_rows": df.count(), "columns": df.columns}

    def metric(self, name: str, value: float) -> None:
        self.log["metrics"][name] = value

    def file(self, path: str, kind: str = "output", description: str | None = None) -> None:
        self.log["files"].append({"path": path, "type": kind, "description": description, "exists": Path(path).exists()})

    def error(self, error: BaseException) -> None:
        self.log["errors"].append({"type": type(error).__name__, "message": str(error)})

    def finalize(self) -> dict:
        if "end" not in self.log:
            self.log |= {"end": time.time(), "duration": time.time() - self.log["start"], "code": code_version()}
        return self.log

    def save(self, path: str) -> None:
        self.finalize()
        Path(path).write_text(json.dumps(self.log, default=str, indent=1))


def content_hash(df: DataFrame) -> DataFrame:
    """One row (n_rows, hash) that does not depend on the order of rows: the sum of the leading 60 bits of each row's MD5. A
    value is preceded by its length and a null is a dash, so that no value reads like another's parts."""
    text = F.concat(*[F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in df.columns])
    return df.select(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)").alias("h")).agg(F.count("*").alias("n_rows"), F.sum("h").cast("string").alias("hash"))


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer join of two (name, value) tables; a missing value shows as N/A."""
    j = a.select("name", F.col("value").alias("v1")).join(b.select("name", F.col("value").alias("v2")), "name", "full_outer")
    return j.select("name", F.coalesce("v1", F.lit("N/A")).alias("value_1"), F.coalesce("v2", F.lit("N/A")).alias("value_2"), F.col("v1").eqNullSafe(F.col("v2")).alias("equal"))
