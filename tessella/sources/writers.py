"""Indexes and reports as files."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import metrics


def save_index(index: DataFrame, path: str) -> None:
    """An index table (chunk_id, embedding, ...), by cell if it has cells."""
    writer = index.write.mode("overwrite")
    (writer.partitionBy("cell") if "cell" in index.columns else writer).parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def by_query(report: DataFrame, queries: DataFrame | None = None, a: str = "a", b: str = "b") -> DataFrame:
    """One row for each query: what queries tells of it (its text, expansion, keywords), the metrics of both strategies, their differences, and which won by its MRR."""
    values = [c for c in report.columns if c not in ("query_id", "strategy")]
    side = lambda name: report.where(F.col("strategy") == name).select("query_id", F.struct(*values).alias(name))
    both = side(a).join(side(b), "query_id", "full_outer")
    change = F.struct(*[F.round(F.col(f"{b}.{c}") - F.col(f"{a}.{c}"), 4).alias(c) for c in values])
    best = F.when(F.col(f"{b}.mrr") > F.col(f"{a}.mrr"), b).when(F.col(f"{a}.mrr") > F.col(f"{b}.mrr"), a).otherwise("tie")
    rows = both.select("query_id", F.struct(a, b).alias("strategies"), change.alias("change"), best.alias("winner"))
    return queries.join(rows, "query_id") if queries is not None else rows


def write_report(report: DataFrame, folder: str, name: str | None = None, settings: dict | None = None, queries: DataFrame | None = None) -> str:
    """Writes folder/benchmark_<time>: queries, a JSON object for each (see by_query), and summary, one object of settings, means, comparison and verdict. Returns its path."""
    spark, path = report.sparkSession, f"{folder}/{name or time.strftime('benchmark_%Y%m%d_%H%M%S')}"
    by_query(report, queries).write.mode("overwrite").json(f"{path}/queries")
    means = metrics.mean_metrics(metrics.long_form(report))
    compared = {r["metric"]: {k: r[k] for k in ("value_a", "value_b", "delta", "improvement_percent")} for r in metrics.compare(means, "a", "b").collect()}  # a row for each metric
    said = metrics.summary(means, metrics.win_loss_tie(report, "a", "b")).head()
    whole = {"settings": settings or {}, "n_queries": report.select("query_id").distinct().count(), "comparison": compared, "verdict": said["verdict"] if said else None, "summary": said["summary"] if said else None}
    spark.createDataFrame([(json.dumps(whole, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/summary")
    return path


#: A change of a mean beyond this is marked.
MARKED = 0.01


def markdown_report(report: DataFrame, a: str = "a", b: str = "b", most_queries: int = 50, settings: dict | None = None, queries: DataFrame | None = None) -> str:
    """Settings, means of both strategies with their difference (up, down or level), the summary, and a block for each of the first most_queries queries."""
    means = metrics.mean_metrics(metrics.long_form(report))
    rows = metrics.compare(means, a, b).orderBy("metric").collect()
    if not rows:
        return ""
    flag = lambda d: "up" if d > MARKED else "down" if d < -MARKED else "level"
    lines = [f"* {name}: {value}" for name, value in (settings or {}).items()]
    lines += [*([""] if lines else []), metrics.summary(means, metrics.win_loss_tie(report, a, b), a, b).head()["summary"], "", f"| metric | {a} | {b} | change | |", "|---|---|---|---|---|"]
    lines += [f"| {r['metric']} | {r['value_a']:.4f} | {r['value_b']:.4f} | {r['delta']:+.4f} | {flag(r['delta'])} |" for r in rows]
    shown = ("mrr", "precision_at_1", "recall_at_5", "ndcg_at_5")
    for r in by_query(report, queries, a, b).orderBy("query_id").limit(most_queries).collect():
        told = r.asDict(recursive=True)
        lines += ["", f"### query {told['query_id']}" + (f": {told['query']}" if told.get("query") else ""), ""]
        lines += [f"{label}: {', '.join(told[key]) if isinstance(told[key], list) else told[key]}" for label, key in (("expanded", "expanded_query"), ("keywords added", "keywords_added")) if told.get(key)]
        lines += ["", f"| metric | {a} | {b} | change |", "|---|---|---|---|"]
        for metric in shown:
            x, y = ((told["strategies"][name] or {}).get(metric) for name in (a, b))
            lines.append(f"| {metric} | " + " | ".join("" if v is None else f"{v:.4f}" for v in (x, y)) + f" | {'' if x is None or y is None else f'{y - x:+.4f}'} |")
        taken = [f"{name} {told['strategies'][name]['latency']:.3f} s" for name in (a, b) if (told["strategies"][name] or {}).get("latency") is not None]
        lines += ["", f"won by {told['winner']}" + (f"; alone it took {', '.join(taken)}" if taken else "")]
    return "\n".join(lines) + "\n"


def envelope(hits: DataFrame) -> DataFrame:
    """One row for each query with its hits as an array, in order of rank."""
    fields = [c for c in hits.columns if c != "query_id"]
    return hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", *[c for c in fields if c != "rank"]))).alias("hits"))


def as_json(hits: DataFrame, limit: int = 100) -> str:
    """The envelopes of some queries as text, for a console."""
    return json.dumps([r.asDict(recursive=True) for r in envelope(hits).limit(limit).collect()], default=str)


def newest_reports(spark: SparkSession, folder: str, n: int = 20) -> list[str]:
    """Paths of the newest reports that write_report() wrote into a folder; their names hold the time."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [x.getPath() for x in files.listStatus(at)] if files.exists(at) else []
    return sorted((p.toString() for p in found if p.getName().startswith("benchmark_")), reverse=True)[:n]
