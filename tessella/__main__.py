"""Command line: query, benchmark and info over a folder of documents."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessella.functions.lexicon import QUERY_BANK
from tessella.operators.expansion import MODES
from tessella.plans.config import RetrievalConfig
from tessella.plans.retrieval import RetrievalPipeline
from tessella.sources import writers


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tessella")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("query", "benchmark", "info"):
        command = commands.add_parser(name)
        command.add_argument("--data-dir", required=True)
        command.add_argument("--top-k", type=int, default=5)
        if name == "query":
            command.add_argument("query")
            command.add_argument("--strategy", choices=("a", "b", "hybrid"), default="b")
            command.add_argument("--expansion-mode", choices=MODES, default="full")
            command.add_argument("--json-output", action="store_true")
            command.add_argument("--no-rerank", action="store_true")
        if name == "benchmark":
            command.add_argument("--output")
            command.add_argument("--json-only", action="store_true")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("tessella").getOrCreate()
    pipe = RetrievalPipeline(spark, RetrievalConfig(top_k=given.top_k, similarity_threshold=0.0, reranking=not getattr(given, "no_rerank", False)))
    pipe.ingest([given.data_dir])
    if given.command == "info":
        print(f"{pipe.num_chunks()} chunks")
        pipe.chunks.groupBy("source").count().orderBy("source").show(1000, truncate=False)
        return
    pipe.build()
    if given.command == "query":
        asked = pipe.queries([given.query])
        hits = {"a": pipe.retrieve_raw, "hybrid": pipe.retrieve_hybrid}.get(given.strategy, lambda q: pipe.retrieve_enhanced(q, mode=given.expansion_mode))(asked)
        if given.json_output:
            print(writers.as_json(hits))
        else:
            hits.withColumn("text", F.translate(F.substring("text", 1, 120), "\n", " ")).orderBy("rank").show(given.top_k, truncate=False)
        return
    bank = spark.createDataFrame([(i, q, k) for i, (q, k, _) in enumerate(QUERY_BANK)], "query_id long, query string, keywords array<string>")
    report = pipe._scratch.save(pipe.benchmark(bank, timed=len(QUERY_BANK)), "report")
    told = {"settings": {**pipe.config.summary(), "n_chunks": pipe.num_chunks()}, "queries": pipe.told(bank)}
    if given.json_only:
        print("\n".join(report.toJSON().collect()))
    else:
        print(writers.markdown_report(report, **told))
    if given.output:
        writers.write_report(report, given.output, **told)


if __name__ == "__main__":
    main()
