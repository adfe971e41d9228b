"""Command line: python -m weftline.cli COMMAND ..."""

from __future__ import annotations

import argparse
import tempfile
import webbrowser
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.config import Config
from weftline.functions import text as X
from weftline.operators import alignment, graph_query
from weftline.operators.graph_store import GraphStore
from weftline.session import local_session, read
from weftline.sinks import graph_files
from weftline.sources import evaluation_sets
from weftline.sources.pages import chunk_documents


def complexity(predicted: DataFrame) -> DataFrame:
    """How compound the predicates of each run are."""
    n = X.token_count(F.col("predicate"))
    return predicted.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.count_if(n == 1).alias("single_predicates"), F.count_if(n > 1).alias("compound_predicates"), F.avg(n).alias("avg_tokens"))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="weftline")
    parser.add_argument("--store", help="folder of the graph tables")
    parser.add_argument("--config", help="file of KEY=VALUE lines; the environment goes before it")
    sub = parser.add_subparsers(dest="command", required=True)
    one = sub.add_parser("ingest", help="chunk a table of texts and merge what is found into the graph")
    one.add_argument("folder")
    one.add_argument("--table", default="documents")
    one.add_argument("--force", action="store_true")
    sub.add_parser("stats")
    one = sub.add_parser("search")
    one.add_argument("query")
    one.add_argument("--limit", type=int, default=15)
    one = sub.add_parser("sql", help="a named or literal query over the graph tables")
    one.add_argument("query")
    one = sub.add_parser("view")
    one.add_argument("out")
    one.add_argument("--limit", type=int, default=150)
    one = sub.add_parser("export-image")
    one.add_argument("out")
    one.add_argument("--limit", type=int, default=150)
    one = sub.add_parser("browser", help="draw the graph and open it in a browser")
    one.add_argument("--limit", type=int, default=150)
    sub.add_parser("clear")
    one = sub.add_parser("benchmark", help="score the published predictions")
    one.add_argument("--items", type=int, default=15, help="rows of each status among the alignment details")
    args = parser.parse_args(argv)
    config = Config.load(args.config)
    spark = local_session(config.cores, config.memory)
    store = GraphStore(spark, args.store or config.store)
    if args.command == "ingest":
        now = datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S.%f")
        chunks = chunk_documents(read(spark, args.folder, args.table), name_col="doc_id")
        print(store.ingest(chunks, run_id=now.replace(" ", "T").replace(":", ""), at=now, force=args.force, progress=lambda done, total, what: print(f"{what}: {done} of {total} chunks")))
    elif args.command == "benchmark":
        p, g = evaluation_sets.predictions(spark), evaluation_sets.gold(spark)
        m = alignment.assign(alignment.candidates(p, g)).persist()
        details = alignment.details(p, g, m).withColumn("k", F.row_number().over(Window.partitionBy("run", "status").orderBy("predicted", "gold")))
        for df in (alignment.report(p, g, m), alignment.category_report(p, g, m).where("gold_count + pred_count > 0"), alignment.predicate_report(p, g, m), complexity(p), details.where(F.col("k") <= args.items).drop("k")):
            df.orderBy("run").show(200, truncate=60)
        m.unpersist()
    elif args.command == "clear":
        print(f"{store.clear()} documents, chunks and entities removed")
    else:
        t = store.tables()
        if args.command == "stats":
            graph_query.stats(t).show()
            graph_query.type_counts(t["entities"]).show()
            graph_query.top_degree(t["entities"], t["relations"]).show()
        elif args.command == "search":
            graph_query.search(t["entities"], t["relations"], args.query, args.limit).show(args.limit, truncate=60)
        elif args.command == "sql":
            graph_query.run_sql(spark, t, args.query).show(100, truncate=60)
        else:
            nodes, edges = graph_query.subgraph(t["entities"], t["relations"], args.limit)
            if args.command in ("view", "browser"):
                out = args.out if args.command == "view" else tempfile.mkstemp(suffix=".html")[1]
                with open(out, "w", encoding="utf-8") as f:
                    f.write(graph_files.to_html(nodes, edges))
                if args.command == "browser":
                    webbrowser.open(f"file://{out}")
            else:
                dot = graph_files.to_dot(nodes, edges)
                if not graph_files.render(dot, args.out):
                    with open(args.out + ".dot", "w", encoding="utf-8") as f:
                        f.write(dot)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
