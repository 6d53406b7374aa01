"""The command line: python -m foliant.cli COMMAND --store FOLDER."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from foliant.chat.models import Echo, LlmClient
from foliant.engine import Engine
from foliant.operators import routing

COMMANDS = {
    "ingest": "read files into the store", "chunk": "make chunks of blocks", "index": "index and encode chunks", "build": "chunk and index", "search": "find chunks", "ask": "answer a question",
    "summarise": "sum up a document", "list": "list documents, or a document's sections", "diagnose": "count rows and what lacks its parent", "reset": "delete the corpus", "chat": "ask on and on",
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="foliant", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)
    for name, says in COMMANDS.items():
        c = commands.add_parser(name, help=says, aliases=["summarize"] if name == "summarise" else [])
        c.add_argument("--store", required=True)
        if name == "ingest":
            c.add_argument("path")
            c.add_argument("--force", action="store_true")
        if name in ("chunk", "build"):
            c.add_argument("--again", action="store_true")
            c.add_argument("--semantic", action="store_true")
        if name in ("search", "ask", "summarise"):
            c.add_argument("text")
        if name in ("search", "ask", "chat"):
            c.add_argument("--top-k", type=int, default=5 if name == "search" else 8)
            c.add_argument("--mode", choices=("hybrid", "lexical", "semantic"), default="hybrid")
            c.add_argument("--no-rerank", action="store_true")
        if name == "list":
            c.add_argument("--document-id", type=int)
    return p


def chat(engine: Engine, client: LlmClient, read=input, say=print, turns: int = 6, **how) -> None:
    """Ask until quit. forget drops what was said; questions about the corpus are answered from its tables."""
    said: list[tuple[str, str]] = []
    while True:
        try:
            line = read("> ").strip()
        except EOFError:
            return
        if line.lower() in ("quit", "exit"):
            return
        if line.lower() == "forget":
            said = []
            continue
        one = engine.spark.createDataFrame([(line,)], "text string").select(routing.intent(F.col("text")).alias("intent"), routing.summary_ref(F.col("text")).alias("ref")).first()
        if one.intent == "listing":
            answer = "\n".join(f"[{r.document_id}] {r.filename}" for r in engine.store.read("documents").orderBy("document_id").collect())
        elif one.intent == "language":
            chunks = engine.store.read("chunks").select("document_id", "chunk_id", F.col("text_content").alias("text"))
            answer = "\n".join(f"{r.document_id}: {r.language}" for r in routing.detected_languages(chunks).orderBy("document_id").collect())
        elif one.ref is not None:
            answer = engine.summarise(client, one.ref)
        else:
            history = "\n".join(f"User: {q}\nAssistant: {a}" for q, a in said[-turns:])
            answer = engine.ask(client, line, history, **how)
            said.append((line, answer))
        say(answer)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, client: LlmClient | None = None, say=print) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    client = client or Echo()
    engine = Engine(spark, args.store, must_exist=args.command != "ingest")
    how = {"k": args.top_k, "mode": args.mode, "rerank": not args.no_rerank} if hasattr(args, "top_k") else {}
    match args.command:
        case "ingest":
            for r in engine.ingest(args.path, force=args.force).orderBy("path").collect():
                say(r.path, r.outcome)
        case "chunk" | "build":
            say(engine.chunk(args.again, args.semantic), "chunks added")
            if args.command == "build":
                engine.index()
        case "index":
            engine.index()
        case "search":
            for r in engine.retrieve(args.text, **how).orderBy("pos").collect():
                say(r.pos, r.citation, r.text[:200])
        case "ask":
            say(engine.ask(client, args.text, **how))
        case "summarise" | "summarize":
            say(engine.summarise(client, args.text))
        case "list":
            rows = engine.store.read("documents").select("document_id", "filename", "page_count").orderBy("document_id")
            if args.document_id is not None:
                rows = engine.store.read("chunks").where((F.col("document_id") == args.document_id) & F.col("section_title").isNotNull()).groupBy("section_title").agg(F.min("chunk_id").alias("first")).orderBy("first")
            for r in rows.collect():
                say(*r)
        case "diagnose":
            for name, n in engine.diagnose().items():
                say(name, n)
        case "reset":
            say(engine.store.reset(), "documents deleted")
        case "chat":
            chat(engine, client, **how)


if __name__ == "__main__":
    main()
