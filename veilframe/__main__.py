"""Command line: python -m veilframe ingest|preview|from-preview|residue|search|review|letter|letter-render|monitor, over Parquet tables."""

from __future__ import annotations

import argparse
import datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import config
from .operators import memory, report, residue, structure, vault
from .plans import ingest, review

COMMANDS = (
    ("ingest", ["out"]), ("preview", ["out"]), ("from-preview", ["preview_vault", "out"]), ("residue", []), ("search", ["subject", "query"]), ("review", ["lists", "out"]), ("letter", ["vault", "lists", "subject"]),
    ("letter-render", ["vault"]), ("monitor", ["lists"]),
)


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="veilframe")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, extra in COMMANDS:
        command = commands.add_parser(name)
        command.add_argument("documents", help="Parquet of subject, seq, doc_id, text (letter and monitor: subject; search and review: path and title as well; letter-render: subject, draft)")
        for x in extra:
            command.add_argument(x)
        command.add_argument("--today", type=datetime.date.fromisoformat, default=datetime.date.today())
        command.add_argument("--synthetic", action="store_true", help="the documents are no real ones, so no detector is needed")
        command.add_argument("--strict", action="store_true")
        command.add_argument("--channel", default="paper")
        command.add_argument("--k", type=int, default=memory.TOP)
        command.add_argument("--config", help="options as YAML or JSON")
        command.add_argument("--known-vault", help="Parquet of the subjects' vault so far")
        command.add_argument("--roles", default="internist", help="comma-separated")
        command.add_argument("--question", default="")
    return parser


def main(arguments: list[str] | None = None) -> None:
    args = _parser().parse_args(arguments)
    spark = SparkSession.builder.appName("veilframe").getOrCreate()
    rows = spark.read.parquet(args.documents)
    options = ingest.Options(args.today, synthetic=args.synthetic, strict=args.strict)
    if args.config:
        known = config.load(args.config)
        options = ingest.Options(args.today, synthetic=args.synthetic, strict=args.strict, policy=known.detection.residue, reviewed=known.runtime.allow_real_documents)
    held = spark.read.parquet(args.known_vault) if args.known_vault else None
    if args.command == "preview":
        ingest.ready(options)
        made = ingest.preview(rows, options, held)
        made.write.parquet(f"{args.out}/preview")
        ingest.preview_reports(spark.read.parquet(f"{args.out}/preview")).write.parquet(f"{args.out}/preview_reports")
    elif args.command in ("ingest", "from-preview"):
        if args.command == "ingest":
            made = ingest.ingest(rows, options, vault_rows=held)
        else:
            made = ingest.from_preview(rows, spark.read.parquet(args.preview_vault), held if held is not None else spark.createDataFrame([], "subject string, token string, kind string, idx int, value string, ord long"), options)
        # The vault has a root of its own, apart from everything that is searched.
        made.vault.write.partitionBy("subject").parquet(f"{args.out}/identity_vault")
        made.documents.write.partitionBy("subject").parquet(f"{args.out}/records/documents")
        made.lists.write.partitionBy("subject").parquet(f"{args.out}/records/lists")
        made.quarantined.write.parquet(f"{args.out}/quarantine")
    elif args.command == "residue":
        residue.policy_summary(rows, options.policy).orderBy("pattern").show(50, False)
    elif args.command == "search":
        memory.search(memory.index(memory.records(rows)), args.query, args.subject, args.k).show(args.k, 80)
    elif args.command == "review":
        cases = rows.select("subject").distinct().withColumns({"roles": F.split(F.lit(args.roles), ","), "question": F.lit(args.question)})
        review.as_json(review.reviewed(cases, memory.records(rows), spark.read.parquet(args.lists), f"{args.today}T00:00:00+00:00", k=args.k)).write.json(f"{args.out}/reports")
    elif args.command == "letter":
        asked = spark.createDataFrame([(args.subject, args.channel, "", "", "", "", "")], "subject string, channel string, sender string, recipient string, place string, subject_line string, body string")
        problems = structure.list_text(spark.read.parquet(args.lists).where("list = 'problems'")).select("subject", "body")
        print(report.letters(asked, spark.read.parquet(args.vault), problems, f"{args.today:%d.%m.%Y}").first().draft)
    elif args.command == "letter-render":
        print(vault.render(rows, spark.read.parquet(args.vault)).first().rendered)  # shown, never stored
    else:
        timelines = structure.list_text(spark.read.parquet(args.lists).where("list = 'timeline'")).select("subject", "body")
        report.monitor(rows.select("subject").distinct(), timelines).show(100, 80)
        report.schedule(rows).show(1, 80)


if __name__ == "__main__":
    main()
