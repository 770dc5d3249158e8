"""Command line: ``spark-submit [--packages ...] main.py count|report|publish|tail``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from callstream.operators.lookups import default_codes
from callstream.plans import jobs
from callstream.sources import file_messages, kafka_messages, offsets_per_trigger, read_codes
from callstream.streaming import run_all


def arguments(words: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, text in {
        "count": "count calls per type and outcome",
        "report": "print the type counts of every batch",
        "publish": "write a record file to a topic or folder",
        "tail": "print the messages of a topic or folder",
    }.items():
        command = commands.add_parser(name, help=text)
        command.add_argument("--servers", help="Kafka servers, host:port,...")
        command.add_argument("--topic", help="Kafka topic")
        command.add_argument("--path", help="folder of message files instead of a topic")
        command.add_argument(
            "--option",
            action="append",
            default=[],
            metavar="NAME=VALUE",
            help="further option of the Kafka source or sink, may be repeated",
        )
        if name != "publish":
            command.add_argument("--checkpoint", help="folder to resume from")
            command.add_argument("--trigger", help='"5 seconds", or "available now" to end')
            command.add_argument("--max-offsets", type=int, help="per micro-batch, 10000 by default")
            command.add_argument("--max-files", type=int, help="of a folder, per micro-batch")
            command.add_argument("--max-bytes", type=int, help="of a folder, per micro-batch")
            command.add_argument("--min-partitions", type=int, help="split long topic partitions")
            command.add_argument("--group-prefix", help="of the consumer group")
        if name == "count":
            command.add_argument("--codes", help="JSON array file of the code table")
            command.add_argument("--occurrences", action="store_true", help="count every call")
            command.add_argument("--tables", help="folder to keep the counts in, not printed")
            command.add_argument("--rows", type=int, default=20, help="groups to print")
        if name == "report":
            command.add_argument("--table", help="folder to keep the counts in")
            command.add_argument("--top", type=int, default=3, help="types to print per batch")
            command.add_argument("--length", type=int, default=60, help="window, in seconds")
            command.add_argument("--slide", type=int, default=15, help="of the window, in seconds")
            command.add_argument(
                "--rate",
                type=int,
                nargs=3,
                metavar=("ROWS", "PARTITIONS", "SECONDS"),
                help="rows per partition and second, topic partitions, seconds of a trigger: "
                "in place of --max-offsets",
            )
        if name == "publish":
            command.add_argument("--file", required=True, help="record file")
            command.add_argument("--lines", action="store_true", help="JSON lines, no array")
            command.add_argument("--checkpoint", help="send what a run with it has not sent yet")
            command.add_argument("--max-files", type=int, help="sent at a time, with --checkpoint")
    args = parser.parse_args(words)
    if not args.path and not (args.servers and args.topic):
        parser.error("name --servers and --topic, or --path")
    topic_only = ["max_offsets", "min_partitions", "group_prefix", "rate", "option"]
    ignored = topic_only if args.path else ["max_files", "max_bytes"]
    if args.command == "publish":
        ignored = ["option"] if args.path else []
        if args.max_files and not args.checkpoint:
            parser.error("--max-files: only with --checkpoint")
    named = [f"--{name.replace('_', '-')}" for name in ignored if getattr(args, name, None)]
    if named:
        parser.error(f"{', '.join(named)}: not for {'--path' if args.path else 'a topic'}")
    if any("=" not in option for option in args.option):
        parser.error("--option takes NAME=VALUE")
    return args


def further_options(args: argparse.Namespace) -> dict[str, str]:
    return dict(option.split("=", 1) for option in args.option)


def messages(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if args.path:
        return file_messages(spark, args.path, max_files=args.max_files, max_bytes=args.max_bytes)
    rate = getattr(args, "rate", None)
    return kafka_messages(
        spark,
        args.servers,
        args.topic,
        max_offsets=offsets_per_trigger(*rate) if rate else args.max_offsets or 10_000,
        min_partitions=args.min_partitions,
        group_prefix=args.group_prefix,
        **further_options(args),
    )


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.command == "count":
        codes = read_codes(spark, args.codes) if args.codes else default_codes(spark)
        shared = {
            "trigger": args.trigger,
            "checkpoint": args.checkpoint,
            "dedup": not args.occurrences,
        }
        stream = messages(spark, args)
        if args.tables:
            run_all([jobs.start_statistics_tables(stream, codes, args.tables, **shared)])
        else:
            deliver = jobs.onto_console(args.rows)
            run_all(jobs.start_call_statistics(stream, codes, deliver, **shared))
    elif args.command == "report":
        report = jobs.start_call_report(
            messages(spark, args),
            args.table,
            args.trigger or "5 seconds",
            args.checkpoint,
            top=args.top,
            length=args.length,
            slide=args.slide,
        )
        run_all([report])
    elif args.command == "publish":
        target = (
            {"fmt": "text", "path": args.path}
            if args.path
            else {"kafka.bootstrap.servers": args.servers, "topic": args.topic}
            | further_options(args)
        )
        if args.checkpoint:
            shared = {"multi_line": not args.lines, "max_files": args.max_files}
            run_all([jobs.start_publishing(spark, args.file, args.checkpoint, **shared, **target)])
        else:
            jobs.publish_file(spark, args.file, multi_line=not args.lines, **target)
    else:
        run_all([jobs.start_tail(messages(spark, args), args.trigger, args.checkpoint)])


def main() -> None:
    args = arguments()
    spark = SparkSession.builder.appName(f"callstream {args.command}").getOrCreate()
    run(spark, args)
    spark.stop()


if __name__ == "__main__":
    main()
