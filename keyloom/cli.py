"""Command line: dump snapshots into a store, report on a batch, print the schema.

    python -m keyloom.cli dump from-file --path dump.rdb --cluster c --instance 10.0.0.1:6379 into-parquet --dir /data/store
    python -m keyloom.cli report --dir /data/store --cluster c

Options may also come from the environment: KEYLOOM_<OPTION>, as KEYLOOM_CLUSTER or KEYLOOM_BATCH.
"""

from __future__ import annotations

import argparse
import os
import sys
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import SparkSession

from keyloom.functions.formatting import format_rfc3339_ns, parse_rfc3339_ns, report_name

MOST_CONCURRENCY = 1000


def _time(text: str) -> str:
    parse_rfc3339_ns(text)
    return text


def _concurrency(text: str) -> int:
    n = int(text)
    if not 1 <= n <= MOST_CONCURRENCY:
        raise ValueError
    return n


def parser() -> argparse.ArgumentParser:
    env = lambda name: os.environ.get(f"KEYLOOM_{name}")

    def option(p, flag: str, required: bool = False, **kwargs) -> None:
        value = env(flag.strip("-").replace("-", "_").upper())
        p.add_argument(flag, default=value if value is not None else kwargs.pop("default", None), required=required and value is None, **kwargs)

    top = argparse.ArgumentParser(prog="keyloom", description=__doc__.splitlines()[0])
    commands = top.add_subparsers(dest="command", required=True)
    dump = commands.add_parser("dump", help="read snapshots into a store")
    option(dump, "--prometheus", default="")
    option(dump, "--concurrency", type=_concurrency, default=max(1, min(8, (os.cpu_count() or 2) // 2)))
    sources = dump.add_subparsers(dest="source", required=True)
    for name, mode in (("from-standalone", "standalone"), ("from-cluster", "cluster"), ("from-file", "file"), ("from-codis", "codis")):
        p = sources.add_parser(name)
        p.set_defaults(mode=mode)
        option(p, "--cluster", required=mode != "codis")
        option(p, "--batch", type=_time)
        if mode == "file":
            option(p, "--path", required=True)
            option(p, "--instance", required=True)
        if mode == "standalone":
            option(p, "--addr", required=True)
        if mode == "cluster":
            option(p, "--nodes", required=True)
        if mode == "codis":
            option(p, "--dashboard", required=True)
        if mode in ("standalone", "cluster"):
            option(p, "--username", default="")
        if mode != "file":
            option(p, "--password", default="")
        if mode in ("cluster", "codis"):
            p.add_argument("--require-slave", action="store_true")
        sinks = p.add_subparsers(dest="sink", required=True)
        files = sinks.add_parser("into-parquet")
        option(files, "--dir", required=True)
        option(files, "--compression", default="zstd", choices=["zstd", "snappy", "none", "lz4", "gzip"])
        server = sinks.add_parser("into-clickhouse")
        option(server, "--url", required=True)
        option(server, "--proxy-url", default="")
        server.add_argument("--auto-create-tables", action="store_true", default=env("AUTO_CREATE_TABLES") in ("1", "true"))
        tables = sinks.add_parser("into-tables")
        option(tables, "--database", default="default")
        tables.add_argument("--auto-create-tables", action="store_true")
    report = commands.add_parser("report", help="write the page of a batch")
    option(report, "--dir")
    option(report, "--url")
    option(report, "--proxy-url", default="")
    option(report, "--cluster", required=True)
    option(report, "--batch")
    option(report, "--output")
    option(report, "--format", default="html", choices=["html", "json", "prefixes-csv", "keys-csv"])
    misc = commands.add_parser("misc", help="utilities").add_subparsers(dest="what", required=True)
    schema = misc.add_parser("schema", help="print the statements that make the tables")
    option(schema, "--database", default="default")
    misc.add_parser("clickhouse-schema", help="print the statements for a ClickHouse server")
    completion = misc.add_parser("completion", help="print a completion script")
    option(completion, "--shell", default=Path(os.environ.get("SHELL", "bash")).name, choices=["bash", "zsh", "fish"])
    return top


def _words(p: argparse.ArgumentParser) -> dict[str, list[str]]:
    """What may follow each subcommand."""
    out: dict[str, list[str]] = {}

    def walk(p: argparse.ArgumentParser, name: str) -> None:
        own = out.setdefault(name, [])
        for action in p._actions:
            own += [f for f in action.option_strings if f.startswith("--") and f not in own]
            if isinstance(action, argparse._SubParsersAction):
                own += [c for c in action.choices if c not in own]
                for child, below in action.choices.items():
                    walk(below, child)

    walk(p, "keyloom")
    return out


def completion_script(shell: str) -> str:
    """Words by the last subcommand on the line."""
    words = _words(parser())
    if shell == "fish":
        lines = []
        for name, own in words.items():
            seen = "__fish_use_subcommand" if name == "keyloom" else f"__fish_seen_subcommand_from {name}"
            lines.append(f"complete -c keyloom -f -n '{seen}' -a '{' '.join(own)}'")
        return "\n".join(lines) + "\n"
    cases = "\n".join(f"      {name}) found='{' '.join(own)}' ;;" for name, own in words.items())
    start = "autoload -U +X bashcompinit && bashcompinit\n" if shell == "zsh" else ""
    return f"""{start}_keyloom() {{
  local found='' word
  for word in "${{COMP_WORDS[@]:0:COMP_CWORD}}"; do
    case "$word" in
{cases}
    esac
  done
  COMPREPLY=($(compgen -W "$found" -- "${{COMP_WORDS[COMP_CWORD]}}"))
}}
complete -F _keyloom keyloom
"""


def run_dump(spark: SparkSession, args) -> str:
    from keyloom.plans.metrics import Metrics, serve
    from keyloom.sinks import clickhouse
    from keyloom.sinks.batches import Store, append_to_tables
    from keyloom.sources import discovery
    from keyloom.sources.rdb_source import register

    register(spark)
    batch = args.batch or format_rfc3339_ns(int(datetime.now(timezone.utc).timestamp() * 10**6) * 1000)
    cluster = args.cluster or discovery.codis_product(args.dashboard)
    options = {"mode": args.mode, "cluster": cluster, "batch": batch, "require_slave": str(getattr(args, "require_slave", False)).lower()}
    for name in ("path", "instance", "addr", "nodes", "dashboard", "username", "password"):
        if getattr(args, name, None):
            options[name] = getattr(args, name)
    records = spark.read.format("rdb").options(**options).load()
    instances = options["instance"].split(",") if args.mode == "file" else None
    # One instance a partition; fewer partitions read at the same time where the servers should be spared.
    if args.mode != "file":
        records = records.coalesce(args.concurrency)
    metrics = Metrics()
    endpoint = serve(metrics, args.prometheus) if args.prometheus else None
    if endpoint:
        records = metrics.observed(records, batch)
    try:
        if args.sink == "into-clickhouse":
            clickhouse.write(records, clickhouse.ClickHouse(args.url, args.proxy_url), cluster, batch, args.auto_create_tables)
            return f"{cluster} {batch}"
        if args.sink == "into-tables":
            append_to_tables(spark, records, cluster, batch, instances or [], args.auto_create_tables, args.database)
            return f"{cluster} {batch}"
        store = Store(spark, args.dir)
        return store.write(records, cluster, batch, instances, args.compression)
    finally:
        if endpoint:
            endpoint.shutdown()


def run_report(spark: SparkSession, args) -> str:
    from keyloom.plans import render
    from keyloom.plans.report import build_report
    from keyloom.sinks import clickhouse
    from keyloom.sinks.batches import Store

    summary = None
    if args.url:
        clickhouse.register(spark)
        options = {"url": args.url, "proxy": args.proxy_url, "cluster": args.cluster} | ({"batch": args.batch} if args.batch else {})
        records = spark.read.format("clickhouse_records").options(**options).load()
    else:
        store = Store(spark, args.dir)
        records, summary = store.read(args.cluster, args.batch), store.summary(args.cluster, args.batch)
    report = build_report(records, args.cluster, args.batch if args.url else None, summary=summary)
    suffix = args.format.rpartition("-")[2]
    made = {"html": render.render_page, "json": lambda r: r.to_json(readable=True), "prefixes-csv": render.prefixes_csv, "keys-csv": render.keys_csv}
    path = args.output or report_name(args.cluster, report.batch, suffix)
    Path(path).write_text(made[args.format](report), encoding="utf-8")
    return path


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "misc":
        from keyloom.sinks import batches, clickhouse

        if args.what == "completion":
            print(completion_script(args.shell), end="")
        else:
            print(";\n\n".join(batches.ddl(args.database) if args.what == "schema" else clickhouse.ddl()) + ";")
        return 0
    if args.command == "report" and bool(args.dir) == bool(args.url):
        parser().error("report needs either --dir or --url")
    spark = SparkSession.builder.appName("keyloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    print({"dump": run_dump, "report": run_report}[args.command](spark, args))
    return 0


if __name__ == "__main__":
    sys.exit(main())
