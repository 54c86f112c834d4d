"""``python -m quillspark run`` makes a report; ``config <command>`` says what the configuration holds, and whether it is sound."""

from __future__ import annotations

import argparse
import sys

from .sources import config


def _run(args, tree: dict) -> int:
    import tempfile
    import uuid
    from datetime import datetime, timezone

    from pyspark.sql import SparkSession

    from .operators.summaries import StubClient
    from .plans import digest
    from .sources import chat, weather

    spark = SparkSession.builder.appName("quillspark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    work = args.work or spark.conf.get("spark.checkpoint.dir", None)
    if not work:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            print("--work or spark.checkpoint.dir must name a shared folder", file=sys.stderr)
            return 1
        work = "file://" + tempfile.mkdtemp(prefix="quillspark-run-")

    def store(df):
        path = f"{work.rstrip('/')}/run-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    llm = tree.get("llm") or {}
    client = StubClient() if args.stub or not llm.get("endpoint") else chat.ChatClient(llm["endpoint"], llm.get("model", ""), llm.get("key_env"), float(llm.get("temperature", 0.0)), int(llm.get("max_tokens", 1200)), float(llm.get("timeout", 120.0)))
    now = datetime.fromisoformat(args.now) if args.now else datetime.now(timezone.utc).replace(tzinfo=None)
    code, path, issues = digest.run_config(spark, tree, now, client, weather.web_fetch(spark, args.transport), store)
    print("\n".join([*issues, path]))
    return code


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillspark")
    parser.add_argument("--config", help="a YAML file; else the usual places")
    top = parser.add_subparsers(dest="group", required=True)
    sub = top.add_parser("config").add_subparsers(dest="command", required=True)
    for name in ("validate", "show", "list-categories", "list-lakes"):
        sub.add_parser(name)
    sub.add_parser("show-prompt").add_argument("name")
    sub.add_parser("check-connectivity")
    go = top.add_parser("run", help="fetches, enriches, writes and validates a report")
    go.add_argument("--transport", help="module:function in the place of HTTP")
    go.add_argument("--now", help="an ISO time in the place of the clock's, UTC")
    go.add_argument("--stub", action="store_true", help="made-up summaries instead of a model's")
    go.add_argument("--work", help="a folder shared by all executors, for what is fetched once")
    args = parser.parse_args(argv)
    path = config.find_config(args.config)
    if path is None:
        print("no configuration found", file=sys.stderr)
        return 1
    tree = config.load_config(path)
    if args.group == "run":
        return _run(args, tree)
    if args.command == "validate":
        passed, issues = config.validate_config(tree)
        print("\n".join([*issues, "sound" if passed else f"{len(issues)} issues"]))
        return 0 if passed else 1
    if args.command == "show":
        import yaml

        print(yaml.safe_dump(tree, sort_keys=False, allow_unicode=True), end="")
    elif args.command == "list-categories":
        for name, c in (tree.get("categories") or {}).items():
            print(f"{name}\t{c.get('query') or ''}\t{c.get('max_stories', 0)}")
    elif args.command == "list-lakes":
        for name, url in (config.lookup(tree, "weather.lakes") or {}).items():
            print(f"{name}\t{url}")
    elif args.command == "show-prompt":
        text = config.lookup(tree, f"prompts.{args.name}")
        if text is None:
            print(f"no prompt {args.name}", file=sys.stderr)
            return 1
        print(text)
    else:
        from .plans import probes
        from .sources.http import _urllib

        results = probes.run_probes({n: probes.url_probe(u, _urllib) for n, u in (config.lookup(tree, "weather.lakes") or {}).items()})
        print(probes.shown(results))
        return 0 if all(r["ok"] for r in results) else 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
