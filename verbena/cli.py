"""Command line: python -m verbena.cli --root DIR COMMAND ...

Exit codes: 0 done, 10 nothing found, 20 bad use, 40 a failure, 70 interrupted.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame

from verbena import agents, config
from verbena.operators import search
from verbena.service import Collection
from verbena.session import session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="verbena")
    p.add_argument("--root", required=True)
    p.add_argument("--master")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("import", "scan"):
        c = sub.add_parser(name)
        c.add_argument("language")
        c.add_argument("folder")
        c.add_argument("--iso")
    for name, what in (("catalogues", "ask catalogues, take in what is relevant"), ("search", "search engines in rounds, take in what is found"), ("enrich", "read about a language and propose facts")):
        c = sub.add_parser(name, help=what)
        c.add_argument("language")
        c.add_argument("--iso")
    sub.add_parser("history")
    sub.add_parser("languages")
    sub.add_parser("status")
    r = sub.add_parser("review")
    r.add_argument("--item")
    r.add_argument("--decision", choices=["accepted", "rejected", "skipped"])
    g = sub.add_parser("agent", help="agents and which of them are installed, or the one to use")
    g.add_argument("name", nargs="?")
    e = sub.add_parser("registry", help="a user's catalogues, engines and tools")
    e.add_argument("kind", choices=["catalogue", "engine", "tool"])
    e.add_argument("action", choices=["list", "add", "remove"])
    e.add_argument("pairs", nargs="*", metavar="key=value")
    v = sub.add_parser("set")
    for a in ("language", "group", "field", "json"):
        v.add_argument(a)
    return p


def _show(rows: DataFrame, *columns: str) -> int:
    got = rows.select(*columns).limit(200).collect()
    for r in got:
        print("\t".join("" if x is None else str(x) for x in r))
    return 0 if got else 10


def _settings(a: argparse.Namespace) -> int | None:
    """Commands on settings files below the root, which need no Spark; None for any other command."""
    path = os.path.join(a.root, "config.toml")
    if a.command == "agent":
        tools = {e["name"]: e for e in config.entries_of(path, "tool")}
        if a.name:
            agents.choose(path, a.name, tools)
            return 0
        chosen = config.load(path)["agent"].get("provider", agents.RuleAgent.name)
        for name, there, what in [(agents.RuleAgent.name, True, "rules only"), *agents.installed(tools)]:
            print("\t".join(("*" if name == chosen else "", name, "installed" if there else "not installed", what)))
        return 0
    if a.command != "registry":
        return None
    entry = dict(p.partition("=")[::2] for p in a.pairs)
    if a.action == "list":
        held = config.entries_of(path, a.kind)
        for e in held:
            print("\t".join([e["name"], *(f"{k}={v}" for k, v in e.items() if k != "name")]))
        return 0 if held else 10
    os.makedirs(a.root, exist_ok=True)
    if a.action == "remove":
        return 0 if config.remove_entry(path, a.kind, entry.get("name", "")) else 10
    config.add_entry(path, a.kind, entry)
    return 0


def main(args: list[str] | None = None) -> int:
    try:
        a = parser().parse_args(args)
    except SystemExit as e:
        return 0 if e.code == 0 else 20
    try:
        if (done := _settings(a)) is not None:
            return done
        s = config.load(os.path.join(a.root, "config.toml"))
        c = Collection(session("verbena", a.master), a.root, s["relevance"]["review_at"], s["relevance"]["confirmed_at"], s["dedup"]["threshold"], s["archives"]["ingest_members"])
        if a.command in ("import", "scan"):
            language = c.open_language(a.language, a.iso)
            out = c.import_folder(a.folder, language) if a.command == "import" else c.scan_folder(a.folder, language)
            return _show(out.orderBy("path"), "status", "score", "path")
        if a.command == "catalogues":
            usable, _ = config.registry("catalogue", config.entries_of(os.path.join(a.root, "config.toml"), "catalogue"))
            if not usable:
                print("no catalogue: registry catalogue add name=... mode=... url=...", file=sys.stderr)
                return 20
            o = s["online"]
            out = c.search_catalogues(c.open_language(a.language, a.iso), list(usable.values()), download_at=o["min_download_score"], most_bytes=o["max_download_mb"] * 1_000_000, most_files=o["max_files_per_record"])
            return _show(out.orderBy("path"), "status", "score", "path")
        if a.command in ("search", "enrich"):
            usable, _ = config.registry("engine", config.entries_of(os.path.join(a.root, "config.toml"), "engine"))
            entries = [e for e in usable.values() if config.usable(e, s["agent"]["search_keys"]) is None]
            if not entries:
                print("no usable search engine: registry engine add name=... kind=... url=...", file=sys.stderr)
                return 20
            language = c.open_language(a.language, a.iso)
            ask = search.engines(entries, a.language, a.iso)
            if a.command == "enrich":
                print(n := c.enrich(language, ask))
                return 0 if n else 10
            limits = search.SearchLimits(*(s["agent"][k] for k in ("max_rounds", "max_queries", "hits_per_query", "max_pages", "max_depth", "per_host", "max_files")), review_at=c.review_at, confirmed_at=c.confirmed_at)
            return _show(c.search(language, ask, limits=limits).orderBy("path"), "status", "score", "path")
        if a.command == "history":
            return _show(c.sessions(), "session_id", "language_id", "mode", "discovered", "downloaded", "duplicates", "failed", "pending_review")
        if a.command == "languages":
            return _show(c.languages().orderBy("name"), "id", "name")
        if a.command == "set":
            c.set_value(a.language, a.group, a.field, a.json)
            return 0
        if a.command == "review":
            if a.item:
                c.decide(a.item, a.decision or "skipped")
                return 0
            return _show(c.reviews().where("status = 'pending'").orderBy("item_id"), "item_id", "kind", "confidence")
        for k, n in c.home().items():
            print(f"{k}\t{n}")
        return 0
    except KeyboardInterrupt:
        return 70
    except Exception as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 40


if __name__ == "__main__":
    sys.exit(main())
