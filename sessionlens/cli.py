"""Commands: analyze, trend, sessions."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import patterns as P
from .plans import report
from .sinks import render
from .sources import registry, repo
from .sources.tables import written

VERSION = "1.0"


def default_roots() -> dict[str, str]:
    """Where the two kinds of logs lie on this machine."""
    home = os.path.expanduser("~")
    chats = {"darwin": f"{home}/Library/Application Support/Cursor/User", "win32": f"{os.environ.get('APPDATA', home)}/Cursor/User"}.get(sys.platform, f"{home}/.config/Cursor/User")
    return {"jsonl": f"{home}/.claude/projects", "kvdb": f"{chats}/workspaceStorage"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("sessionlens")
    p.add_argument("--version", action="version", version=VERSION)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("analyze", "trend", "sessions"):
        c = sub.add_parser(name)
        c.add_argument("--cwd", default=os.getcwd())
        c.add_argument("--root", action="append", default=[], metavar="SOURCE=PATH")
        if name != "sessions":
            c.add_argument("--json", action="store_true")
        if name == "analyze":
            c.add_argument("--session")
            c.add_argument("--agent")
            c.add_argument("--html")
            c.add_argument("--explain", action="store_true")
            c.add_argument("--fail-on", choices=P.SEVERITIES)
        if name == "trend":
            c.add_argument("--limit", type=int, default=20)
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 if all is well, 1 on errors and on findings at `--fail-on` or above; argparse itself exits with 2."""
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    roots = dict(r.split("=", 1) for r in a.root) or default_roots()
    try:
        return {"analyze": analyze, "trend": trend, "sessions": sessions}[a.command](spark, a, roots)
    except (LookupError, FileNotFoundError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def load(spark: SparkSession, listed, cwd: str):
    """Frames of the listed sessions, by source; the listing is bounded by a limit or a pick."""
    rows = listed.select("agent", "path").collect()
    frames = None
    for agent in dict.fromkeys(r["agent"] for r in rows):
        f = registry.SOURCES[agent].load(spark, [r["path"] for r in rows if r["agent"] == agent])
        frames = f if frames is None else registry.Frames(frames.events.unionByName(f.events), frames.sessions.unionByName(f.sessions))
    if frames is None:
        raise LookupError("no sessions found")
    if os.path.isdir(cwd):
        frames.files = repo.read_sources(spark, cwd)
    return frames


def analyze(spark: SparkSession, a: argparse.Namespace, roots: dict[str, str]) -> int:
    picked = registry.pick_session(registry.list_all(spark, roots, a.cwd), a.session, a.agent)
    frames = load(spark, picked, a.cwd)
    if unread := frames.sessions.where("error IS NOT NULL").first():
        raise LookupError(unread["error"])
    found = written(report.all_findings(frames), "findings")
    session, rows = render.report_rows(report.reports(frames, found), found)
    if a.html:
        with open(a.html, "w", encoding="utf-8") as f:
            f.write(render.as_html(session, rows))
    elif a.json:
        print(render.as_json(session, rows, VERSION))
    else:
        render.write_text(sys.stdout, session, rows, a.explain)
    return int(bool(a.fail_on) and any(r["severity"] >= P.SEVERITIES.index(a.fail_on) for r in rows))


def trend(spark: SparkSession, a: argparse.Namespace, roots: dict[str, str]) -> int:
    frames = load(spark, registry.newest(registry.list_all(spark, roots, a.cwd), a.limit), a.cwd)
    rows = written(report.trend(frames.sessions, report.all_findings(frames)), "trend").orderBy(F.asc_nulls_last("start"), "session_id")
    if a.json:
        print(render.trend_json(rows, VERSION))
    else:
        render.write_trend(sys.stdout, rows)
    return 0


def sessions(spark: SparkSession, a: argparse.Namespace, roots: dict[str, str]) -> int:
    listed = registry.list_all(spark, roots, a.cwd)
    rows = listed.select("agent", "path").collect()
    prompts = None
    for agent in dict.fromkeys(r["agent"] for r in rows):
        p = registry.SOURCES[agent].first_prompts(spark, [r["path"] for r in rows if r["agent"] == agent])
        prompts = p if prompts is None else prompts.unionByName(p)
    render.write_sessions(sys.stdout, listed, prompts if prompts is not None else spark.createDataFrame([], "path string, first_prompt string"))
    return 0


if __name__ == "__main__":
    sys.exit(main())
