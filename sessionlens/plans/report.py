"""Reports of single sessions, and trends over many."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..detectors import DETECTORS
from ..detectors.base import Frames
from ..functions import patterns as P
from ..operators.predicates import fresh_tokens, untested_versions

EXPERIMENTAL = "chat-store sessions are read experimentally: the format is undocumented, and tool calls are not in it"


def all_findings(frames: Frames, detectors=DETECTORS) -> DataFrame:
    """Findings of all detectors over all sessions, with the detector's place as `rank`."""
    return reduce(DataFrame.unionByName, [d.scan(frames).withColumn("rank", F.lit(i)) for i, d in enumerate(detectors)])


def in_report_order(found: DataFrame) -> DataFrame:
    """Severe ones first, then by time, unknown times first; ties as the detectors gave them."""
    return found.orderBy("session_id", F.desc("severity"), F.asc_nulls_first("ts"), "rank", "emit_key")


def clean_events(events: DataFrame, found: DataFrame) -> DataFrame:
    """`session_id, clean_events`: distinct ids of events that no finding names."""
    ids = events.where("uuid <> ''").select("session_id", "uuid").distinct()
    named = found.select("session_id", F.explode("event_uuids").alias("uuid")).distinct()
    left = ids.join(named, ["session_id", "uuid"], "left_anti").groupBy("session_id").agg(F.count(F.lit(1)).alias("clean_events"))
    return events.select("session_id").distinct().join(left, "session_id", "left").select("session_id", F.coalesce("clean_events", F.lit(0)).alias("clean_events"))


def warnings(experimental: Column) -> Column:
    """What a session's diagnostics warn of, in order."""
    s = lambda n: n.cast("string")
    odd, names = F.aggregate(F.map_values("unrecognized"), F.lit(0).cast("bigint"), lambda a, x: a + x), F.sort_array(F.map_keys("unrecognized"))
    listed = F.concat(F.array_join(F.slice(names, 1, 4), ", "), F.when(F.size(names) > 4, ", …").otherwise(""))
    drift = untested_versions(F.col("versions"))
    said = [
        F.when(experimental, F.lit(EXPERIMENTAL)),
        F.when(F.size(drift) > 0, F.concat(F.lit("agent versions "), F.array_join(drift, ", "), F.lit(f" are not among the tested ones ({', '.join(P.TESTED_VERSIONS)}); some events may be missed"))),
        F.when(F.col("sidechain_events") > 0, F.concat(s(F.col("sidechain_events")), F.lit(" events of subagents are left out"))),
        F.when(F.col("compacted"), F.lit("the context was compacted: what was said before counts with less confidence")),
        F.when(odd > 0, F.concat(s(odd), F.lit(" events of unknown types left out ("), listed, F.lit(")"))),
        F.when(F.col("malformed_lines") > 0, F.concat(s(F.col("malformed_lines")), F.lit(" lines could not be read"))),
    ]
    return F.array_compact(F.array(*said))


def duration() -> Column:
    """Seconds from start to end; 0 if either is unknown."""
    return F.coalesce((F.col("end").cast("double") - F.col("start").cast("double")), F.lit(0.0))


def reports(frames: Frames, found: DataFrame) -> DataFrame:
    """A row per session: the session's columns, fresh tokens, duration, clean events and warnings."""
    rows = frames.sessions.join(clean_events(frames.events, found), "session_id", "left")
    return rows.withColumns({"clean_events": F.coalesce("clean_events", F.lit(0)), "fresh": fresh_tokens(F.col("usage")), "duration": duration(), "warnings": warnings(F.col("agent") == "kvdb")})


def trend(sessions: DataFrame, found: DataFrame) -> DataFrame:
    """A row per session with a count per detector, oldest first, sessions of unknown start last; `error` says why one could not be read."""
    labels = [x[0] for x in P.SECTIONS]
    counts = found.groupBy("session_id").pivot("detector", labels).count()
    rows = sessions.select("session_id", "agent", "path", "start", duration().alias("duration"), "events", fresh_tokens(F.col("usage")).alias("tokens"), (F.col("error") if "error" in sessions.columns else F.lit(None).cast("string")).alias("error")).join(counts, "session_id", "left").na.fill(0, labels)
    return rows.orderBy(F.asc_nulls_last("start"), "session_id")


def trend_totals(rows: DataFrame) -> DataFrame:
    """One row: the sum of each detector's findings."""
    return rows.agg(*[F.coalesce(F.sum(f"`{d}`"), F.lit(0)).alias(d) for d, _, _ in P.SECTIONS])


def sections(found: DataFrame) -> DataFrame:
    """`session_id, place, icon, title, detector, n`: the report's sections that have findings, unknown detectors last."""
    spark = found.sparkSession
    known = F.broadcast(spark.createDataFrame([(i, icon, title, d) for i, (d, title, icon) in enumerate(P.SECTIONS)], "place int, icon string, title string, detector string"))
    n = found.groupBy("session_id", "detector").agg(F.count(F.lit(1)).alias("n"))
    return n.join(known, "detector", "left").select("session_id", F.coalesce("place", F.lit(len(P.SECTIONS))).alias("place"), F.coalesce("icon", F.lit("🔎")).alias("icon"), F.coalesce("title", "detector").alias("title"), "detector", "n").orderBy("session_id", "place", "detector")


def fails(found: DataFrame, severity: str) -> bool:
    """Whether any finding is at least so severe; stops at the first."""
    return bool(found.where(F.col("severity") >= P.SEVERITIES.index(severity)).limit(1).count())
