"""Catalogue of recording files: attributes from paths, sessions, views, calibrations."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def build_regex(spec: dict) -> str:
    """Pattern of a specification: ``_path_`` with each name in braces made a named group. ``view`` is mandatory."""
    if "_path_" not in spec or "view" not in spec:
        raise ValueError("a specification needs _path_ and view")
    pattern = spec["_path_"]
    for name, of in spec.items():
        if name != "_path_":
            pattern = pattern.replace("{{" + name + "}}", f"(?<{name}>{of})")
    return pattern


def group_names(pattern: str) -> list[str]:
    return re.findall(r"\(\?<([A-Za-z][A-Za-z0-9]*)>", pattern)


def parse_paths(files: DataFrame, pattern: str, path: str = "path") -> DataFrame:
    """Files that match, with a column for each named group."""
    names = group_names(pattern)
    numbers = {n: len(re.findall(r"(?<!\\)\((?!\?)|\(\?<[A-Za-z]", pattern[: pattern.index(f"(?<{n}>")])) + 1 for n in names}
    found = files.filter(F.col(path).rlike(pattern))
    return found.withColumns({n: F.regexp_extract(path, pattern, k) for n, k in numbers.items()})


def select_sessions(files: DataFrame, sessions: DataFrame) -> DataFrame:
    """Files of the listed sessions; a null in another column of the list fits any value. The list is configuration."""
    filters = [c for c in sessions.columns if c != "session"]
    listed = sessions.select("session", *(F.col(c).alias(f"_{c}") for c in filters))
    fits = F.col("f.session") == F.col("s.session")
    for c in filters:
        fits = fits & (F.col(f"s._{c}").isNull() | (F.col(f"f.{c}") == F.col(f"s._{c}")))
    return files.alias("f").join(F.broadcast(listed.alias("s")), fits, "left_semi")


def recording_name(path: Column, view: Column) -> Column:
    """Path without its view part, folder and extension."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")
    return F.replace(stem, F.concat(F.lit("_"), view, F.lit("_")), F.lit("_"))


def group_views(files: DataFrame) -> DataFrame:
    """One row per session and recording: a map of its views to their paths. Of equal views the least path stays."""
    one = files.withColumn("name", recording_name(F.col("path"), F.col("view"))).groupBy("session", "name", "view").agg(F.min("path").alias("path"))
    views = F.map_from_entries(F.array_sort(F.collect_list(F.struct("view", "path"))))
    return one.groupBy("session", "name").agg(views.alias("views"), F.count("*").alias("n_views"))


def match_calibration(recordings: DataFrame, calibrations: DataFrame) -> DataFrame:
    """Calibrations of each recording: same session and no shared attribute that differs."""
    r, c = recordings.alias("r"), calibrations.alias("c")
    agree = F.forall(F.map_keys("r.attributes"), lambda k: ~F.map_contains_key("c.attributes", k) | (F.col("r.attributes")[k] == F.col("c.attributes")[k]))
    return r.join(c, (F.col("r.session") == F.col("c.session")) & agree).select("r.session", F.col("r.name").alias("recording"), F.col("c.name").alias("calibration"))


def uncalibrated(recordings: DataFrame, matched: DataFrame) -> DataFrame:
    """Recordings for which ``match_calibration`` found nothing: (session, name)."""
    known = matched.select("session", F.col("recording").alias("name")).distinct()
    return recordings.select("session", "name").join(known, ["session", "name"], "left_anti")


def match_ephys(recordings: DataFrame, ephys: DataFrame, keys) -> DataFrame:
    """One to one, in alphabetical order of names within equal keys."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("name"))
    r = recordings.select(*keys, F.col("name").alias("recording"), number.alias("_n"))
    e = ephys.select(*keys, F.col("name").alias("ephys"), number.alias("_n"))
    return r.join(e, [*keys, "_n"]).drop("_n")


def repeated_keys(files: DataFrame, keys) -> DataFrame:
    """Keys that more than one file has, with their number: their pairing follows names alone."""
    return files.groupBy(*keys).agg(F.count("*").alias("files")).filter("files > 1")


def match_ephys_partial(recordings: DataFrame, ephys: DataFrame) -> DataFrame:
    """One to one within a session, where no attribute that both have differs: (session, recording, ephys).

    Recordings in alphabetical order take the first free file that agrees. The files of a session are
    matched in one group; a recording looks up the files with each set of attributes by the values that both have, so the
    work goes with the files, not with their pairs.
    """

    def each(table):
        from collections import defaultdict, deque

        import pandas as pd

        ordered = table.sort_values("name", kind="stable")
        sides = {k: [(r.session, r.name, {x["key"]: x["value"] for x in r.attributes}) for r in g.itertuples()] for k, g in ordered.groupby("side")}
        # Files with the same names of attributes, in their order.
        alike = defaultdict(list)
        for place, (_, name, has) in enumerate(sides.get(1, [])):
            alike[frozenset(has)].append((place, name, has))
        queues, used, out = {}, set(), []

        def first_free(names, has):
            """The queue of the files with attributes ``names`` that agree with ``has``, the next free one in front."""
            shared = tuple(sorted(names & has.keys()))
            if (names, shared) not in queues:
                queues[names, shared] = made = defaultdict(deque)
                for place, name, own in alike[names]:
                    made[tuple(own[k] for k in shared)].append((place, name))
            queue = queues[names, shared].get(tuple(has[k] for k in shared), ())
            while queue and queue[0][1] in used:
                queue.popleft()
            return queue

        for session, name, has in sides.get(0, []):
            free = [q[0] for names in alike if (q := first_free(names, has))]
            if free:
                found = min(free)[1]
                used.add(found)
                out.append((session, name, found))
        return pd.DataFrame(out, columns=["session", "recording", "ephys"])

    both = recordings.select("session", "name", "attributes", F.lit(0).alias("side")).union(ephys.select("session", "name", "attributes", F.lit(1)))
    both = both.withColumn("attributes", F.map_entries("attributes"))
    return both.groupBy("session").applyInPandas(each, "session string, recording string, ephys string")


def summarise_manifest(files: DataFrame) -> DataFrame:
    """(session, view, recordings, files): the views of each session, how many recordings have them, and files."""
    named = files.withColumn("_name", recording_name(F.col("path"), F.col("view")))
    return named.groupBy("session", "view").agg(F.count_distinct("_name").alias("recordings"), F.count("*").alias("files"))


def keypoints_per_group(points: DataFrame, groups: DataFrame, keys=("recording",)) -> DataFrame:
    """(keys, name, keypoints): how many keypoints of each group (name, keypoints) a table of points (keypoint) has."""
    members = groups.select("name", F.explode("keypoints").alias("keypoint"))
    return points.select(*keys, "keypoint").distinct().join(members, "keypoint").groupBy(*keys, "name").agg(F.count("*").alias("keypoints"))


def session_status(available: DataFrame, configured: DataFrame) -> DataFrame:
    """Configured sessions that are there, then new ones, flagged."""
    kept = available.join(configured, "session", "left_semi").withColumn("status", F.lit("configured"))
    return kept.unionByName(available.join(configured, "session", "left_anti").withColumn("status", F.lit("new")))
