"""Queries on file catalogues and annotations, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from posegrid.functions import measurements as m
from posegrid.operators import annotations as ann
from posegrid.operators import manifest, tables
from posegrid.sources import derived, readers

from .series import POSE

QUERIES, ORACLES = {}, {}


def query(name, sql):
    def add(run):
        QUERIES[name], ORACLES[name] = run, sql
        return run

    return add


SPEC = {"_path_": "^{{date}}_{{animal}}_chew_{{kind}}_000_{{view}}_fullres.*$", "date": r"\d{8}", "animal": r"B\d+", "kind": "awake|anes|cal", "view": "[A-Z]+"}
FILES = """fl AS (SELECT strftime(o_orderdate, '%Y%m%d') AS date, 'B' || o_custkey % 50 AS animal, CASE WHEN o_orderkey % 5 = 0 THEN 'cal' WHEN o_orderkey % 2 = 0 THEN 'awake' ELSE 'anes' END AS kind,
  list_extract(['TL', 'TR', 'L', 'R', 'TC', 'BC'], CAST(o_orderkey % 6 AS INTEGER) + 1) AS view FROM orders), p AS (SELECT date || '_' || animal || '_chew_' || kind || '_000_' || view || '_fullres_12-00-00.avi' AS path, * FROM fl)"""


def _parsed(spark, sf):
    return manifest.parse_paths(derived.files(spark, sf), manifest.build_regex(SPEC))


@query("m01_regex_match", f"WITH {FILES} SELECT count(*) AS files, count(DISTINCT path) AS names FROM p WHERE regexp_matches(path, '^[0-9]{{8}}_B[0-9]+_chew_(awake|anes|cal)_000_[A-Z]+_fullres')")
def _(spark, sf):
    return _parsed(spark, sf).agg(F.count("*").alias("files"), F.countDistinct("path").alias("names"))


@query("m02_parse_paths", f"WITH {FILES} SELECT path, date, animal, kind, view FROM p")
def _(spark, sf):
    return _parsed(spark, sf).select("path", "date", "animal", "kind", "view")


@query("s02_key_columns", f"WITH {FILES} SELECT animal, kind = 'awake' AS awake, count(*) AS n FROM p GROUP BY ALL")
def _(spark, sf):
    files = tables.with_key_columns(derived.files(spark, sf), {"animal": 2}, {"awake": "awake"})
    return files.groupBy("animal", "awake").agg(F.count("*").alias("n"))


@query("s03_skip_inputs", f"WITH {FILES} SELECT path FROM p WHERE date >= '19950101' AND kind <> 'awake' AND NOT contains(path, 'TC')")
def _(spark, sf):
    files = tables.with_key_columns(derived.files(spark, sf), {"date": 1})
    return tables.without_names(files.filter("date >= '19950101'"), ["awake", "TC"], "path").select("path")


@query("m03_select_sessions", f"WITH {FILES} SELECT path FROM p WHERE animal = 'B3' OR (animal = 'B7' AND kind = 'anes')")
def _(spark, sf):
    wanted = spark.createDataFrame([("B3", None), ("B7", "anes")], "session string, kind string")
    return manifest.select_sessions(_parsed(spark, sf).withColumn("session", F.col("animal")), wanted).select("path")


@query(
    "m04_group_views",
    f"""WITH {FILES}, n AS (SELECT DISTINCT animal AS session, date || '_' || animal || '_chew_' || kind || '_000_fullres_12-00-00' AS name, view FROM p)
    SELECT session, name, count(*) AS n_views, string_agg(view, '+' ORDER BY view) AS views FROM n GROUP BY session, name""",
)
def _(spark, sf):
    found = manifest.group_views(_parsed(spark, sf).withColumn("session", F.col("animal")))
    return found.select("session", "name", "n_views", F.array_join(F.map_keys("views"), "+").alias("views"))


@query("m05_split_calibration", f"WITH {FILES} SELECT kind = 'cal' AS calibration, count(*) AS n FROM p GROUP BY 1")
def _(spark, sf):
    return _parsed(spark, sf).groupBy((F.col("kind") == "cal").alias("calibration")).agg(F.count("*").alias("n"))


RECS = f"{FILES}, rc AS (SELECT DISTINCT animal AS session, date, kind, date || '_' || kind AS name FROM p)"


def _recordings(spark, sf):
    r = _parsed(spark, sf).select(F.col("animal").alias("session"), "date", "kind", F.concat("date", F.lit("_"), "kind").alias("name")).distinct()
    return r.withColumn("attributes", F.create_map(F.lit("month"), F.substring("date", 1, 6), F.col("kind"), F.lit("y")))


@query(
    "m06_match_calibration",
    f"WITH {RECS} SELECT r.session, r.name AS recording, c.name AS calibration FROM rc r JOIN rc c ON r.session = c.session AND r.kind <> 'cal' AND c.kind = 'cal' AND left(r.date, 6) = left(c.date, 6)",
)
def _(spark, sf):
    r = _recordings(spark, sf)
    return manifest.match_calibration(r.filter("kind <> 'cal'"), r.filter("kind = 'cal'"))


@query(
    "m06_uncalibrated",
    f"WITH {RECS} SELECT session, name FROM rc r WHERE kind <> 'cal' AND NOT EXISTS (SELECT 1 FROM rc c WHERE r.session = c.session AND c.kind = 'cal' AND left(r.date, 6) = left(c.date, 6))",
)
def _(spark, sf):
    r = _recordings(spark, sf)
    own = r.filter("kind <> 'cal'")
    return manifest.uncalibrated(own, manifest.match_calibration(own, r.filter("kind = 'cal'")))


@query("m07_repeated_keys", f"WITH {RECS} SELECT session, left(date, 4) AS year, count(*) AS files FROM rc WHERE kind = 'anes' GROUP BY ALL HAVING count(*) > 1")
def _(spark, sf):
    r = _recordings(spark, sf).filter("kind = 'anes'").withColumn("year", F.substring("date", 1, 4))
    return manifest.repeated_keys(r, ["session", "year"])


@query(
    "m07_match_partial",
    f"""WITH {RECS}, a AS (SELECT session, name, left(date, 6) AS mo, row_number() OVER (PARTITION BY session, left(date, 6) ORDER BY name) AS k FROM rc WHERE kind = 'awake'),
    b AS (SELECT session, name, left(date, 6) AS mo, row_number() OVER (PARTITION BY session, left(date, 6) ORDER BY name) AS k FROM rc WHERE kind = 'anes') SELECT session, a.name AS recording, b.name AS ephys FROM a JOIN b USING (session, mo, k)""",
)
def _(spark, sf):
    """Files share the month only; their other attributes have names of their own."""
    r = _recordings(spark, sf)
    return manifest.match_ephys_partial(r.filter("kind = 'awake'"), r.filter("kind = 'anes'"))


@query(
    "m07_match_ephys",
    f"""WITH {RECS}, a AS (SELECT session, name, row_number() OVER (PARTITION BY session ORDER BY name) AS k FROM rc WHERE kind = 'awake'), b AS (SELECT session, name, row_number() OVER (PARTITION BY session ORDER BY name) AS k FROM rc WHERE kind = 'anes')
    SELECT session, a.name AS recording, b.name AS ephys FROM a JOIN b USING (session, k)""",
)
def _(spark, sf):
    r = _recordings(spark, sf)
    return manifest.match_ephys(r.filter("kind = 'awake'"), r.filter("kind = 'anes'"), ["session"])


@query("m08_summary", f"WITH {FILES} SELECT animal AS session, view, count(DISTINCT date || kind) AS recordings, count(*) AS files FROM p GROUP BY ALL")
def _(spark, sf):
    return manifest.summarise_manifest(_parsed(spark, sf).withColumnRenamed("animal", "session"))


_GROUPS = ", ".join(f"('{n}', '{k}')" for n, ks in m.GROUPS.items() for k in ks)


@query(
    "m08_keypoint_groups",
    f"WITH {POSE}, gr(name, keypoint) AS (VALUES {_GROUPS}), q AS (SELECT DISTINCT recording, list_extract({list(m.KEYPOINTS)!r}, kp + 1) AS keypoint FROM pose WHERE kp % 3 <> recording % 3) SELECT recording, name, count(*) AS keypoints FROM q JOIN gr USING (keypoint) GROUP BY ALL",
)
def _(spark, sf):
    points = derived.pose_long(spark, sf).filter("kp % 3 <> recording % 3")
    return manifest.keypoints_per_group(points, spark.createDataFrame(list(m.GROUPS.items()), "name string, keypoints array<string>"))


@query("m09_session_status", f"WITH {FILES} SELECT DISTINCT animal AS session, CASE WHEN CAST(substr(animal, 2) AS INTEGER) < 20 THEN 'configured' ELSE 'new' END AS status FROM p")
def _(spark, sf):
    available = _parsed(spark, sf).select(F.col("animal").alias("session")).distinct()
    configured = available.filter(F.substring("session", 2, 9).cast("int") < 20)
    return manifest.session_status(available, configured)


# ---- annotations

ANN = """an AS (SELECT 'img' || l_orderkey || '.png' AS filename, 'kp' || l_linenumber AS keypoint, CASE WHEN l_returnflag <> 'R' THEN l_quantity END AS x, CASE WHEN l_returnflag <> 'R' THEN l_extendedprice / 100 END AS y FROM lineitem),
 one AS (SELECT filename, keypoint, arg_min_null(x, [coalesce(x, -1), coalesce(y, -1)]) AS x, arg_min_null(y, [coalesce(x, -1), coalesce(y, -1)]) AS y FROM an GROUP BY ALL)"""


def _points(spark, sf):
    return derived.annotations(spark, sf).groupBy("filename", "keypoint").agg(F.min(F.struct("x", "y")).alias("p")).select("filename", "keypoint", "p.x", "p.y")


@query("n01_annotations_long", f"WITH {ANN} SELECT filename, keypoint, x, round(y, 4) AS y FROM one")
def _(spark, sf):
    return ann.annotations_long(ann.annotations_nested(derived.annotations(spark, sf))).select("filename", "keypoint", "x", F.round("y", 4).alias("y"))


@query("n02_annotations_nested", f"WITH {ANN} SELECT keypoint, count(*) AS files, count(x) AS marked FROM one GROUP BY keypoint")
def _(spark, sf):
    nested = ann.annotations_nested(derived.annotations(spark, sf))
    marked = F.size(F.filter(F.map_values("files"), lambda v: v.isNotNull()))
    return nested.select("keypoint", F.size("files").cast("long").alias("files"), marked.cast("long").alias("marked"))


@query(
    "n03_complete",
    f"WITH {ANN}, g AS (SELECT DISTINCT filename, 'kp' || k AS keypoint FROM an, (SELECT unnest([1, 2, 3, 9]) AS k)) SELECT filename, keypoint, x, round(y, 4) AS y FROM g LEFT JOIN one USING (filename, keypoint)",
)
def _(spark, sf):
    keypoints = spark.createDataFrame([("kp1",), ("kp2",), ("kp3",), ("kp9",)], "keypoint string")
    return ann.complete_annotations(_points(spark, sf), keypoints).select("filename", "keypoint", "x", F.round("y", 4).alias("y"))


@query(
    "n04_conflicts",
    f"WITH {ANN}, a AS (SELECT DISTINCT keypoint FROM an), b AS (SELECT unnest(['kp1', 'kp2', 'kp99']) AS keypoint) SELECT keypoint, 'annotations' AS only_in FROM a WHERE keypoint NOT IN (SELECT keypoint FROM b) UNION ALL SELECT keypoint, 'configuration' FROM b WHERE keypoint NOT IN (SELECT keypoint FROM a)",
)
def _(spark, sf):
    keypoints = spark.createDataFrame([("kp1",), ("kp2",), ("kp99",)], "keypoint string")
    return ann.conflicts(derived.annotations(spark, sf), keypoints)


QUERIES["o04_symmetric_difference"], ORACLES["o04_symmetric_difference"] = QUERIES["n04_conflicts"], ORACLES["n04_conflicts"]


@query(
    "n05_pivot",
    f"WITH {ANN} SELECT filename, " + ", ".join(f"min(x) FILTER (WHERE keypoint = 'kp{k}') AS kp{k}_x, round(min(y) FILTER (WHERE keypoint = 'kp{k}'), 4) AS kp{k}_y" for k in (1, 2, 3)) + " FROM an GROUP BY filename",
)
def _(spark, sf):
    wide = ann.annotations_pivot(derived.annotations(spark, sf), ["kp1", "kp2", "kp3"])
    return wide.select("filename", *(F.round(c, 4).alias(c) for c in wide.columns[1:]))


@query(
    "n05_unpivot",
    f"WITH {ANN}, f AS (SELECT DISTINCT filename FROM an), g AS (SELECT filename, 'kp' || k AS keypoint FROM f, (SELECT unnest([1, 2]) AS k)), mn AS (SELECT filename, keypoint, min(x) AS x, min(y) AS y FROM an GROUP BY ALL) SELECT filename, keypoint, x, round(y, 4) AS y FROM g LEFT JOIN mn USING (filename, keypoint)",
)
def _(spark, sf):
    wide = ann.annotations_pivot(derived.annotations(spark, sf), ["kp1", "kp2"])
    return ann.annotations_unpivot(wide, ["kp1", "kp2"]).select("filename", "keypoint", "x", F.round("y", 4).alias("y"))


@query("n06_missing_images", "SELECT 'img' || o_orderkey || '.png' AS filename FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'N')")
def _(spark, sf):
    images = derived.table(spark, sf, "orders").select(F.concat(F.lit("img"), F.col("o_orderkey").cast("string"), F.lit(".png")).alias("filename"))
    marked = derived.table(spark, sf, "lineitem").filter("l_returnflag = 'N'").select(F.concat(F.lit("img"), F.col("l_orderkey").cast("string"), F.lit(".png")).alias("filename"))
    return ann.missing_images(images, marked)


@query("s04_pose2d_long", f"WITH {POSE} SELECT recording, frame, kp, v.view, round(x, 4) AS x, round(y, 4) AS y FROM pose JOIN (SELECT unnest(['left', 'right']) AS view) v ON (v.view = 'left' AND kp BETWEEN 11 AND 14) OR (v.view = 'right' AND kp BETWEEN 15 AND 18)")
def _(spark, sf):
    """Keypoints that a view can see; the list of visible pairs is configuration."""
    seen = [(v, m.KEYPOINTS[k]) for v, ks in (("left", range(11, 15)), ("right", range(15, 19))) for k in ks]
    visible = spark.createDataFrame(seen, "view string, keypoint string")
    found = readers.pose2d_long(derived.pose_long(spark, sf), visible)
    return found.select("recording", "frame", "kp", "view", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("s05_normalise_side", f"WITH {POSE} SELECT view, keypoint, count(*) AS n FROM (SELECT CASE WHEN kp % 2 = 0 THEN 'TL' ELSE 'R' END AS view, CASE WHEN kp BETWEEN 11 AND 18 THEN 'eye' || CASE WHEN kp % 2 = 0 THEN '(left)' ELSE '(right)' END ELSE 'other' END AS keypoint FROM pose) GROUP BY ALL")
def _(spark, sf):
    rows = derived.pose_long(spark, sf).select(
        F.when(F.col("kp") % 2 == 0, "TL").otherwise("R").alias("view"), F.when(F.col("kp").between(11, 18), "eye").otherwise("other").alias("keypoint")
    )
    return readers.normalise_side(rows).groupBy("view", "keypoint").agg(F.count("*").alias("n"))
