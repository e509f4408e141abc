"""The job over a series of acquisitions: dates, pairs, matches, refinement and stored results.

Tables in: images (image_id, sensor, scene, ts, col0, row0, width, height, alt), models (image_id and a
sensor model's columns), keypoints (image_id, kp_id, col, row, scale, desc) or stored matches. A run
takes all dates at once (`all`), all dates with pairs of the same or the next dates only (`windowed`), or
date after date (`by_date`), each against the nearest dates that are refined already and stay as
they are.

Results stand in a store below `out` (`sources.store`): a step writes its models, matrices, points, errors
and its report, and commits them together, so that a run that dies leaves no part of a step behind and a
date has one set of models, however often it was refined. `results` reads them. With `reset` off, dates with
results are not refined again: a step of method `all` or `windowed` then takes the others, with the
cameras of dates that are done held as they are. A step without matches has a report with no
tracks and no errors, and its models as they came in. Matches are kept by pair of images and used again by
later steps and runs with the same matching settings (`keep_matches`).
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import footprints, geometry, matching, pairs, regions, solve, summaries, tracks
from ..session import kept
from ..sources import files, store
from ..sources.store import Store
from . import refine

METHODS, MATCHERS = ("all", "windowed", "by_date"), ("ratio", "epipolar", "window", "stored")


@dataclass(frozen=True)
class Job:
    """Every setting of a job, with its default."""

    out: str
    method: str = "all"
    dates: tuple[int, ...] | None = None  # positions in the timeline, None: all
    label: str | None = None  # only images with this in their id
    n_dates: int = 1  # dates to look back to, or ahead
    group_minutes: float = 30
    kind: str = "rpc"
    correct: tuple[str, ...] = ("R",)
    fix_reference: bool = False
    reference_weight: float = 1.0
    clean_outliers: bool = True
    most_first_error: float | None = None
    reset: bool = True  # False: dates with stored results are not done again
    keep_matches: bool = True  # pairs that were matched with the same settings are not matched again
    rematch: bool = False  # forget what was kept
    matcher: str = "ratio"
    ratio: float = 0.6
    most_distance: float = 250.0
    window: float = 30.0
    line_distance: float = 10.0
    ransac: float | None = 0.3
    ransac_trials: int = 1000
    projective: bool | None = None  # fit whole fundamental matrices, not affine ones; None: for perspective cameras
    slack: float | None = 5.0  # metres over the elbow that matched keypoints may lie apart, None: any
    most_keypoints: int = 60_000
    area: tuple | None = None  # a ring of points in degrees, or several (holes, parts): only keypoints inside count
    select: int = 0
    priority: tuple[str, ...] = ("length", "scale", "cost")
    sensor_aware: bool = False
    filter_pairs: bool = True
    allowed_pairs: tuple[tuple[str, str], ...] = ()  # of image ids, none: all
    fit_grid: int = 10
    rounds: int = 30
    more: dict = field(default_factory=dict, compare=False)  # settings of other programs in the same file

    def __post_init__(self):
        if self.method not in METHODS or self.matcher not in MATCHERS:
            raise ValueError(f"method is one of {METHODS}, matcher one of {MATCHERS}")
        solve.Settings(kind=self.kind, correct=tuple(self.correct))
        if not self.priority or set(self.priority) - tracks.PRIORITY.keys():
            raise ValueError(f"priority is some of {tuple(tracks.PRIORITY)}")

    @property
    def match_folder(self) -> str:
        """Where matches of these settings are kept."""
        own = ("matcher", "ratio", "most_distance", "window", "line_distance", "ransac", "ransac_trials", "slack", "most_keypoints", "area", "projective", "kind")
        return f"{self.out}/matches/{hashlib.sha256(repr([getattr(self, k) for k in own]).encode()).hexdigest()[:16]}"

    @classmethod
    def read(cls, values: dict) -> Job:
        """From a file's values; what no setting is named like is kept in `more`."""
        known = {f.name for f in fields(cls)} - {"more"}
        tupled = lambda v: tuple(map(tupled, v)) if isinstance(v, list) else v
        return cls(**{k: tupled(v) for k, v in values.items() if k in known}, more={k: v for k, v in values.items() if k not in known})


def timeline(images: DataFrame, job: Job) -> tuple[DataFrame, DataFrame]:
    """(dates (date_idx, date_id, ts, n_images), images with their date_idx and date_id). A date is a group
    of acquisitions; its id is the time of its first."""
    own = images.where(F.col("image_id").contains(job.label)) if job.label else images
    g = pairs.timeline(own.select(F.lit(0).alias("scene"), "ts", F.col("image_id").alias("id")), job.group_minutes)
    i = kept(g.select(F.col("id").alias("image_id"), F.col("g").alias("date_idx"), F.date_format("anchor", "yyyyMMdd_HHmmss").alias("date_id"), F.col("anchor")))
    d = i.groupBy("date_idx", "date_id").agg(F.min("anchor").alias("ts"), F.count("*").alias("n_images"))
    if job.dates is not None:
        d = d.where(F.col("date_idx").isin(list(job.dates)))
    return d, own.join(i.drop("anchor"), "image_id").join(d.select("date_idx"), "date_idx", "left_semi")


def candidate_pairs(cams: DataFrame, models: DataFrame, job: Job) -> tuple[DataFrame, DataFrame]:
    """(centres, pairs (cam_i, cam_j, triangulate)) of cameras (cam_id, image_id, date_idx, and their crops)."""
    centres = kept(refine.camera_centres(models, min(job.fit_grid, 6)))
    rings = kept(footprints.footprints(cams.select("cam_id", "col0", "row0", "width", "height", "alt"), models))
    p = footprints.footprint_pairs(rings, centres)
    p = pairs.qualify_pairs(p) if job.filter_pairs else p.where("overlap > 0").withColumn("triangulate", F.lit(True))
    if job.method == "windowed":
        p = p.join(pairs.date_window_pairs(cams.select("cam_id", "date_idx"), job.n_dates).select(F.least("cam_i", "cam_j").alias("cam_i"), F.greatest("cam_i", "cam_j").alias("cam_j")).distinct(), ["cam_i", "cam_j"], "left_semi")
    if job.allowed_pairs:
        a = cams.sparkSession.createDataFrame([(x, y) for x, y in job.allowed_pairs], "image_i string, image_j string")
        n = lambda k: cams.select(F.col("image_id").alias(f"image_{k}"), F.col("cam_id").alias(f"c{k}"))
        a = a.join(n("i"), "image_i").join(n("j"), "image_j").select(F.least("ci", "cj").alias("cam_i"), F.greatest("ci", "cj").alias("cam_j"))
        p = p.join(a, ["cam_i", "cam_j"], "left_semi")
    return centres, kept(p.select("cam_i", "cam_j", "triangulate"))


def matched(keypoints: DataFrame, cams: DataFrame, models: DataFrame, p: DataFrame, job: Job) -> DataFrame:
    """(cam_i, cam_j, kp_i, kp_j): matches of the keypoints of the pairs `p` by the job's matcher, those that
    no epipolar geometry of their pair holds, or that lie too far apart on the ground, left out."""
    k = tracks.keypoint_top_k(keypoints, job.most_keypoints)
    utm = footprints.keypoints_to_utm(k, cams.select("cam_id", "col0", "row0", "alt"), models)
    k = kept(k.drop("place").join(utm, ["cam_id", "kp_id"]))
    if job.area is not None:
        several = isinstance(job.area[0][0], (tuple, list))
        points = [(r, i, *map(float, v)) for r, ring in enumerate(job.area if several else (job.area,)) for i, v in enumerate(ring)]
        area = cams.sparkSession.createDataFrame(points, "ring int, i int, x double, y double")
        k = kept(regions.inside_area(k, area, cams.select("cam_id", "col0", "row0", "height", "alt"), models))
    # only what stands in the ground that both images of a pair see
    boxes = k.groupBy("cam_id").agg(F.min("east").alias("x0"), F.max("east").alias("x1"), F.min("north").alias("y0"), F.max("north").alias("y1"))
    wide = boxes.select("cam_id", *[(F.col(c) - 1).alias(c) for c in ("x0", "y0")], *[(F.col(c) + 1).alias(c) for c in ("x1", "y1")])
    near = kept(matching.overlap_keypoints(k.select("cam_id", "kp_id", F.col("east").alias("x"), F.col("north").alias("y")), p, wide))
    use = k.join(near.select("cam_id", "kp_id").distinct(), ["cam_id", "kp_id"], "left_semi")
    if job.matcher == "ratio":
        m = matching.ratio_match(use.select("cam_id", "kp_id", "desc"), p, job.ratio)
    elif job.matcher == "epipolar":
        lines = geometry.epipolar_lines(p, models)
        own = use.join(cams.select("cam_id", "col0", "row0"), "cam_id").withColumns({"x": F.col("col") + F.col("col0"), "y": F.col("row") + F.col("row0")})
        m = matching.epipolar_match(own.select("cam_id", "kp_id", "x", "y", "desc"), lines, job.line_distance, job.ratio)
    else:
        side = lambda c: p.select("cam_i", "cam_j").join(use.select(F.col("cam_id").alias(c), "kp_id", F.col("east").alias("x"), F.col("north").alias("y"), "desc"), c)
        m = matching.window_match(side("cam_i"), side("cam_j"), job.window, job.most_distance, ("cam_i", "cam_j"))
    both = lambda s: near.select("cam_i", "cam_j", F.col("cam_id").alias(f"cam_{s}_"), F.col("kp_id").alias(f"kp_{s}")).where(F.col(f"cam_{s}_") == F.col(f"cam_{s}")).drop(f"cam_{s}_")
    m = m.select("cam_i", "cam_j", "kp_i", "kp_j").join(both("i"), ["cam_i", "cam_j", "kp_i"], "left_semi").join(both("j"), ["cam_i", "cam_j", "kp_j"], "left_semi")
    end = lambda s, n: k.select(F.col("cam_id").alias(f"cam_{s}"), F.col("kp_id").alias(f"kp_{s}"), F.col("col").alias(f"x{n}"), F.col("row").alias(f"y{n}"), F.col("east").alias(f"x{s}"), F.col("north").alias(f"y{s}"))
    m = kept(m.join(end("i", 1), ["cam_i", "kp_i"]).join(end("j", 2), ["cam_j", "kp_j"]))
    if job.ransac is not None:
        whole = job.kind == "perspective" if job.projective is None else job.projective
        good = (matching.ransac_projective if whole else matching.ransac)(m, job.ransac, job.ransac_trials).select("cam_i", "cam_j", "kp_i", "kp_j")
        m = kept(m.join(good, ["cam_i", "cam_j", "kp_i", "kp_j"], "left_semi"))
    if job.slack is not None:
        m = matching.consistent(m, job.slack)
    return m.select("cam_i", "cam_j", "kp_i", "kp_j")


def batch(spark: SparkSession, job: Job, cams: DataFrame, models: DataFrame, keypoints: DataFrame, stored: DataFrame | None) -> dict:
    """One refinement of cameras (cam_id, image_id, adjusted, ...): those that are adjusted stay."""
    m = kept(models.join(cams.select("cam_id", "image_id"), "image_id").drop("image_id"))
    k = kept(keypoints.join(cams.select("cam_id", "image_id"), "image_id").drop("image_id"))
    centres, p = candidate_pairs(cams, m, job)
    if stored is None and job.keep_matches:
        n = lambda s: cams.select(F.col("image_id").alias(f"image_{s}"), F.col("cam_id").alias(f"cam_{s}"))
        named = kept(p.join(n("i"), "cam_i").join(n("j"), "cam_j"))

        def match(new: DataFrame) -> DataFrame:
            new = new.select(F.struct("image_i", "image_j").alias("x")).unionByName(new.select(F.struct(F.col("image_j").alias("image_i"), F.col("image_i").alias("image_j")).alias("x"))).select("x.*")
            some = matched(k, cams, m, kept(named.join(new, ["image_i", "image_j"], "left_semi").select("cam_i", "cam_j", "triangulate")), job)
            return some.join(n("i"), "cam_i").join(n("j"), "cam_j").select("image_i", "image_j", "kp_i", "kp_j")

        found, fresh = store.kept_matches(Store(spark, job.match_folder), named.select("image_i", "image_j"), match)
        found = found.join(named.select("image_i", "image_j", "cam_i", "cam_j"), ["image_i", "image_j"]).select("cam_i", "cam_j", "kp_i", "kp_j")
    elif stored is None:
        found, fresh = matched(k, cams, m, p, job), None
    else:
        fresh = 0
        n = lambda s: cams.select(F.col("image_id").alias(f"image_{s}"), F.col("cam_id").alias(f"c{s}"))
        s = stored.join(n("i"), "image_i").join(n("j"), "image_j")
        turn = F.col("ci") > F.col("cj")
        found = s.select(F.least("ci", "cj").alias("cam_i"), F.greatest("ci", "cj").alias("cam_j"), F.when(turn, F.col("kp_j")).otherwise(F.col("kp_i")).alias("kp_i"), F.when(turn, F.col("kp_i")).otherwise(F.col("kp_j")).alias("kp_j")).join(p, ["cam_i", "cam_j"], "left_semi")
    full = k.join(cams.select("cam_id", "col0", "row0"), "cam_id").select("cam_id", "kp_id", (F.col("col") + F.col("col0")).alias("col"), (F.col("row") + F.col("row0")).alias("row"), "scale")
    old = frozenset(int(r.cam_id) for r in cams.where("adjusted").select("cam_id").collect())  # cameras of n_dates dates
    config = refine.Config(
        select=job.select, priority=tuple(job.priority), clean_outliers=job.clean_outliers, fixed=old, fix_reference=job.fix_reference and not old, reference_weight=job.reference_weight, most_first_error=job.most_first_error, fit_grid=job.fit_grid,
        solver=solve.Settings(kind=job.kind, correct=tuple(job.correct), rounds=job.rounds),
    )
    sensors = cams.select("cam_id", "sensor") if job.sensor_aware else None
    out = refine.refine(spark, kept(found), kept(full), p.where("triangulate").select("cam_i", "cam_j"), m, centres, config, cams.where("not adjusted").select("cam_id"), sensors)
    named = out["models"].join(cams.where("not adjusted").select("cam_id", "image_id", "date_id"), "cam_id").drop("cam_id")
    parts = {"models": named, "points": out["points"].select("track_id", "x", "y", "z"), "errors": out["errors"]}
    if job.kind != "rpc":
        p0, p1 = (refine.matrices(spark, cams.where("not adjusted"), x, job.kind) for x in (out["first"], out["angles"]))
        named_p = p1.join(p0.select("image_id", F.col("p").alias("p_first")), "image_id")
        parts["matrices"] = named_p.join(cams.select("image_id", "date_id"), "image_id")
    return out | {"tables": parts, "fresh": fresh}


REPORT = "date_id string, n_images long, n_tracks long, mean_before double, mean_after double"


def run(spark: SparkSession, job: Job, images: DataFrame, models: DataFrame, keypoints: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Refines all chosen dates; (date_id, n_images, n_tracks, mean_before, mean_after) of each step, whose
    name is its first date's."""
    if job.matcher == "stored" and stored is None:
        raise ValueError("no stored matches were given")
    stored = stored if job.matcher == "stored" else None
    dates, own = timeline(images, job)
    dates, own = kept(dates), kept(own)
    names = {r.date_idx: r.date_id for r in dates.collect()}  # one row a date
    kept_here, reset = Store(spark, job.out), job.reset
    if job.rematch:
        Store(spark, job.match_folder).put({}, [], reset=True)
    todo = sorted(k for k, v in names.items() if reset or v not in kept_here.owners())
    rows = []
    for step in [[k] for k in todo] if job.method == "by_date" else [todo] if todo else []:
        before = set() if reset else set(kept_here.owners())
        done = sorted(k for k, v in names.items() if v in before and k not in step)
        if job.method == "by_date":
            near = [k for k in done if k < step[0]][-job.n_dates :] if job.n_dates > 0 else []
        elif job.method == "windowed":
            near = [k for k in done if any(abs(k - i) <= job.n_dates for i in step)]
        else:
            near = done
        t = dates.withColumn("adjusted", F.col("date_idx").isin(near))
        chosen = spark.createDataFrame([(k,) for k in step + near], "date_idx long")
        cams = kept(summaries.images_of_dates(own.drop("date_idx"), t.select("date_idx", "date_id", "adjusted"), chosen))
        use = models.select("image_id", *geometry.FIELDS)
        if near:
            better = kept_here.read("models", "date_id").select("image_id", *geometry.FIELDS).join(cams.where("adjusted").select("image_id"), "image_id", "left_semi")
            use = use.join(better, "image_id", "left_anti").unionByName(better)
        out = batch(spark, job, cams, kept(use), keypoints, stored)
        name = names[step[0]]
        total = out["errors"].where("cam_id IS NULL").first()
        mean = (total.mean_before, total.mean_after) if total else (None, None)
        row = (name, cams.where("not adjusted").count(), out["obs"].select("track_id").distinct().count(), *mean)
        d = out["drift"] or (0.0, 0.0, 0.0)
        tables = out["tables"] | {"points": out["tables"]["points"].select("track_id", *[(F.col(c) - F.lit(float(v))).alias(c) for c, v in zip("xyz", d, strict=True)])}
        tables = {k: v if k in ("models", "matrices") else v.withColumn("step", F.lit(name)) for k, v in tables.items()}
        kept_here.put(tables | {"report": spark.createDataFrame([row], REPORT)}, [names[k] for k in step], reset)
        reset = False  # the first step's commit takes the place of all that was there
        rows.append(row)
    return spark.createDataFrame(rows, REPORT)


def results(spark: SparkSession, out: str, table: str) -> DataFrame | None:
    """What runs have left in `out`: models (image_id, date_id, ...), matrices (image_id, date_id, p, p_first and the
    crop), points (track_id, x, y, z, step), errors (cam_id or null for all, ..., step), report. Of a date
    that was refined twice the last models count; of steps, all that hold such a date."""
    return Store(spark, out).read(table, "date_id" if table in ("models", "matrices") else None)


def write_files(spark: SparkSession, out: str, folder: str) -> None:
    """The corrected models as text files and, of matrix cameras, the first and corrected matrices as JSON."""
    models = results(spark, out, "models")
    if models is not None:
        files.write_lines(files.rpc_lines(models), f"{folder}/models")
    m = results(spark, out, "matrices")
    if m is not None:
        files.write_lines(files.matrix_json(m), f"{folder}/matrices")
        files.write_lines(files.matrix_json(m.withColumn("p", F.col("p_first"))), f"{folder}/matrices_first")
