"""Picking package releases and resolving what they require."""

from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import versions as V

#: Steps of a resolution, and releases of a project that are looked at.
MOST_STEPS, DEPTH = 2048, 12


def candidates(releases: DataFrame, clauses: Column, python: str, depth: int = DEPTH) -> DataFrame:
    """The best release per project: ``(project, version)``.

    Releases that this Python may use and that meet the clauses, newest first;
    pre-releases only if a clause names one or nothing else fits; the first pure
    one of the first ``depth`` wins. Projects without one are not in the result.
    """
    usable = F.coalesce(V.satisfies_all(F.lit(python), F.filter(F.split(F.coalesce("requires_python", F.lit("")), r"\s*,\s*"), lambda c: c != "")), F.lit(True))
    fits = releases.withColumn("clauses__", clauses).where(usable & V.is_version(F.col("version")) & V.satisfies_all(F.col("version"), F.col("clauses__")))
    asked = F.exists("clauses__", lambda c: V.is_prerelease(F.regexp_replace(c, r"^\s*(===|~=|==|!=|<=|>=|<|>)\s*", "")))
    w = Window.partitionBy("project")
    pre = V.is_prerelease(F.col("version"))
    allowed = fits.withColumn("final__", F.bool_or(~pre).over(w)).where(asked | ~pre | ~F.col("final__"))
    ranked = allowed.withColumn("n__", F.row_number().over(w.orderBy(V.sort_key(F.col("version")).desc(), F.col("version")))).where(F.col("n__") <= depth)
    return ranked.where("is_pure").groupBy("project").agg(F.min_by("version", "n__").alias("version"))


def best_wheel(files: DataFrame) -> DataFrame:
    """The wheel of each release: pure, not yanked, py3-only before others, then by name."""
    from ..functions.text import wheel_parts

    parts = wheel_parts(F.col("filename"))
    pure = F.coalesce((parts["abi"] == "none") & (parts["platform"] == "any") & parts["python"].contains("py3"), F.lit(False))
    w = Window.partitionBy("project", "version").orderBy((parts["python"] != "py3").cast("int"), "filename")
    return files.where(pure & ~F.coalesce("yanked", F.lit(False))).withColumn("n__", F.row_number().over(w)).where("n__ = 1").drop("n__")


#: What is read of a package index's JSON about a project.
INDEX = "info struct<name:string>, releases map<string, array<struct<filename:string, packagetype:string, url:string, size:bigint, yanked:boolean, requires_python:string, digests:map<string,string>>>>"


def releases_of(texts: DataFrame, key: str, json_col: str = "json") -> DataFrame:
    """A package index's JSON as releases: ``(key, project, version, requires_python, files, wheel, url, sha256, is_pure)``.

    Versions that are none, and releases whose files are all withdrawn, give no
    row. The wheel is the first pure one with a digest, those for Python 3 alone
    first. Text that is not such JSON gives no row. The map of releases ends where
    it is made into rows: no row carries its project's whole index along.
    """
    from ..functions.text import wheel_parts

    parsed = texts.select(key, F.from_json(json_col, INDEX).alias("j")).select(key, F.col("j.info.name").alias("project"), F.col("j.releases").alias("releases"))
    each = parsed.select(key, "project", F.explode("releases").alias("version", "all")).where(V.is_version(F.col("version")))
    used = each.withColumn("usable", F.filter("all", lambda f: ~F.coalesce(f["yanked"], F.lit(False)))).where("size(usable) > 0")

    def pure(f: Column) -> Column:
        parts = wheel_parts(f["filename"])
        return F.coalesce((f["packagetype"] == "bdist_wheel") & (parts["abi"] == "none") & (parts["platform"] == "any") & parts["python"].contains("py3") & (F.coalesce(f["digests"]["sha256"], F.lit("")) != ""), F.lit(False))

    ranked = F.array_sort(F.transform(F.filter("usable", pure), lambda f: F.struct((wheel_parts(f["filename"])["python"] != "py3").alias("later"), f["filename"].alias("filename"), f["url"].alias("url"), F.lower(f["digests"]["sha256"]).alias("sha256"))))
    best = F.try_element_at(ranked, F.lit(1))
    needs = F.try_element_at(F.filter(F.transform("usable", lambda f: f["requires_python"]), lambda r: r.isNotNull()), F.lit(1))
    return used.select(key, "project", "version", needs.alias("requires_python"), F.size("usable").alias("files"), best["filename"].alias("wheel"), best["url"].alias("url"), best["sha256"].alias("sha256"), best.isNotNull().alias("is_pure"))


@dataclass
class Plan:
    """What to install in order, what is there already, and what was left out and why."""

    steps: list[tuple[str, str]] = field(default_factory=list)
    satisfied: list[tuple[str, str]] = field(default_factory=list)
    excluded: list[tuple[str, str, str]] = field(default_factory=list)


#: Rows of releases and of requirements that one resolution may gather.
MOST_ROWS = 500_000


def _reached(spark: SparkSession, releases: DataFrame, requirements: DataFrame, roots: list[str]) -> tuple[dict[str, list], dict[tuple[str, str], list[str]]]:
    """Releases and requirement lines of every project that the roots can reach, whatever is picked.

    Each round joins the projects found last with their requirement lines, so the
    jobs are as many as the chain of requirements is long, not one per step.
    """
    held: dict[str, list] = {}
    lines: dict[tuple[str, str], list[str]] = {}
    frontier, seen, rows = {need[0] for text in roots if (need := V.read_requirement(text))}, set(), 0
    while frontier:
        wave = F.broadcast(spark.createDataFrame([(n,) for n in sorted(frontier)], "project string"))
        for part, into in ((releases.select("project", "version", "requires_python", "is_pure").distinct(), "releases"), (requirements.select("project", "version", "pos", "text"), "lines")):
            found = part.join(wave, "project", "left_semi").limit(MOST_ROWS + 1).collect()
            rows += len(found)
            if rows > MOST_ROWS:
                raise ValueError("the roots reach more releases than a resolution may gather")
            for r in sorted(found, key=lambda r: (r["project"], r["version"], r["pos"] if into == "lines" else 0)):
                if into == "releases":
                    held.setdefault(r["project"], []).append(r)
                else:
                    lines.setdefault((r["project"], r["version"]), []).append(r["text"])
        seen |= frontier
        frontier = {need[0] for (project, _), texts in lines.items() if project in frontier for t in texts if (need := V.read_requirement(t))} - seen
    return held, lines


def _pick(rows: list, clauses: list[str], python: V.Version, depth: int = DEPTH) -> str | None:
    """``candidates`` for one project whose releases are at hand."""
    fits = []
    for r in rows:
        version = V.Version.read(r["version"])
        usable = all(V.meets(python, c) for c in (r["requires_python"] or "").split(",") if c.strip())
        if version is not None and usable and all(V.meets(version, c) for c in clauses):
            fits.append((version, r))
    targets = [V.Version.read(re.sub(r"^\s*(===|~=|==|!=|<=|>=|<|>)\s*", "", c)) for c in clauses]
    asked = any(t is not None and t.prerelease for t in targets)
    if not asked and any(not v.prerelease for v, _ in fits):
        fits = [(v, r) for v, r in fits if not v.prerelease]
    fits.sort(key=lambda f: f[1]["version"])
    fits.sort(key=lambda f: f[0].key, reverse=True)
    return next((r["version"] for _, r in fits[:depth] if r["is_pure"]), None)


def resolve(spark: SparkSession, releases: DataFrame, requirements: DataFrame, roots: list[str], python: str, installed: dict[str, str] | None = None, environment: dict[str, str] | None = None) -> Plan:
    """Resolves roots first in, first out, without going back.

    ``releases(project, version, requires_python, is_pure)``,
    ``requirements(project, version, pos, text)``. Each requirement adds its
    clauses to the project's; if the pick no longer meets them it is picked anew,
    and what the old pick required stays required. Spark gathers the rows of the
    projects that can be reached, at most ``MOST_ROWS``, a job for each length of
    chain; the steps, at most ``MOST_STEPS``, are taken on those. Raises
    ``ValueError`` where nothing fits or a bound is passed.
    """
    environment = {"python_version": ".".join(python.split(".")[:2]), "python_full_version": python, **(environment or {})}
    installed = {_canonical(k): v for k, v in (installed or {}).items()}
    plan, picks, clauses, edges = Plan(), {}, {}, {}
    held, lines = _reached(spark, releases, requirements, roots)
    own_python = V.Version.read(python)
    queue = deque((text, None, frozenset()) for text in roots)
    steps, asked = 0, set()
    while queue:
        steps += 1
        if steps > MOST_STEPS:
            raise ValueError("the resolution does not end")
        text, parent, extras = queue.popleft()
        need = V.read_requirement(text)
        if need is None:
            raise ValueError(f"cannot read requirement {text!r}")
        name, wanted, own_clauses, marker = need
        # An extra of the parent that asks for this is any of its chosen ones.
        options = [{**environment, "extra": e} for e in sorted(extras)] or [{**environment, "extra": ""}]
        if not any(V.marker_holds(marker, o) for o in options):
            reason = "extra not requested" if "extra" in (marker or "") and not extras else "other extra" if "extra" in (marker or "") else "marker is false"
            plan.excluded.append((parent or "", text, reason))
            continue
        own = clauses.setdefault(name, [])
        own += [c for c in own_clauses if c not in own]
        if parent:
            edges.setdefault(parent, []).append(name)
        fits = lambda v: (known := V.Version.read(v)) is not None and all(V.meets(known, c) for c in own)  # noqa: B023, E731
        have = installed.get(name)
        if name not in picks and have is not None and fits(have):
            picks[name] = have
        elif name not in picks or not fits(picks[name]):
            found = _pick(held.get(name, []), own, own_python)
            if found is None:
                raise ValueError(f"no release of {name} meets {', '.join(own) or 'this Python'}")
            picks[name] = found
        key = (name, picks[name], tuple(sorted(wanted)))
        if key not in asked:
            asked.add(key)
            queue.extend((line, name, frozenset(wanted)) for line in lines.get((name, picks[name]), []))
    done: set[str] = set()

    def emit(name: str, path: frozenset) -> None:
        if name in done or name in path:
            return
        for child in edges.get(name, []):
            emit(child, path | {name})
        done.add(name)
        (plan.satisfied if installed.get(name) == picks[name] else plan.steps).append((name, picks[name]))

    for name in picks:
        emit(name, frozenset())
    return plan


def _canonical(name: str) -> str:
    return re.sub("[-_.]+", "-", name.lower())
