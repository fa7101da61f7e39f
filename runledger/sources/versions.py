"""Sources as series of immutable, content-addressed versions."""

from __future__ import annotations

import re
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from ..functions.hashing import fingerprint
from ..operators.contracts import COLUMN_PATTERN
from ..operators.profile import PROFILE_FIELDS, SAMPLE_ROWS, kept_rows, profile
from ..operators.sketches import SKETCH_FIELDS, column_sketches
from ..session import small_frame
from .readers import read_source, suffix_of
from .tables import append_rows, discard, materialize, read_rows

NAME_PATTERN = "[a-z][a-z0-9_]{0,62}"

PROFILE_TYPE = f"array<struct<{PROFILE_FIELDS}>>"
VERSION_FACTS = (
    "digest string, origin string, path string, rows bigint, "
    f"schema_json string, profile {PROFILE_TYPE}, sample array<string>, created_at timestamp, seq bigint"
)
VERSION_SCHEMA = f"{VERSION_FACTS}, workspace_id string, source string, version_id string"


@dataclass(frozen=True)
class Workspace:
    """Where all tables of one namespace live; lookups never leave it."""

    spark: SparkSession
    root: str
    workspace_id: str

    def table(self, name: str) -> str:
        return f"{self.root}/tables/{name}"

    def data(self, *parts: str) -> str:
        return "/".join((self.root, "data", f"workspace={self.workspace_id}", *parts))


def check_name(name: str) -> str:
    if not re.fullmatch(NAME_PATTERN, name):
        raise ValueError(f"Not a lowercase name of letters, numbers and underscores: {name!r}")
    return name


def append_version(ws: Workspace, source: str, path: str, **csv_options) -> Row:
    """Register the file or folder at ``path``; known rows give back the version they had."""
    check_name(source)
    return _register(ws, source, read_source(ws.spark, path, **csv_options), path)


def append_frame(ws: Workspace, source: str, df: DataFrame) -> Row:
    """Register the rows of a DataFrame; known rows give back the version they had."""
    check_name(source)
    return _register(ws, source, df, "")


def append_frames(ws: Workspace, frames: dict[str, DataFrame]) -> dict[str, Row]:
    """Register several sources at once, so that small ones do not wait for large ones."""
    with ThreadPoolExecutor(max_workers=8) as pool:
        rows = pool.map(lambda item: append_frame(ws, *item), frames.items())
        return dict(zip(frames, rows))


def require_columns(df: DataFrame) -> None:
    """At least one column, all of them identifiers and unique ignoring case."""
    names = df.columns
    if not names or len({n.lower() for n in names}) < len(names):
        raise ValueError("A source needs columns, no two of which differ by case alone")
    bad = [n for n in names if not re.fullmatch(COLUMN_PATTERN, n)]
    if bad:
        raise ValueError(f"These columns cannot be named in SQL without quotes: {bad}")


def known_version(ws: Workspace, source: str, digest: str) -> tuple[Row | None, int]:
    """The earliest version with this content, if any, and the last sequence number."""
    rows = versions(ws, source)
    same = F.when(F.col("digest") == digest, F.struct("seq", "version_id"))
    found = rows.agg(
        F.min_by(F.struct(*rows.columns), same).alias("known"), F.coalesce(F.max("seq"), F.lit(0)).alias("seq")
    ).first()
    return found["known"], found["seq"]


def _register(ws: Workspace, source: str, df: DataFrame, origin: str) -> Row:
    """Write the rows once and take their identity from what was written.

    Schema and rows in any order are the identity at every size. So read options and the values in
    folder names take part, and reordered rows are the same version.
    """
    require_columns(df)
    attempt = uuid.uuid4().hex[:12]
    path = ws.data(f"source={source}", f"version={attempt}")
    table = materialize(df, path)
    digest = fingerprint(table).first()["fingerprint"]
    known, seq = known_version(ws, source, digest)
    if known:
        discard(ws.spark, path)
        return known
    with ThreadPoolExecutor(max_workers=3) as pool:
        sketched = pool.submit(lambda: column_sketches(table).collect())  # one row a column
        profiled, sample = pool.submit(profile_rows, table), pool.submit(kept_rows, table)
        facts = (origin.rstrip("/").rsplit("/", 1)[-1], path, table.schema.json(), profiled.result(), sample.result())
    sketches = small_frame(ws.spark, [tuple(r) for r in sketched.result()], SKETCH_FIELDS)
    return add_version(ws, source, digest, seq, *facts, sketches)


def add_version(
    ws: Workspace, source: str, digest: str, seq: int, origin: str, path: str, schema_json: str, columns: list[dict], sample: list[str], sketches: DataFrame
) -> Row:
    """Record what has been written at ``path`` as a version after number ``seq``; its sketches come first."""
    version_id = f"{digest[:16]}-{uuid.uuid4().hex[:12]}"
    part = f"{_part(ws, source)}/version_id={version_id}"
    append_rows(ws.spark, sketches, SKETCH_FIELDS, f"{ws.table('sketches')}/{part}")
    row = (digest, origin, path, columns[0]["rows"], schema_json, columns, sample, datetime.now(timezone.utc), seq + 1)
    append_rows(ws.spark, [row], VERSION_FACTS, f"{ws.table('versions')}/{part}")
    # Another writer may have been first with the same content: the earliest row counts.
    return known_version(ws, source, digest)[0]


def version_sketches(ws: Workspace, source: str | None = None) -> DataFrame:
    """The stored sketches of all versions, or of those of one source: one row a version and column."""
    schema = f"{SKETCH_FIELDS}, workspace_id string, source string, version_id string"
    return read_rows(ws.spark, schema, ws.table("sketches"), _part(ws, source))


def profile_rows(df: DataFrame) -> list[dict]:
    """The profile as a few values to store with a version or an artifact: one per column."""
    rows = [r.asDict() for r in profile(df).collect()]
    return sorted(rows, key=lambda r: r["position"])


def _part(ws: Workspace, source: str | None = None) -> str:
    return f"workspace_id={ws.workspace_id}" + (f"/source={source}" if source else "")


def versions(ws: Workspace, source: str | None = None) -> DataFrame:
    """Every version row of this workspace, or of one of its sources."""
    return read_rows(ws.spark, VERSION_SCHEMA, ws.table("versions"), _part(ws, source))


def _first_versions(rows: DataFrame) -> DataFrame:
    """Of versions that two writers appended with the same content, only the earliest."""
    first = rows.groupBy("source", "digest").agg(F.min(F.struct("seq", "version_id")).alias("_f"))
    first = first.select("source", F.col("_f.version_id").alias("version_id"))
    return rows.join(first, ["source", "version_id"], "left_semi")


def list_versions(ws: Workspace) -> DataFrame:
    """Every version with its column profiles, by source, newest first; equal content once."""
    return _first_versions(versions(ws)).orderBy("source", F.desc("created_at"), F.desc("seq"))


def latest_rows(df: DataFrame, by: list[str], newest: list[str]) -> DataFrame:
    """The newest row of each group, as one aggregate: a hot group is combined where it lies.

    Columns of any type may follow; only those in ``newest`` are compared. Of rows that tie in all
    of them one is kept.
    """
    rest = [c for c in df.columns if c not in by]
    top = F.max_by(F.struct(*rest), F.struct(*newest)).alias("_top")
    return df.groupBy(*by).agg(top).select(*by, "_top.*").select(df.columns)


def latest_versions(ws: Workspace) -> DataFrame:
    """The newest listed version of every source. Re-appending old content does not make it newest."""
    return latest_rows(_first_versions(versions(ws)), ["source"], ["created_at", "seq"])


def chosen_version(ws: Workspace, source: str, version_id: str | None = None) -> DataFrame:
    """One version row of a source: the one asked for if there is one, else the newest."""
    asked = F.col("version_id").eqNullSafe(F.lit(version_id).cast("string"))
    rows = _first_versions(versions(ws, source))
    return rows.orderBy(asked.desc(), F.desc("created_at"), F.desc("seq")).limit(1)


def version_profile(ws: Workspace, source: str, version_id: str | None = None) -> DataFrame:
    """The stored profile of a version, one row per column."""
    return chosen_version(ws, source, version_id).select(F.inline("profile")).orderBy("position")


def version_sample(ws: Workspace, source: str, n: int = 10, version_id: str | None = None) -> DataFrame:
    """The first 1 to 20 rows kept with a version, as JSON texts."""
    rows = F.slice("sample", 1, min(SAMPLE_ROWS, max(1, n)))
    return chosen_version(ws, source, version_id).select(F.explode(rows).alias("row"))


def bind_versions(declared: DataFrame, mapping: DataFrame, known: DataFrame) -> DataFrame:
    """Match declared inputs ``(input)`` with a mapping ``(input, version_id)``.

    ``known`` holds the versions of this workspace. Every name of either side gives one row
    with ``problem`` = ``missing``, ``extra``, ``foreign`` or null.
    """
    wanted = declared.select(F.col("input").alias("d"))
    given = mapping.select(F.col("input").alias("m"), F.col("version_id").alias("v"))
    pairs = wanted.join(given, F.col("d") == F.col("m"), "full")
    found = known.withColumnsRenamed({"version_id": "_known"})
    problem = (
        F.when(F.col("d").isNull(), "extra")
        .when(F.col("m").isNull(), "missing")
        .when(F.col("_known").isNull(), "foreign")
    )
    return (
        pairs.join(found, F.col("v") == F.col("_known"), "left")
        .select(
            F.coalesce("d", "m").alias("input"),
            F.col("v").alias("version_id"),
            problem.alias("problem"),
            *[c for c in found.columns if c != "_known"],
        )
    )


def resolve_inputs(ws: Workspace, declared: list[str], mapping: dict[str, str]) -> dict[str, Row]:
    """The version of every declared input, or an error naming all that do not fit."""
    names = small_frame(ws.spark, [(n,) for n in declared], "input string")
    given = small_frame(ws.spark, list(mapping.items()), "input string, version_id string")
    bound = bind_versions(names, given, versions(ws)).collect()
    bad = [f"{r['input']}: {r['problem']}" for r in bound if r["problem"]]
    if bad:
        raise ValueError(f"Inputs without a version here, or that no step reads: {bad}")
    return {r["input"]: r for r in bound}
