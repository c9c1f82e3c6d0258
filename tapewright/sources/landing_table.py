"""The table of raw rows: source files land in it once, however often a run is killed or repeated.

A batch of files is written to a staging folder, moved into place by a rename, and becomes
part of the table when its manifest is renamed into the list of manifests.  Rows of a batch
without a manifest don't count, and the next run over the same files replaces them.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import contracts
from . import tapes
from .shared import file_system

MANIFEST = "batch string, batch_no long, file_no int, raw_file_id string, sha256 string, file_name string, kind string, source_system string, headers array<string>, row_count long, parsed_count long, failed_count long, status string"

#: The order of rows, which later files never change.
ORDER = ("batch_no", "file_no", "row_number")


@dataclass(frozen=True)
class Upload:
    """A source file and what it is; the id follows from its content unless one is given."""

    path: str
    kind: str
    raw_file_id: str | None = None


def renamed(spark: SparkSession, source: str, target: str) -> None:
    """Move a file or folder in one step; what lies at ``target`` already ends the job."""
    fs, a = file_system(spark, source)
    _, b = file_system(spark, target)
    fs.mkdirs(b.getParent())
    if fs.exists(b) or not fs.rename(a, b):
        raise FileExistsError(target)


def put_text(spark: SparkSession, text: str, target: str) -> None:
    """A small file that is there as a whole or not at all."""
    fs, part = file_system(spark, f"{target}.part")
    stream = fs.create(part, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    renamed(spark, f"{target}.part", target)


def names_in(spark: SparkSession, folder: str, suffix: str) -> list[str]:
    """Names of the files of a folder that end so, without the ending; none if there is no folder."""
    fs, where = file_system(spark, folder)
    if not fs.exists(where):
        return []
    found = (s.getPath().getName() for s in fs.listStatus(where))
    return sorted(n.removesuffix(suffix) for n in found if n.endswith(suffix))


class LandingTable:
    """Raw rows under ``path``: ``rows`` and ``manifest`` show what has landed, ``land`` adds files."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def batches(self) -> list[tuple[int, str]]:
        """(running number, name) of what has landed, in order."""
        found = (n.split("-", 1) for n in names_in(self.spark, f"{self.path}/manifests", ".json"))
        return sorted((int(n), b) for n, b in found)

    def manifest(self) -> DataFrame:
        """A row a file: ids, content digest, header and counters."""
        files = [f"{self.path}/manifests/{n:08d}-{b}.json" for n, b in self.batches()]
        return self.spark.read.schema(MANIFEST).json(files) if files else self.spark.createDataFrame([], MANIFEST)

    def rows(self) -> DataFrame:
        """Raw rows of all files that have landed, with their place: number of the batch and of the file in it."""
        folders = [f"{self.path}/data/{n:08d}-{b}" for n, b in self.batches()]
        if not folders:
            return self.spark.createDataFrame([], self._schema())
        return self.spark.read.schema(self._schema()).parquet(*folders)

    def stream(self, batches_at_once: int = 1) -> DataFrame:
        """Raw rows as they land, as a stream."""
        return self.spark.readStream.schema(self._schema()).option("maxFilesPerTrigger", 1000 * batches_at_once).parquet(f"{self.path}/data/*")

    def digest(self) -> str:
        """Changes with what has landed and with nothing else; no job over the rows."""
        return hashlib.sha256("\n".join(b for _, b in self.batches()).encode()).hexdigest()

    @staticmethod
    def _schema() -> str:
        return "raw_file_id string, row_number int, raw_record_id string, source_system string, payload map<string,string>, parse_error string, batch_no long, file_no int"

    def land(self, uploads: list[Upload], force: bool = False) -> list[dict]:
        """Land those files whose content hasn't landed yet (all of them with ``force``); their manifest rows.

        Of files with equal content in one batch the first lands.  All files of one layout are read in one job.
        """
        fresh = self._fresh(uploads, force)
        if not fresh:
            return []
        batch = hashlib.sha256("\n".join(sorted(f["raw_file_id"] for f in fresh)).encode()).hexdigest()[:32]
        number = 1 + max((n for n, _ in self.batches()), default=0)
        staged, placed = f"{self.path}/staging/{batch}", f"{self.path}/data/{number:08d}-{batch}"
        self._rows_of(fresh).withColumn("batch_no", F.lit(number).cast("long")).write.mode("overwrite").parquet(staged)
        counted = {r["raw_file_id"]: r for r in tapes.counters(self.spark.read.schema(self._schema()).parquet(staged)).collect()}
        fs, where = file_system(self.spark, placed)
        fs.delete(where, True)  # of a run that was killed before its manifest
        renamed(self.spark, staged, placed)
        none = {"row_count": 0, "parsed_count": 0, "failed_count": 0}
        lines = []
        for i, f in enumerate(fresh):
            n = counted[f["raw_file_id"]].asDict() if f["raw_file_id"] in counted else none
            lines.append({"batch": batch, "batch_no": number, "file_no": i, **{k: f[k] for k in ("raw_file_id", "sha256", "file_name", "kind", "source_system", "headers")}, **{k: n[k] for k in none}, "status": "completed"})
        put_text(self.spark, "".join(json.dumps(x) + "\n" for x in lines), f"{self.path}/manifests/{number:08d}-{batch}.json")
        return lines

    def _fresh(self, uploads: list[Upload], force: bool) -> list[dict]:
        if not uploads:
            return []
        for u in uploads:
            if u.kind not in contracts.FILE_SOURCES:
                raise ValueError(f"unknown file kind: {u.kind!r}")
        whole = lambda p: (lambda fs, at: fs.makeQualified(at).toString())(*file_system(self.spark, p))
        manifest = self.manifest()
        fresh = tapes.not_seen(tapes.file_hashes(self.spark, [u.path for u in uploads]), manifest, force)
        hashed = {r["path"]: r for r in fresh.collect()}
        again = {}
        if force:
            mine = F.col("sha256").isin(list({r["sha256"] for r in hashed.values()}))
            again = {r["sha256"]: r["count"] for r in manifest.filter("status <> 'failed'").filter(mine).groupBy("sha256").count().collect()}
        known = {r["raw_file_id"] for r in manifest.select("raw_file_id").filter(F.col("raw_file_id").isin([u.raw_file_id for u in uploads if u.raw_file_id])).collect()} if any(u.raw_file_id for u in uploads) else set()
        out: dict[str, dict] = {}
        for u in uploads:
            h = hashed.get(whole(u.path))
            if h is None or h["sha256"] in out:
                continue
            named = u.raw_file_id or h["sha256"][:32] + (f"-{again[h['sha256']]}" if h["sha256"] in again else "")
            if named in known:
                raise ValueError(f"a file has landed under this id already: {named}")
            out[h["sha256"]] = {
                "path": u.path, "file": h["file"], "sha256": h["sha256"], "raw_file_id": named, "kind": u.kind, "source_system": contracts.FILE_SOURCES[u.kind],
                "file_name": u.path.rsplit("/", 1)[-1], "headers": tapes.headers_of(self.spark, u.path),
            }
        return list(out.values())

    def _rows_of(self, files: list[dict]) -> DataFrame:
        layouts: dict[tuple, list[dict]] = {}
        for i, f in enumerate(files):
            f = f | {"file_no": i}
            layouts.setdefault((f["kind"], *f["headers"]), []).append(f)
        rows = None
        for (kind, *headers), some in layouts.items():
            ids = self.spark.createDataFrame([(f["file"], f["raw_file_id"], f["file_no"]) for f in some], "_file string, _id string, _no int")
            lines = tapes.read_lines(self.spark, [f["path"] for f in some], headers).join(F.broadcast(ids), "_file")
            part = tapes.landed(lines, F.col("_id"), kind, headers, keep={"file_no": F.col("_no")})
            rows = part if rows is None else rows.unionByName(part)
        return rows


def records(table: LandingTable) -> tuple[DataFrame, DataFrame]:
    """(records, import errors) of all that has landed, each file by its own header."""
    raw, layouts = table.rows(), {}
    for r in table.manifest().select("raw_file_id", "headers").collect():
        layouts.setdefault(tuple(r["headers"]), []).append(r["raw_file_id"])
    out = None
    for headers, ids in layouts.items():
        mine = raw.join(F.broadcast(table.spark.createDataFrame([(i,) for i in ids], "raw_file_id string")), "raw_file_id", "left_semi")
        part = tapes.normalised(mine, tapes.column_mapping(list(headers))[0])
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = tapes.normalised(raw, {})
    return tapes.quarantined(out)
