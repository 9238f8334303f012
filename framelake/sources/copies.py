"""Verified copies as a Spark sink: a dry run first, then copies that never overwrite, and audit rows of what was done.

`dry_run` says of each file of a plan whether it can be copied; its summary is kept beside the audit. `copied` refuses a
plan without a dry run, or one whose last dry run found nothing to copy, and writes the rest through a data source
writer. A task stages each file under the plan's own folder, reads it back, compares SHA-256 digests, and publishes it by
a hard link, which the file system refuses where the target exists. A retry of a task whose executor was lost finds its
own staged files and links again and reports the same; two attempts at once do not disturb each other, either. Audit
rows are files of the tasks; they join the audit when Spark commits the job, only those of the attempts that it
commits. If the job is given up, the links that it made are taken away and nothing stays.

root is a folder that all executors mount. Rows without a target, with one outside root, or without content are errors;
a null digest is none; two rows of one target are published once, the other is refused.
"""

from __future__ import annotations

import errno
import hashlib
import json
import os
import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "verified_copies"
AUDIT = "plan string, media_id long, action string, result string, target string, bytes long, digest_before string, digest_after string"
PLAN = "media_id long, target string, conflict string, content binary"
OWN = ".copies"


def _digest(data: bytes) -> str:
    return f"sha256:{hashlib.sha256(data).hexdigest()}"


@dataclass
class Done(WriterCommitMessage):
    """What a task has to tell: where its audit rows are, and how many files it has copied and not."""

    audit: str
    copied: int
    failed: int


class Copies(DataSourceWriter):
    def __init__(self, root: str, plan: str):
        self.root, self.plan = os.path.realpath(root), plan
        self.own = os.path.join(self.root, OWN, plan)

    def _one(self, row: Row, journal) -> dict:
        said = {"plan": self.plan, "media_id": row.media_id, "action": "copy", "target": row.target, "bytes": None, "digest_before": None, "digest_after": None}
        target = os.path.normpath(os.path.join(self.root, row.target or ""))
        if not row.target:
            return said | {"result": f"error: {row.conflict or 'no target'}"}
        if not target.startswith(os.path.join(self.root, "")) or target.startswith(os.path.join(self.root, OWN)):
            return said | {"result": "error: target outside the root"}
        if row.content is None:
            return said | {"result": "error: source out of reach"}
        data = bytes(row.content)
        said |= {"bytes": len(data), "digest_before": _digest(data)}
        staged = os.path.join(self.own, "staged", f"{row.media_id}-{hashlib.sha256(target.encode()).hexdigest()[:16]}")
        try:
            if not os.path.exists(staged):
                part = f"{staged}.{uuid.uuid4().hex}"
                with open(part, "xb") as f:
                    f.write(data)
                    f.flush()
                    os.fsync(f.fileno())
                try:
                    os.link(part, staged)
                except FileExistsError:  # another attempt was faster
                    pass
                os.unlink(part)
            with open(staged, "rb") as f:
                said["digest_after"] = _digest(f.read())
            if said["digest_after"] != said["digest_before"]:
                return said | {"result": "error: the copy differs"}
            os.makedirs(os.path.dirname(target), exist_ok=True)
            journal.write(json.dumps([staged, target]) + "\n")
            journal.flush()
            try:
                os.link(staged, target)
            except FileExistsError:
                if not os.path.samefile(staged, target):
                    return said | {"result": "refused: target exists"}
            return said | {"action": "verified copy", "result": "ok"}
        except OSError as e:
            return said | {"result": f"error: {'disk full' if e.errno == errno.ENOSPC else e.strerror}"}

    def write(self, rows: Iterator[Row]) -> Done:
        for folder in ("staged", "journal", "audit"):
            os.makedirs(os.path.join(self.own, folder), exist_ok=True)
        name, n = uuid.uuid4().hex, [0, 0]
        audit = os.path.join(self.own, "audit", f"{name}.json")
        with open(audit, "x") as out, open(os.path.join(self.own, "journal", name), "x") as journal:
            for row in rows:
                said = self._one(row, journal)
                n[said["result"] != "ok"] += 1
                out.write(json.dumps(said) + "\n")
        return Done(audit, *n)

    def commit(self, messages: list[Done | None]) -> None:
        told = os.path.join(self.root, OWN, "audit", self.plan)
        os.makedirs(told, exist_ok=True)
        done = [m for m in messages if m is not None]
        for m in done:
            os.replace(m.audit, os.path.join(told, os.path.basename(m.audit)))
        with open(os.path.join(told, f"finished-{uuid.uuid4().hex}.json"), "x") as f:
            copied, failed = sum(m.copied for m in done), sum(m.failed for m in done)
            f.write(json.dumps({"plan": self.plan, "media_id": None, "action": "finished", "result": "error" if failed else "done", "target": None, "bytes": copied, "digest_before": None, "digest_after": None}) + "\n")
        shutil.rmtree(self.own, ignore_errors=True)

    def abort(self, messages: list[Done | None]) -> None:
        journals = os.path.join(self.own, "journal")
        for name in os.listdir(journals) if os.path.isdir(journals) else ():
            with open(os.path.join(journals, name)) as f:
                for line in f:
                    staged, target = json.loads(line) if line.endswith("\n") else (None, None)
                    if staged and os.path.exists(staged) and os.path.exists(target) and os.path.samefile(staged, target):
                        os.unlink(target)
        shutil.rmtree(self.own, ignore_errors=True)


class VerifiedCopies(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return PLAN

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return Copies(self.options["root"], self.options["plan"])


def mounted(folder: str) -> str:
    """The path of a folder that executors mount; other stores are refused."""
    path = re.sub(r"^file:(//)?(?=/)", "", folder)
    if not path.startswith("/"):
        raise ValueError("copies need a folder that all executors mount")
    return path


def dry_run(plan: DataFrame, existing: DataFrame, root: str, name: str) -> DataFrame:
    """media_id, verdict (ready, no target, source out of reach, target exists, empty source), bytes; summed up beside the audit.

    plan: media_id, target, conflict, bytes and there (whether the source can be read); existing: the targets that are taken.
    """
    rows = plan.join(existing.select(F.col("target").alias("taken")).distinct(), F.col("target") == F.col("taken"), "left")
    verdict = F.when(F.coalesce("target", F.lit("")) == "", "no target").when(~F.coalesce("there", F.lit(False)), "source out of reach").when(F.col("taken").isNotNull(), "target exists")
    out = rows.select("media_id", verdict.when(F.coalesce("bytes", F.lit(0)) == 0, "empty source").otherwise("ready").alias("verdict"), "bytes")
    total = out.agg(F.count_if(F.col("verdict").isin("ready", "empty source")).alias("ready"), F.count("*").alias("n"), F.sum(F.when(F.col("verdict") == "ready", F.col("bytes"))).alias("bytes")).first()
    folder = os.path.join(root, OWN, "audit", name)
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, f"dry-run-{len(os.listdir(folder)):09d}.json"), "x") as f:
        f.write(json.dumps({"plan": name, "media_id": None, "action": "dry run", "result": f"{total.ready} of {total.n} ready", "target": None, "bytes": total.bytes or 0, "digest_before": None, "digest_after": None, "ready": total.ready}) + "\n")
    return out


def copied(plan: DataFrame, root: str, name: str) -> DataFrame:
    """The audit of the plan after its rows (media_id, target, conflict, content) were copied below root."""
    spark = plan.sparkSession
    folder = os.path.join(root, OWN, "audit", name)
    runs = sorted(x for x in os.listdir(folder) if x.startswith("dry-run-")) if os.path.isdir(folder) else []
    if not runs:
        raise PermissionError("a plan is copied after a dry run only")
    with open(os.path.join(folder, runs[-1])) as f:
        if not json.load(f)["ready"]:
            raise PermissionError("the last dry run found nothing to copy")
    spark.dataSource.register(VerifiedCopies)
    plan.select("media_id", "target", "conflict", "content").write.format(FORMAT).options(root=root, plan=name).mode("append").save()
    return audit(spark, root, name)


def summary(plan: DataFrame, told: DataFrame) -> DataFrame:
    """total, done, refused, errors, conflicts, open, dry_run of a plan (media_id, conflict) and its audit: a file counts by
    its best result, and the last dry run speaks for itself."""
    rank = F.when(F.col("result") == "ok", 3).when(F.col("result").startswith("refused"), 2).otherwise(1)
    per = told.where("action IN ('copy', 'verified copy')").groupBy("media_id").agg(F.max(rank).alias("best"))
    rows = plan.select("media_id", "conflict").join(per, "media_id", "left")
    n = rows.agg(F.count("*").alias("total"), *(F.count_if(F.col("best") == k).alias(c) for c, k in (("done", 3), ("refused", 2), ("errors", 1))), F.count_if(F.col("conflict").isNotNull()).alias("conflicts"), F.count_if(F.col("best").isNull()).alias("open"))
    return n.join(told.where("action = 'dry run'").agg(F.max_by("result", F.col("_metadata.file_name")).alias("dry_run")))  # one row each


def audit(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(AUDIT).json(f"file://{os.path.join(os.path.realpath(root), OWN, 'audit', name)}")
