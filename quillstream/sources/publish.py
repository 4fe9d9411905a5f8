"""Publishing what a run wrote: a branch of files and a request to take it over, opened once and reused.

A publisher is anything with ``publish(outputs, request) -> Published``. ``TablePublisher`` keeps branches and requests as versioned tables,
for any storage; ``GitPublisher`` commits to a working copy and pushes the branch to its remote. Both may run again: the branch
is replaced, an open request is found and not opened twice.
"""

from __future__ import annotations

import os
import subprocess
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.sources.options import repository
from quillstream.sources.storage import inside, read_version, write_files, write_version


@dataclass(frozen=True)
class Request:
    owner: str
    name: str
    branch: str
    base: str
    message: str
    title: str
    body: str
    comment: str = ""


@dataclass(frozen=True)
class Published:
    url: str | None
    number: int | None
    created: bool
    files: int


class Publisher(Protocol):
    def publish(self, outputs: DataFrame, request: Request) -> Published: ...


# What a commit and a request say.
MESSAGE = "docs: automated translation update"
BASE = "main"


def request_of(target: str, short_id: str, comment: str, base: str | None = None, prefix: str = "translations", body: str = "Automated documentation translation.") -> Request:
    """The request of a run over the revision ``short_id`` of ``target`` (owner/name)."""
    owner, name = repository(target)
    return Request(owner, name, f"{prefix}/{short_id}", base or BASE, MESSAGE, MESSAGE, body, comment)


class FolderPublisher:
    """A dry run: the files below a root, no request."""

    def __init__(self, root: str) -> None:
        self.root = root

    def publish(self, outputs: DataFrame, request: Request | None = None) -> Published:
        return Published(None, None, False, write_files(outputs, self.root, "output_path", "markdown"))


class TablePublisher:
    """Branches as tables (output_path, markdown) and one table of requests below a root."""

    REQUESTS = "number long, owner string, name string, branch string, base string, title string, body string, open boolean, comments array<string>"

    def __init__(self, root: str) -> None:
        self.root = root

    def branch(self, spark: SparkSession, request: Request) -> DataFrame:
        return read_version(spark, f"{self.root}/branches/{request.owner}/{request.name}/{inside(request.branch)}", "output_path string, markdown string")

    def requests(self, spark: SparkSession) -> DataFrame:
        return read_version(spark, f"{self.root}/requests", self.REQUESTS)

    def publish(self, outputs: DataFrame, request: Request) -> Published:
        spark = outputs.sparkSession
        write_version(outputs.select("output_path", "markdown"), f"{self.root}/branches/{request.owner}/{request.name}/{inside(request.branch)}", keep=0)
        known = self.requests(spark)
        mine = (F.col("owner") == request.owner) & (F.col("name") == request.name) & (F.col("branch") == request.branch) & F.col("open")
        found = known.where(mine).agg(F.min("number")).first()[0]
        number = found if found is not None else (known.agg(F.max("number")).first()[0] or 0) + 1
        new = spark.createDataFrame([(number, request.owner, request.name, request.branch, request.base, request.title, request.body, True, [])], self.REQUESTS)
        rows = known if found is not None else known.unionByName(new)
        if request.comment.strip():
            said = F.when(F.col("number") == number, F.concat("comments", F.array(F.lit(request.comment)))).otherwise(F.col("comments"))
            rows = rows.withColumn("comments", said)
        if found is None or request.comment.strip():
            write_version(rows.coalesce(1), f"{self.root}/requests")
        return Published(f"{self.root}/requests#{number}", number, found is None, self.branch(spark, request).count())

    def close(self, spark: SparkSession, number: int) -> None:
        write_version(self.requests(spark).withColumn("open", F.col("open") & (F.col("number") != number)).coalesce(1), f"{self.root}/requests")


class GitPublisher:
    """Commits to a working copy on this machine, by the branch made anew from where the copy stands, and pushes it by force.

    A working copy is one machine's by nature; the files come to it a partition at a time. Opening a request at a code host
    is left to ``open_request(request) -> (url, number, created)``.
    """

    def __init__(self, copy: str, remote: str = "origin", author: tuple[str, str] = ("translations", "translations@localhost"), open_request=None) -> None:
        self.copy, self.remote, self.author, self.open_request = copy, remote, author, open_request

    def _git(self, *args: str) -> str:
        identity = ["-c", f"user.name={self.author[0]}", "-c", f"user.email={self.author[1]}", "-c", "core.autocrlf=false"]
        done = subprocess.run(["git", "-C", self.copy, *identity, *args], capture_output=True, text=True, check=False)
        if done.returncode:
            raise RuntimeError(f"git {args[0]}: {done.stderr.strip()}")
        return done.stdout.strip()

    def publish(self, outputs: DataFrame, request: Request) -> Published:
        self._git("checkout", "-q", "-B", request.branch)
        files = 0
        for row in outputs.select("output_path", "markdown").toLocalIterator():
            name = inside(row.output_path)
            full = os.path.join(self.copy, name)
            os.makedirs(os.path.dirname(full), exist_ok=True)
            with open(full, "w", encoding="utf-8", newline="") as file:
                file.write(row.markdown)
            self._git("add", "--", name)
            files += 1
        if self._git("status", "--porcelain", "--untracked-files=no"):
            self._git("commit", "-q", "-m", request.message)
        self._git("push", "-q", self.remote, f"+refs/heads/{request.branch}:refs/heads/{request.branch}")
        url, number, created = self.open_request(request) if self.open_request else (None, None, False)
        return Published(url, number, created, files)
