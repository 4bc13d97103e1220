"""Git history as a Spark data source: partitions are ranges of a repository's commits.

A range is one pass of the log behind a pinned head, read record by record from a pipe.
Diffs and blobs come from pipes too: a task holds the commit that it is at and a batch of
rows of bounded size, never the output of a process.
"""

from __future__ import annotations

import contextlib
import glob
import os
import subprocess
import tempfile
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone
from fnmatch import fnmatch

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import schemas


class GitError(RuntimeError):
    pass


def git(*args: str, cwd: str | None = None) -> str:
    done = subprocess.run(["git", *args], cwd=cwd, capture_output=True)
    if done.returncode:
        raise GitError(f"git {args[0]}: {done.stderr.decode(errors='replace').strip()[:500]}")
    return done.stdout.decode(errors="replace")


def discover_repos(include: list[str], exclude: list[str] = ()) -> list[str]:
    """Sorted folders that match a glob, hold .git and match no exclude."""
    found = {os.path.abspath(p) for g in include for p in glob.glob(os.path.expanduser(g), recursive=True) if os.path.exists(os.path.join(p, ".git"))}
    return sorted(p for p in found if not any(fnmatch(p, x) for x in exclude))


def clone_or_fetch(url: str, path: str, mirror: bool = False, prune: bool = True) -> str:
    if os.path.isdir(path):
        git("fetch", "--all", *(["--prune"] if prune else []), cwd=path)
    else:
        git("clone", *(["--mirror"] if mirror else []), url, path)
    return path


#: Commits of a partition.
RANGE = 2_000


@contextlib.contextmanager
def piped(*args: str, cwd: str, lines: list[str] | None = None):
    """A git process with its output as a stream; lines, if given, are its whole input. Raises if it fails."""
    with tempfile.TemporaryFile() as errors, tempfile.TemporaryFile() as given:
        given.write("".join(f"{x}\n" for x in lines or ()).encode())
        given.seek(0)
        with subprocess.Popen(["git", *args], cwd=cwd, stdin=given, stdout=subprocess.PIPE, stderr=errors) as p:
            try:
                yield p.stdout
            except BaseException:
                p.kill()
                raise
            if p.wait():
                errors.seek(0)
                raise GitError(f"git {args[0]}: {errors.read().decode(errors='replace').strip()[:500]}")


def records(stream, mark: bytes, size: int = 1 << 16) -> Iterator[bytes]:
    """What lies behind each mark of a stream, up to the next one or the end."""
    held, open_, seen = bytearray(), False, 0
    while True:
        piece = stream.read(size)
        held += piece
        at = held.find(mark, seen)
        while at >= 0:
            if open_:
                yield bytes(held[:at])
            open_ = True
            del held[: at + len(mark)]
            at = held.find(mark)
        seen = max(0, len(held) - len(mark) + 1)  # no mark begins before
        if not piece:
            break
    if open_:
        yield bytes(held)


class _Range(InputPartition):
    def __init__(self, path: str, head: str, skip: int, n: int):
        super().__init__((path, head, skip, n))
        self.path, self.head, self.skip, self.n = path, head, skip, n


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("repos", "").split(os.pathsep) if p]
        self.most = int(options.get("max_commits") or 0)
        self.range = int(options.get("range") or RANGE)

    def partitions(self):
        out = []
        for path in self.paths:
            head = git("rev-parse", "--verify", "-q", "HEAD", cwd=path).strip() if git("rev-list", "-n1", "--all", cwd=path) else ""
            n = int(git("rev-list", "--count", head, cwd=path)) if head else 0
            n = min(n, self.most) if self.most else n
            # the log counts from the newest commit on; a range's own order is oldest first
            out += [_Range(path, head, k, min(self.range, n - k)) for k in reversed(range(0, n, self.range))]
        return out

    def read(self, partition) -> Iterator[tuple]:
        # fields are parted by control characters, which no e-mail or path holds
        p = partition
        with piped("log", "--reverse", "--name-only", "--pretty=format:%x1e%H%x1f%P%x1f%ae%x1f%at%x1f", f"--skip={p.skip}", f"-n{p.n}", p.head, cwd=p.path) as stream:
            for entry in records(stream, b"\x1e"):
                sha, parents, author, at, files = entry.decode(errors="replace").split("\x1f", 4)
                names = [f for f in files.split("\n") if f]
                yield (p.path, sha, parents.split(" ")[0] or None, author, datetime.fromtimestamp(int(at), timezone.utc), names)


class GitLog(DataSource):
    """spark.read.format("git_log").option("repos", paths joined by os.pathsep).load()"""

    @classmethod
    def name(cls):
        return "git_log"

    def schema(self):
        return schemas.MINED_COMMITS

    def reader(self, schema):
        return _Reader(self.options)


def mined_commits(spark: SparkSession, repos: list[str], max_commits: int | None = None, commits_a_task: int = RANGE) -> DataFrame:
    """The commits of each repository's head, the newest max_commits of them if given; a task reads so many."""
    spark.dataSource.register(GitLog)
    r = spark.read.format("git_log").option("repos", os.pathsep.join(repos)).option("range", str(commits_a_task))
    return (r.option("max_commits", str(max_commits)) if max_commits else r).load()


def known_commits(repo: str, shas: list[str]) -> list[str]:
    """Those of the commits that the repository has."""
    with piped("cat-file", "--batch-check", cwd=repo, lines=shas) as stream:
        heads = [line.split() for line in stream]
    return [sha for sha, h in zip(shas, heads, strict=True) if h[1:2] == [b"commit"]]


def diffs(repo: str, shas: list[str]) -> Iterator[tuple[str, str]]:
    """Each commit and its diff, one after another, in one pass; those that the repository hasn't are left out."""
    if not (known := known_commits(repo, shas)):
        return
    mark = f"commit-{uuid.uuid4().hex} "
    with piped("show", "--stdin", "--unified=0", f"--format={mark}%H", cwd=repo, lines=known) as stream:
        for part in records(stream, mark.encode()):
            sha, _, body = part.decode(errors="replace").partition("\n")
            yield sha, body.lstrip("\n")


class Blobs:
    """The texts of a repository's objects (commit:path), asked one by one of one process; missing ones are empty."""

    def __init__(self, repo: str):
        self.process = subprocess.Popen(["git", "cat-file", "--batch"], cwd=repo, stdin=subprocess.PIPE, stdout=subprocess.PIPE)

    def text(self, name: str) -> str:
        self.process.stdin.write(name.encode() + b"\n")
        self.process.stdin.flush()
        head = self.process.stdout.readline().rstrip(b"\n").rsplit(b" ", 2)
        if len(head) != 3 or not head[2].isdigit():
            return ""  # no such object
        body = self.process.stdout.read(int(head[2]) + 1)[:-1]
        return body.decode(errors="replace") if head[1] == b"blob" else ""  # else a folder

    def __enter__(self) -> Blobs:
        return self

    def __exit__(self, *_) -> None:
        self.process.stdin.close()
        self.process.stdout.close()
        self.process.wait()


#: Characters of a batch of changes.
BATCH_CHARS = 16 << 20


def with_changes(commits: DataFrame, want_blobs: bool = False, most: int = BATCH_CHARS) -> DataFrame:
    """commits with diff_text and, for Python files, before_blobs and after_blobs; readable is false where there is no such commit.

    Blobs that can't be read are empty texts. Three processes a repository and batch of rows
    are read as streams; rows go on as soon as they hold ``most`` characters."""
    names = ["repo_path", "commit_id", "readable", "diff_text", "before_blobs", "after_blobs"]

    def changes(repo: str, own: pd.DataFrame) -> Iterator[tuple]:
        rows = {sha: (parent or f"{sha}^", files) for sha, parent, files in zip(own["commit_id"], own["parent_id"], own["changed_files"], strict=True)}
        with Blobs(repo) as blobs:

            def sides(sha: str) -> list[dict]:
                before, files = rows[sha]
                files = [x for x in files if x.endswith(".py") and "\n" not in x] if want_blobs else []
                return [{x: blobs.text(f"{side}:{x}") for x in files} for side in (before, sha)]

            left = dict.fromkeys(rows)
            for sha, text in diffs(repo, list(rows)):
                if sha in left:
                    del left[sha]
                    yield (repo, sha, True, text, *sides(sha))
            for sha in left:
                yield (repo, sha, False, "", *sides(sha))

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows, held = [], 0
            for repo, own in f.groupby("repo_path", sort=False):
                for row in changes(repo, own):
                    rows.append(row)
                    held += len(row[3]) + sum(len(x) for side in row[4:] for x in side.values())
                    if held > most:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
            yield pd.DataFrame(rows, columns=names)

    own = commits.select("repo_path", "commit_id", "parent_id", "changed_files")
    extra = own.mapInPandas(task, "repo_path string, commit_id string, readable boolean, diff_text string, before_blobs map<string,string>, after_blobs map<string,string>")
    return commits.join(extra, ["repo_path", "commit_id"])


def in_ranges(commits: DataFrame, commits_a_task: int = 200) -> DataFrame:
    """Commits dealt by repository and time, so that tasks of any number read neighbours of one repository."""
    n = max(commits.sparkSession.sparkContext.defaultParallelism, -(-commits.count() // commits_a_task))
    return commits.repartitionByRange(n, "repo_path", "authored_at", "commit_id")
