"""A batch data source over local repositories: ``spark.read.format("gitlog").option("repos", "a,b")``.

A partition is a range of commits of one repository, read by one ``git`` process of each kind; the paths must exist on every
executor (a shared folder). Option ``part`` chooses ``commits`` (raw_commits columns) or ``changes`` (one row per changed file of commits
with one parent, with its patch; a file that was moved is one row with both paths). ``seq`` is the place of a commit in
its history, oldest first, and differs between repositories.
"""

from __future__ import annotations

import re
import subprocess
import threading
from collections.abc import Iterator
from pathlib import Path
from typing import BinaryIO

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

COMMITS = "seq long, sha string, repo string, parents array<string>, author_email string, committer_email string, authored_epoch long, committed_epoch long, message string, signature string"
CHANGES = "seq long, sha string, repo string, file_ord int, a_path string, b_path string, is_new boolean, is_deleted boolean, patch string, header binary"
SHA = re.compile(rb"[0-9a-f]{40,64}")
PERSON = re.compile(r"<([^>]*)> (-?\d+)")
ESCAPED = re.compile(rb"\\([abfnrtv\"\\]|[0-7]{3})")
ESCAPES = {b"a": b"\a", b"b": b"\b", b"f": b"\f", b"n": b"\n", b"r": b"\r", b"t": b"\t", b"v": b"\v", b'"': b'"', b"\\": b"\\"}


def git(repo: str, *args: str) -> bytes:
    return subprocess.run(["git", "-C", repo, *args], capture_output=True, check=True).stdout


def stream(repo: str, asked: list[str], *args: str) -> Iterator[BinaryIO]:
    """Output of a ``git`` process that is fed the lines ``asked``, as a context of one file."""
    with subprocess.Popen(["git", "-C", repo, *args], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as p:

        def feed() -> None:
            with p.stdin as f:
                f.write("".join(f"{x}\n" for x in asked).encode())

        writer = threading.Thread(target=feed)
        writer.start()
        yield p.stdout
        writer.join()
    if p.returncode:
        raise RuntimeError(f"git {args[0]} failed in {repo}")


def path_of(raw: bytes) -> str:
    """A path as git prints it: quoted with escapes if it holds odd characters."""
    if raw.startswith(b'"'):
        raw = ESCAPED.sub(lambda m: ESCAPES.get(m[1]) or bytes([int(m[1], 8)]), raw[1:-1])
    return raw.decode("utf-8", "replace")


def objects(repo: str, names: list[str], most: int | None = None) -> Iterator[bytes]:
    """Contents of objects, of each the first ``most`` bytes, from one process."""
    for out in stream(repo, names, "cat-file", "--batch"):
        for _ in names:
            size = int(out.readline().split()[2])
            keep = size if most is None else min(size, most)
            yield out.read(keep)
            left = size - keep + 1  # and a line feed
            while left:
                left -= len(out.read(min(left, 1 << 20)))


class Range(InputPartition):
    """``count`` commits of ``head``'s history after the newest ``skip``; ``first`` is the seq of the newest of them."""

    def __init__(self, repo: str, head: str, skip: int, count: int, first: int) -> None:
        self.repo, self.head, self.skip, self.count, self.first = repo, head, skip, count, first

    def commits(self) -> list[tuple[int, list[str]]]:
        """(seq, [sha, parent...])"""
        lines = git(self.repo, "rev-list", "--parents", f"--skip={self.skip}", f"--max-count={self.count}", self.head).decode().splitlines()
        return [(self.first - k, line.split()) for k, line in enumerate(lines)]


class GitLogReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.repos = [r for r in options.get("repos", "").split(",") if r]
        self.part = options.get("part", "commits")
        self.size = int(options.get("commits_per_partition", "500"))
        if not self.repos:
            raise ValueError("option repos: paths of repositories, separated by commas")

    def partitions(self) -> list[Range]:
        """Ranges by number only: of a history, its newest commit and its length come to the driver."""
        out = []
        for k, repo in enumerate(self.repos):
            if not (Path(repo) / ".git").is_dir():
                raise ValueError(f"{repo} is no repository")
            head = git(repo, "rev-parse", "HEAD").decode().strip()
            total = int(git(repo, "rev-list", "--count", head))
            out += [Range(repo, head, i, self.size, (k << 40) + total - 1 - i) for i in range(0, total, self.size)]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        return (self._commits if self.part == "commits" else self._changes)(partition.repo, partition.commits())

    def _commits(self, repo: str, commits: list[tuple[int, list[str]]]) -> Iterator[tuple]:
        for (seq, (sha, *parents)), raw in zip(commits, objects(repo, [c[0] for _, c in commits])):
            head, _, message = raw.decode("utf-8", "replace").partition("\n\n")
            fields: dict[str, str] = {}
            for line in head.split("\n"):
                if not line.startswith(" "):  # the lines of a signature go on with a space
                    name, _, value = line.partition(" ")
                    fields.setdefault(name, value)
            author, committer = (PERSON.search(fields.get(k, "")) for k in ("author", "committer"))
            yield (seq, sha, repo, parents, author and author[1], committer and committer[1], author and int(author[2]), committer and int(committer[2]), message, fields.get("gpgsig", fields.get("gpgsig-sha256")))

    def _changes(self, repo: str, commits: list[tuple[int, list[str]]]) -> Iterator[tuple]:
        single = {c[0]: seq for seq, c in commits if len(c) == 2}  # only commits of one parent have a diff that is scored
        args = ["-c", "core.quotePath=true", "diff-tree", "--stdin", "-r", "-M", "--raw", "-p", "--full-index", "--no-abbrev", "--no-color", "--no-ext-diff", "--no-textconv"]
        for out in stream(repo, list(single), *args):
            sha, files, patches = None, [], []
            for line in out:
                if SHA.fullmatch(line.rstrip(b"\n")):
                    if sha:
                        yield from self._files(repo, single[sha], sha, files, patches)
                    sha, files, patches = line.decode().strip(), [], []
                elif line.startswith(b":") and not patches:
                    files.append(line.rstrip(b"\n"))
                elif line.startswith(b"diff --git "):
                    patches.append([line])
                elif patches:
                    patches[-1].append(line)
            if sha:
                yield from self._files(repo, single[sha], sha, files, patches)

    def _files(self, repo: str, seq: int, sha: str, files: list[bytes], patches: list[list[bytes]]) -> Iterator[tuple]:
        rows = []
        rest = iter(patches)
        for raw in files:
            about, *paths = raw.split(b"\t")
            _, mode, _, blob, status = about.split()
            # a file that turned into a link, or back, has two patches
            patch = b"".join(x for _ in range(2 if status[:1] == b"T" else 1) for x in next(rest, []))
            rows.append((status[:1].decode(), path_of(paths[0]), path_of(paths[-1]), mode, blob.decode(), patch.decode("utf-8", "replace")))
        new = [r[4] for r in rows if r[0] == "A" and r[3] != b"160000"]  # a submodule is no blob
        headers = iter(objects(repo, new, 4)) if new else iter(())
        for k, (status, a, b, mode, _, patch) in enumerate(rows):
            header = next(headers) if status == "A" and mode != b"160000" else None
            yield (seq, sha, repo, k, None if status == "A" else a, None if status == "D" else b, status == "A", status == "D", patch, header)


class GitLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return COMMITS if self.options.get("part", "commits") == "commits" else CHANGES

    def reader(self, schema) -> GitLogReader:
        return GitLogReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GitLog)
