"""What git tells of a repository, read by parsers that need no repository, and what follows from it."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS, SECONDS = 200, 5
STATUS = {"?": "untracked", "A": "added", "D": "deleted", "R": "renamed", "C": "copied", "M": "modified", "U": "conflicted", "T": "type changed"}


def parse_status(out: str) -> list[tuple[str, str, str | None]]:
    """(path, status, previous path) of ``status --porcelain -z``."""
    parts, found = iter(out.split("\0")), []
    for entry in parts:
        if len(entry) < 4:
            continue
        code, path = entry[:2], entry[3:]
        letter = next((c for c in code if c in "RDACMUT?"), "M")
        found.append((path, STATUS[letter], next(parts, None) if letter in "RC" else None))
    return found


def parse_log(out: str) -> list[tuple[str, str, str, str, int, int]]:
    """(commit, author, date, path, added, deleted) of ``log --numstat --format=%x1e%H%x1f%an%x1f%aI``, newest first."""
    rows = []
    for block in out.split("\x1e"):
        head, _, body = block.strip("\n").partition("\n")
        if head.count("\x1f") != 2:
            continue
        commit, author, date = head.split("\x1f")
        for line in body.splitlines():
            added, _, rest = line.partition("\t")
            deleted, _, path = rest.partition("\t")
            if path:
                rows.append((commit, author, date, path, int(added) if added.isdigit() else 0, int(deleted) if deleted.isdigit() else 0))
    return rows


def _git(root: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=SECONDS)
    return done.stdout if done.returncode == 0 else ""


def changed_files(spark: SparkSession, root: str) -> DataFrame:
    return spark.createDataFrame(parse_status(_git(root, "status", "--porcelain", "-z")), "path string, status string, previous_path string")


def history(spark: SparkSession, root: str, commits: int = COMMITS) -> DataFrame:
    rows = parse_log(_git(root, "log", f"-{commits}", "--numstat", "--format=%x1e%H%x1f%an%x1f%aI"))
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq int, commit string, author string, date string, path string, added int, deleted int")


def hotspots(log: DataFrame, *, limit: int = 12) -> DataFrame:
    """Files by churn; ``seq`` (a number, or anything else that has an order) counts from the newest change, whose author and date are the last ones."""
    newest = lambda c: F.min_by(c, "seq")
    rows = log.groupBy("path").agg(
        F.countDistinct("commit").alias("commits"), F.sum(F.col("added") + F.col("deleted")).alias("churn"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"),
        F.countDistinct("author").alias("authors"), newest("commit").alias("last_commit"), newest("author").alias("last_author"), newest("date").alias("last_date"),
    )
    return rows.orderBy(F.desc("churn"), F.desc("commits"), "path").limit(limit)
