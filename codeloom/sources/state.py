"""Small state beside the tables: project catalog, decisions, run log, lock, configuration, diagnostics, benchmark."""

from __future__ import annotations

import contextlib
import json
import os
import time
from collections.abc import Callable
from datetime import UTC, datetime

STALE_LOCK = 600
#: setting -> (short name, default)
SETTINGS = {
    "index.max_files": ("max-files", 20_000), "index.max_bytes": ("max-bytes", 750_000), "index.hidden": ("hidden", False), "search.limit": ("limit", 20), "trace.depth": ("depth", 2),
    "vectors.dimensions": ("dimensions", 384), "watch.interval": ("interval", 2.5), "secrets.confidence": ("confidence", "low"), "secrets.tests": ("tests", False), "package.path": ("package", ""),
}
STATUSES = ("proposed", "accepted", "deprecated", "superseded")


def now() -> str:
    return datetime.now(UTC).isoformat()


@contextlib.contextmanager
def locked(path: str, *, stale: float = STALE_LOCK):
    """Hold ``path``.lock; a lock older than ``stale`` seconds is taken over, a younger one raises BlockingIOError."""
    name = f"{path}.lock"
    with contextlib.suppress(FileNotFoundError):
        if time.time() - os.path.getmtime(name) > stale:
            os.remove(name)
    try:
        os.close(os.open(name, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
    except FileExistsError as e:
        raise BlockingIOError(f"{path} is locked") from e
    try:
        yield
    finally:
        with contextlib.suppress(FileNotFoundError):
            os.remove(name)


class Store:
    """A JSON list on disk, changed under its lock and replaced whole."""

    def __init__(self, path: str):
        self.path = path

    def read(self) -> list[dict]:
        if not os.path.exists(self.path):
            return []
        with open(self.path) as f:
            return json.load(f)

    def change(self, how: Callable[[list[dict]], object]):
        with locked(self.path):
            rows = self.read()
            out = how(rows)
            with open(f"{self.path}.new", "w") as f:
                json.dump(rows, f)
            os.replace(f"{self.path}.new", self.path)
        return out


class Catalog(Store):
    """Projects by root, the last indexed first."""

    def record(self, root: str, label: str | None = None, **totals) -> dict:
        row = {"root": root, "label": label or os.path.basename(root.rstrip("/")), "indexed_at": now(), **totals}

        def put(rows):
            rows[:] = [row, *(r for r in rows if r["root"] != root)]
            return row

        return self.change(put)

    def find(self, name: str) -> dict | None:
        return next((r for r in self.read() if name in (r["root"], r["label"])), None)

    def forget(self, name: str) -> bool:
        def drop(rows):
            before = len(rows)
            rows[:] = [r for r in rows if name not in (r["root"], r["label"])]
            return len(rows) < before

        return self.change(drop)


class Decisions(Store):
    """Architecture decisions, newest first."""

    def add(self, title: str, body: str, *, status: str = "proposed", tags: list[str] = ()) -> dict:
        self._known(status)

        def put(rows):
            row = {"id": max((r["id"] for r in rows), default=0) + 1, "title": title, "status": status, "body": body, "tags": list(tags), "created_at": now()}
            rows.append(row)
            return row

        return self.change(put)

    def update(self, number: int, **fields) -> dict | None:
        self._known(fields.get("status", "proposed"))

        def put(rows):
            row = next((r for r in rows if r["id"] == number), None)
            if row:
                row.update({k: v for k, v in fields.items() if k in ("title", "status", "body", "tags") and v is not None})
            return row

        return self.change(put)

    def delete(self, number: int) -> bool:
        def drop(rows):
            before = len(rows)
            rows[:] = [r for r in rows if r["id"] != number]
            return len(rows) < before

        return self.change(drop)

    def list(self) -> list[dict]:
        return sorted(self.read(), key=lambda r: -r["id"])

    def get(self, number: int) -> dict | None:
        return next((r for r in self.read() if r["id"] == number), None)

    @staticmethod
    def _known(status: str) -> None:
        if status not in STATUSES:
            raise ValueError(f"status is one of {STATUSES}")


class Runs(Store):
    """The log of indexing runs."""

    def record(self, root: str, label: str | None = None) -> None:
        self.change(lambda rows: rows.append({"id": len(rows) + 1, "root": root, "label": label, "indexed_at": now()}))

    def latest_root(self) -> str | None:
        rows = self.read()
        return rows[-1]["root"] if rows else None


class Config(Store):
    """Settings by full or short name; values take the type of the default."""

    @staticmethod
    def key(name: str) -> str:
        found = next((k for k, (short, _) in SETTINGS.items() if name in (k, short)), None)
        if not found:
            raise KeyError(f"no setting {name}")
        return found

    def get(self, name: str):
        key = self.key(name)
        return next((r["value"] for r in self.read() if r["key"] == key), SETTINGS[key][1])

    def set(self, name: str, value):
        key = self.key(name)
        kind = type(SETTINGS[key][1])
        value = str(value).lower() in ("1", "true", "yes", "on") if kind is bool else kind(value)

        def put(rows):
            rows[:] = [*(r for r in rows if r["key"] != key), {"key": key, "value": value}]
            return value

        return self.change(put)

    def reset(self, name: str | None = None) -> None:
        key = self.key(name) if name else None
        self.change(lambda rows: rows.__setitem__(slice(None), [r for r in rows if key and r["key"] != key]))

    def list(self) -> dict:
        return {k: self.get(k) for k in SETTINGS}


def clipped(value, depth: int = 4):
    """A value small enough to log: strings of 500 characters, lists of 25, 50 keys, four levels."""
    if isinstance(value, str):
        return value[:500]
    if isinstance(value, dict):
        return {str(k): clipped(v, depth - 1) for k, v in list(value.items())[:50] if k not in ("text", "content", "source_text")} if depth else "..."
    if isinstance(value, list | tuple):
        return [clipped(v, depth - 1) for v in value[:25]] if depth else "..."
    return value if isinstance(value, int | float | bool | None) else str(value)[:500]


class Diagnostics:
    """Events as JSON lines; texts of sources never go in."""

    def __init__(self, path: str):
        self.path = path

    def event(self, name: str, **details) -> None:
        with open(self.path, "a") as f:
            f.write(json.dumps({"at": now(), "event": name, **clipped(details)}) + "\n")


def benchmark(steps: dict[str, Callable[[], int]]) -> list[dict]:
    """Seconds and items a second of each step, in order; a step returns its number of items."""
    out = []
    for name, step in steps.items():
        began = time.perf_counter()
        n = step()
        took = time.perf_counter() - began
        out.append({"step": name, "items": n, "seconds": round(took, 3), "per_second": round(n / took, 2) if took else None})
    return out
