"""When work is due, who may do it, and what to do without a change feed."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta

from pyspark.sql import DataFrame

from skarn.operators import structure

STALE_LOCK_SECONDS, POLL_SECONDS = 60.0, 30.0


@contextmanager
def exclusive(path: str, timeout: float = 1.0, stale: float = STALE_LOCK_SECONDS, clock: Callable[[], float] = time.time) -> Iterator[bool]:
    """Whether this process got the lock file; one whose owner is gone, or older than ``stale`` seconds, is taken over."""
    until, held = time.monotonic() + timeout, False
    while not held:
        try:
            with os.fdopen(os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY), "w") as f:
                json.dump({"pid": os.getpid(), "at": clock()}, f)
            held = True
        except FileExistsError:
            if _abandoned(path, stale, clock()):
                with_suffix = f"{path}.{os.getpid()}"
                try:
                    os.rename(path, with_suffix)  # of several only one can take it away
                    os.remove(with_suffix)
                except FileNotFoundError:
                    pass
            elif time.monotonic() >= until:
                break
            else:
                time.sleep(0.02)
    try:
        yield held
    finally:
        if held:
            os.remove(path)


def _abandoned(path: str, stale: float, now: float) -> bool:
    try:
        with open(path) as f:
            owner = json.load(f)
        os.kill(owner["pid"], 0)
    except FileNotFoundError:
        return False
    except ProcessLookupError:
        return True
    except (ValueError, KeyError, PermissionError):
        return now - os.path.getmtime(path) > stale if os.path.exists(path) else False
    return now - owner["at"] > stale


def due(last: datetime | None, every: timedelta, now: datetime, enabled: bool = True, running: bool = False) -> bool:
    """Whether scheduled work should start: never while it runs, at once if it never ran."""
    return enabled and not running and (last is None or now - last >= every)


def poll(list_files: Callable[[], DataFrame], stored: DataFrame) -> DataFrame:
    """path and change since ``stored`` (path, size, mtime), for folders whose changes no feed reports."""
    return structure.manifest_diff(stored, list_files()).filter("change <> 'unchanged'")
