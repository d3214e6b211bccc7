"""Debounce of event bursts: a batch ends after a quiet gap, or at a cap since its first event."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

QUIET_MS, CAP_MS = 400, 3000


def quiet_batches(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """One row per burst, in batch or streaming (with a watermark): session windows end a burst after ``gap``."""
    w = F.session_window(ts, gap)
    return events.groupBy(key, w).agg(F.min(ts).alias("first_ts"), F.count("*").alias("n_events"), F.size(F.collect_set("event_type")).cast("long").alias("n_types")).drop("session_window")


def split_burst(times: list[int], quiet: int = QUIET_MS, cap: int = CAP_MS) -> list[tuple[int, int]]:
    """Ranges of sorted times (ms) that form a batch: a gap of ``quiet`` or ``cap`` since its first ends it."""
    out, first = [], 0
    for i in range(1, len(times) + 1):
        if i == len(times) or times[i] - times[i - 1] >= quiet or times[i] - times[first] >= cap:
            out.append((first, i))
            first = i
    return out


_OUT = "key string, first_ms long, last_ms long, paths array<string>"


def capped_batches(events: DataFrame, quiet: int = QUIET_MS, cap: int = CAP_MS) -> DataFrame:
    """Batch form over events (key, ts_ms, path): the sets of paths of each batch, one group's events at a time."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts_ms", "path"])
        t = pdf["ts_ms"].tolist()
        rows = [(pdf["key"].iloc[0], t[a], t[b - 1], sorted(set(pdf["path"].iloc[a:b]))) for a, b in split_burst(t, quiet, cap)]
        return pd.DataFrame(rows, columns=["key", "first_ms", "last_ms", "paths"])

    return events.select("key", "ts_ms", "path").groupBy("key").applyInPandas(run, _OUT)


def capped_stream(events: DataFrame, quiet: int = QUIET_MS, cap: int = CAP_MS) -> DataFrame:
    """Streaming form over events (key, ts timestamp, path) with a watermark on ts.

    Each key holds the paths of its open batch; event-time timers close it.
    """

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done = []
        first, last, paths = state.get if state.exists else (0, 0, [])
        paths = set(paths)
        if state.hasTimedOut:
            done.append((key[0], first, last, sorted(paths)))
            state.remove()
        else:
            rows = sorted((int(ts.value // 1_000_000), path) for pdf in pdfs for ts, path in zip(pdf["ts"], pdf["path"], strict=True))
            for ms, path in rows:
                if paths and (ms - last >= quiet or ms - first >= cap):
                    done.append((key[0], first, last, sorted(paths)))
                    paths = set()
                if not paths:
                    first = ms
                last = max(ms, last if paths else ms)
                paths.add(path)
            if paths:
                state.update((first, last, sorted(paths)))
                state.setTimeoutTimestamp(max(min(last + quiet, first + cap), state.getCurrentWatermarkMs() + 1))
        if done:
            yield pd.DataFrame(done, columns=["key", "first_ms", "last_ms", "paths"])

    return events.groupBy("key").applyInPandasWithState(run, _OUT, "first long, last long, paths array<string>", "append", GroupStateTimeout.EventTimeTimeout)
