"""Channels under a deadline: what is late is cancelled, and the rest is answered without it."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

from tessera.plans.cuts import cut


@dataclass
class Answers:
    """What channels gave, and the names of those that gave nothing, with the reason: `timeout` or `error`."""

    channels: dict[str, DataFrame] = field(default_factory=dict)
    degraded_channels: dict[str, str] = field(default_factory=dict)


def within(spark: SparkSession, channels: dict[str, Callable[[], DataFrame]], seconds: float) -> Answers:
    """Computes all channels at once, each in a job group of its own that is cancelled after so many seconds.

    A channel's result is written before it counts, so nothing of it is computed after the deadline. A channel that fails,
    as in a store that lacks its table, is degraded too; the others' results stand.
    """
    out, lock, done = Answers(), threading.Lock(), {}
    groups = {name: f"{name}-{uuid.uuid4().hex}" for name in channels}

    def run(name: str, build: Callable[[], DataFrame]) -> None:
        spark.sparkContext.setJobGroup(groups[name], f"channel {name}", interruptOnCancel=True)
        try:
            result = cut(build())
            with lock:
                if name not in out.degraded_channels:
                    out.channels[name] = result
        except Exception:  # noqa: BLE001  whatever a channel raises, the others answer
            with lock:
                out.degraded_channels.setdefault(name, "error")
        finally:
            done[name].set()

    for name in channels:
        done[name] = threading.Event()
    threads = {name: InheritableThread(target=run, args=(name, build), daemon=True) for name, build in channels.items()}
    for thread in threads.values():
        thread.start()
    timer_over = threading.Event()
    timer = threading.Timer(seconds, timer_over.set)
    timer.daemon = True
    timer.start()
    while not timer_over.is_set() and not all(e.is_set() for e in done.values()):
        timer_over.wait(0.02)
    timer.cancel()
    late = []
    with lock:
        for name in channels:
            if not done[name].is_set() and name not in out.channels:
                out.degraded_channels[name] = "timeout"
                late.append(name)
    for name in late:
        spark.sparkContext.cancelJobGroup(groups[name])
    return out
