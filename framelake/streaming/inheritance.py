"""Places inherited from donors as a stream: late donors revise what an heir has been told.

Rows are dealt by time buckets as in the as-of join, donors to the buckets next to theirs too. A bucket's state holds its
donors and its heirs with what each was last told; a batch's rows are added and only heirs whose donor has changed are
told again, with a version that grows. When the watermark has passed a bucket and its neighbours, a timer drops its state.
After all rows have come, latest() gives what the batch operator gives over the same rows, whatever their order and
however often the stream was started anew from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from framelake.operators.asof import WINDOW_S

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TOLD = "id long, donor_id long, delta_s double, version long"
_DONOR, _HEIR = "id long, at long, origin string", "id long, at long, origin string, donor_id long, delta long"


def nearest(donors: pd.DataFrame, heirs: pd.DataFrame, window_us: int) -> tuple[np.ndarray, np.ndarray]:
    """(donor id or -1, microseconds) of each heir: the nearest donor of another origin within window_us; ties go to the
    earlier side, then to the latest before and the earliest after."""
    d = donors.sort_values(["at", "id"], kind="stable")
    at, ids, origin = d["at"].to_numpy(np.int64), d["id"].to_numpy(np.int64), pd.factorize(d["origin"], use_na_sentinel=False)
    codes = {o if isinstance(o, str) else None: k for k, o in enumerate(origin[1])}
    kind, n = origin[0], len(d)
    new = np.flatnonzero(np.diff(kind, prepend=-1)) if n else np.zeros(0, np.int64)
    run = np.searchsorted(new, np.arange(n), side="right") - 1
    other_before = new[run] - 1  # the last of the run before, and the first of the run after
    other_after = np.append(new[1:], n)[run]
    own = np.array([codes.get(o if isinstance(o, str) else None, -1) for o in heirs["origin"]], np.int64)
    when = heirs["at"].to_numpy(np.int64)
    p, q = np.searchsorted(at, when, side="left") - 1, np.searchsorted(at, when, side="left")
    if n:
        p = np.where((p >= 0) & (kind[np.maximum(p, 0)] == own), other_before[np.maximum(p, 0)], p)
        q = np.where((q < n) & (kind[np.minimum(q, n - 1)] == own), other_after[np.minimum(q, n - 1)], q)
    far = window_us + 1
    back = np.where(p >= 0, when - at[np.maximum(p, 0)], far) if n else np.full(len(when), far)
    ahead = np.where(q < n, at[np.minimum(q, n - 1)] - when, far) if n else np.full(len(when), far)
    first = back <= ahead
    delta = np.where(first, back, ahead)
    pick = np.where(first, p, q)
    none = delta > window_us
    return np.where(none, -1, ids[np.clip(pick, 0, n - 1)] if n else -1), np.where(none, 0, delta)


class Buckets(StatefulProcessor):
    def __init__(self, window_us: int):
        self.window_us = window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.donors, self.heirs = handle.getListState("donors", _DONOR), handle.getListState("heirs", _HEIR)
        self.version = handle.getValueState("version", "version long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        bucket = int(key[0])
        version = (self.version.get()[0] if self.version.exists() else 0) + 1
        self.version.update((version,))
        if not list(self.handle.listTimers()):
            self.handle.registerTimer((bucket + 3) * self.window_us // 1000)
        text = lambda o: o if isinstance(o, str) else None
        fresh = [(int(i), int(t), text(o)) for i, t, o in new.loc[new["has_gps"], ["id", "at", "origin"]].itertuples(index=False)]
        if fresh:
            self.donors.appendList(fresh)
        donors = pd.DataFrame(list(self.donors.get()), columns=["id", "at", "origin"])
        known = [tuple(h) for h in self.heirs.get()]
        known += [(int(i), int(t), text(o), None, None) for i, t, o in new.loc[~new["has_gps"], ["id", "at", "origin"]].itertuples(index=False)]
        if not known:
            return
        heirs = pd.DataFrame(known, columns=["id", "at", "origin", "donor_id", "delta"])
        donor, delta = nearest(donors, heirs, self.window_us)
        before = np.array([-1 if h[3] is None else h[3] for h in known], np.int64)
        changed = (donor >= 0) & (donor != before)
        self.heirs.put([(h[0], h[1], h[2], int(d) if d >= 0 else None, int(u)) for h, d, u in zip(known, donor, delta, strict=True)])
        if changed.any():
            yield pd.DataFrame({"id": heirs["id"].to_numpy(np.int64)[changed], "donor_id": donor[changed], "delta_s": delta[changed] / 1e6, "version": version})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.donors, self.heirs, self.version):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


def inherited(items: DataFrame, late: str, window_s: float = WINDOW_S) -> DataFrame:
    """id, donor_id, delta_s, version of a stream of items (id, at, origin, has_gps), each time an heir is told anew.

    Rows more than late behind the newest are dropped, as their bucket's state may be gone. The session needs the RocksDB
    state store.
    """
    window_us = int(window_s * 1e6)
    rows = items.where("at IS NOT NULL").withColumn("when", F.col("at").cast("timestamp")).withWatermark("when", late)
    own = F.floor(F.unix_micros("when") / window_us)
    buckets = F.when(F.col("has_gps"), F.array(own - 1, own, own + 1)).otherwise(F.array(own))
    dealt = rows.select("id", F.unix_micros("when").alias("at"), F.col("origin").cast("string").alias("origin"), "has_gps", "when", F.explode(buckets).alias("bucket"))
    return dealt.groupBy("bucket").transformWithStateInPandas(statefulProcessor=Buckets(window_us), outputStructType=TOLD, outputMode="Update", timeMode="EventTime")


def latest(told: DataFrame) -> DataFrame:
    """id, donor_id, delta_s: what each heir was told last."""
    return told.groupBy("id").agg(F.max_by(F.struct("donor_id", "delta_s"), "version").alias("x")).select("id", "x.*")
