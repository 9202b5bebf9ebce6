"""The latest submission of each kind as a stateful stream: a map for each owner, closed by a timer.

What WIN5 does over a table, for rows as they arrive: of each owner and kind the submission
with the latest date counts, of equal dates the one that came later in order.  The state
of an owner is a map from kind to that submission's place, so it grows with the kinds, not
with the rows.  A row that takes over is handed on at once; once the watermark is
`idle` past an owner's last row, its winners are handed on as final and its state goes.
Rows behind the watermark are dropped by the stream; an owner that comes back begins anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "owner string, kind string, submission string, at long, ord long, status string"


def uses_rocksdb(spark: SparkSession) -> None:
    """The state store that maps and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class LatestPerKind(StatefulProcessor):
    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getMapState("best", "kind string", "submission string, at long, ord long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out, last = [], None
        for pdf in rows:
            last = max(x for x in (last, pdf["at"].max()) if x is not None)
            top = pdf.sort_values(["at", "ord"], kind="stable").drop_duplicates("kind", keep="last")
            for r in top.itertuples():
                now = self.best.getValue((r.kind,)) if self.best.containsKey((r.kind,)) else None
                if now is None or (now[1], now[2]) < (r.at, r.ord):
                    self.best.updateValue((r.kind,), (r.submission, int(r.at), int(r.ord)))
                    if now is None or now[0] != r.submission:
                        out.append((key[0], r.kind, r.submission, int(r.at), int(r.ord), "new" if now is None else "replaced"))
        if last is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(int(last) // 1000 + self.idle_ms)
        yield pd.DataFrame(out, columns=["owner", "kind", "submission", "at", "ord", "status"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = [(key[0], k[0], v[0], v[1], v[2], "final") for k, v in self.best.iterator()]
        self.best.clear()
        yield pd.DataFrame(sorted(out), columns=["owner", "kind", "submission", "at", "ord", "status"])

    def close(self) -> None:
        pass


def latest_per_kind(stream: DataFrame, owner: str, kind: str, submission: str, at: str, ord: str, idle: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """owner, kind, submission, at, ord, status (new, replaced, final) of a stream of rows; see uses_rocksdb.

    Rows without owner, kind or time count for nothing.
    """
    idle_ms = int(stream.sparkSession.sql(f"SELECT cast(unix_seconds(timestamp_seconds(0) + INTERVAL {idle}) AS bigint) * 1000 AS ms").first()["ms"])
    rows = stream.select(F.col(owner).cast("string").alias("owner"), F.col(kind).cast("string").alias("kind"), F.col(submission).cast("string").alias("submission"), F.col(at).cast("timestamp").alias("at"), F.col(ord).cast("long").alias("ord"))
    rows = rows.where("owner is not null and kind is not null and at is not null").withWatermark("at", late)
    # times travel as microseconds, which no time zone touches; the watermark stays on the column of its own
    rows = rows.select("owner", "kind", "submission", F.unix_micros("at").alias("at"), F.coalesce("ord", F.lit(0)).alias("ord"), F.col("at").alias("event_time"))
    out = rows.groupBy("owner").transformWithStateInPandas(LatestPerKind(idle_ms), OUT, "append", "eventTime")
    return out.withColumn("at", F.timestamp_micros("at"))
