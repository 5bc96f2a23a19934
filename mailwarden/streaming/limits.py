"""ST5, a hit limiter with windows that open at a key's first hit after the last window's end.

Which hits open windows depends on all hits before, so a plain fold has all of a key's hits in one task. Here time is
cut into blocks. A block's hits tell, for every window that may be open at its start, which one is open at its end: a
step function, found without knowing what came before. The functions of a key's blocks, small against its hits, are then composed in order of
time, and every block folds its own hits from the window it really begins with. So a busy key goes to as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

WINDOW_SECONDS, MOST_HITS = 60, 5
OUT = "key string, id string, time timestamp, limited boolean"
NEVER = -(1 << 62)


def block_function(times: np.ndarray, begin: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(limits, opened, hits) of a block that begins at `begin`, for its sorted hits.

    If the window open at its start ends before limits[i], and not before limits[i - 1], the window that is open at the block's end was
    opened at opened[i] and has had hits[i] hits. A window that ends at no hit of the block or later, limits[-1], stays open throughout.
    """
    n = len(times)
    after = np.searchsorted(times, times + width, side="right")  # the hit that opens the next window
    at = np.arange(min(int(np.searchsorted(times, begin + width)), n - 1) + 1)  # a window from before ends before begin + width
    while (on := after[at] < n).any():
        at[on] = after[at[on]]
    edge = np.flatnonzero(np.append(at[1:] != at[:-1], True))
    return times[edge], times[at[edge]], n - at[edge]


def through_block(opened: int, hits: int, n: int, width: int, limits: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[int, int]:
    """The window open after a block of n hits, from the one open before it."""
    i = int(np.searchsorted(limits, opened + width, side="right"))
    return (opened, hits + n) if i == len(limits) else (int(starts[i]), int(counts[i]))


def fold_hits(times: np.ndarray, opened: int, hits: int, width: int, most: int) -> tuple[np.ndarray, int, int]:
    """Which of the sorted hits are over the limit, and the window open after them."""
    n, at = len(times), int(np.searchsorted(times, opened + width, side="right"))
    limited = np.arange(hits + 1, hits + n + 1) > most
    hits += at
    while at < n:
        opened, end = int(times[at]), int(np.searchsorted(times, times[at] + width, side="right"))
        limited[at:end] = np.arange(1, end - at + 1) > most
        hits, at = end - at, end
    return limited, opened, hits


def _runs(pdf: pd.DataFrame, by: list[str]) -> Iterator[tuple[tuple, int, int]]:
    """Runs of equal values in sorted rows: the values, begin and end."""
    new = np.ones(len(pdf), dtype=bool)
    if len(pdf) > 1:
        new[1:] = np.any([(pdf[c].to_numpy()[1:] != pdf[c].to_numpy()[:-1]) for c in by], axis=0)
    edges = np.append(np.flatnonzero(new), len(pdf))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield tuple(pdf[c].iloc[a] for c in by), int(a), int(b)


def limit_hits(df: DataFrame, key: str = "client_ip", time: str = "timestamp", id_col: str = "id", seconds: float = WINDOW_SECONDS, most: int = MOST_HITS, block_windows: int = 128) -> DataFrame:
    """ST5 in batch: key, id, time, limited for each row, hits of one time in order of their ids.

    Blocks are block_windows windows long. What one task gets of a key is a block's hits, or its blocks' functions, which have
    no more steps than a block has hits in its first window. Rows without a key are hits of one key of their own; rows without a time aren't limited and count for nothing.
    """
    width = round(seconds * 1e6)
    size = width * block_windows
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(id_col).cast("string").alias("id"), F.col(time).cast("timestamp").alias("time"))
    known = F.concat(F.when(F.col("key").isNull(), "n").otherwise("k"), F.coalesce("key", F.lit("")))
    hits = rows.where("time IS NOT NULL").select(known.alias("key"), "id", "time", F.unix_micros("time").alias("at"))
    hits = hits.withColumn("block", F.floor(F.col("at") / size))

    def functions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []

        def made() -> pd.DataFrame:
            times = np.concatenate(held)
            limits, opened, counts = block_function(times, now[1] * size, width)
            return pd.DataFrame({"key": [now[0]], "block": [now[1]], "n": [len(times)], "limits": [limits], "opened": [opened], "counts": [counts]})

        for pdf in batches:
            out = []
            for name, a, b in _runs(pdf, ["key", "block"]):
                if name != now:
                    if held:
                        out.append(made())
                    now, held = name, []
                held.append(pdf["at"].to_numpy()[a:b])
            if out:
                yield pd.concat(out)
        if held:
            yield made()

    def composed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, opened, count = None, NEVER, 0
        for pdf in batches:
            before = []
            for k, n, limits, starts, counts in zip(pdf["key"], pdf["n"], pdf["limits"], pdf["opened"], pdf["counts"], strict=True):
                if k != name:
                    name, opened, count = k, NEVER, 0
                before.append((opened, count))
                opened, count = through_block(opened, count, n, width, limits, starts, counts)
            yield pdf[["key", "block"]].assign(opened=[o for o, _ in before], count=[c for _, c in before])

    def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, opened, count = None, NEVER, 0
        for pdf in batches:
            limited = np.zeros(len(pdf), dtype=bool)
            first = pdf["opened"].notna().to_numpy()
            for name, a, b in _runs(pdf, ["key", "block"]):
                if name != now:  # a block's first row is its window
                    now, opened, count = name, int(pdf["opened"].iloc[a]), int(pdf["count"].iloc[a])
                    a += 1
                limited[a:b], opened, count = fold_hits(pdf["at"].to_numpy()[a:b], opened, count, width, most)
            yield pdf.assign(limited=limited)[~first][["key", "id", "time", "limited"]]

    dealt = hits.select("key", "block", "at").repartition("key", "block").sortWithinPartitions("key", "block", "at")
    steps = dealt.mapInPandas(functions, "key string, block long, n long, limits array<long>, opened array<long>, counts array<long>")
    windows = steps.repartition("key").sortWithinPartitions("key", "block").mapInPandas(composed, "key string, block long, opened long, count long")
    both = hits.withColumns({"opened": F.lit(None).cast("long"), "count": F.lit(None).cast("long")}).unionByName(windows.withColumn("at", F.lit(NEVER)), allowMissingColumns=True)
    found = both.repartition("key", "block").sortWithinPartitions("key", "block", "at", "id").mapInPandas(folded, OUT)
    named = found.select(F.when(F.col("key").startswith("k"), F.expr("substring(key, 2)")).alias("key"), "id", "time", "limited")
    return named.unionByName(rows.where("time IS NULL").withColumn("limited", F.lit(False)))


class HitLimiter(StatefulProcessor):
    """A key's window on a stream. Hits are judged in the batch they come in, in order of time within it.

    A batch's hits of a busy key come in several frames in no order; they are laid down in the state by slots of a window's
    length, and read again slot by slot, so that a slot is the most that is held. A timer clears the window once the watermark has passed its end.
    """

    def __init__(self, seconds: float, most: int):
        self.width, self.most = round(seconds * 1e6), most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "opened long, hits long")
        self.slots = handle.getMapState("slots", "slot long", "times array<long>, ids array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self.window.get()
        opened, hits = (int(state[0]), int(state[1])) if state is not None else (NEVER, 0)
        first, second = next(rows), next(rows, None)
        parts = iter([(first["at"].to_numpy(), first["id"].to_numpy())]) if second is None else self._slots(chain([first, second], rows))
        for times, ids in parts:
            order = np.lexsort((ids.astype(str), times))
            times, ids = times[order], ids[order]
            limited, opened, hits = fold_hits(times, opened, hits, self.width, self.most)
            yield pd.DataFrame({"key": [key[0]] * len(times), "id": ids, "at": times, "limited": limited})
        self.window.update((opened, hits))
        self.handle.registerTimer((opened + self.width) // 1000 + 1000)

    def _slots(self, frames: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        seen = set()
        for pdf in frames:
            for slot, part in pdf.groupby(pdf["at"] // self.width):
                slot = int(slot)
                times, ids = self.slots.getValue((slot,)) if slot in seen else ([], [])
                self.slots.updateValue((slot,), ([*map(int, times), *part["at"].tolist()], [*ids, *part["id"].tolist()]))
                seen.add(slot)
        for slot in sorted(seen):
            times, ids = self.slots.getValue((slot,))
            self.slots.removeKey((slot,))
            yield np.array(times, dtype=np.int64), np.array(ids, dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.window.get()
        if state is not None and (int(state[0]) + self.width) // 1000 < timerValues.getCurrentWatermarkInMs():
            self.window.clear()
        return iter(())

    def close(self) -> None:
        pass


def state_store(spark: SparkSession) -> None:
    """The store that transformWithState needs, for queries started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def limit_hits_stream(stream: DataFrame, key: str = "client_ip", time: str = "timestamp", id_col: str = "id", seconds: float = WINDOW_SECONDS, most: int = MOST_HITS, late: str = "1 minute") -> DataFrame:
    """ST5 on a stream: key, id, time, limited. The state of a key is its window; it goes when the watermark has passed the window's end. Rows without a time aren't judged."""
    state_store(stream.sparkSession)
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(id_col).cast("string").alias("id"), F.col(time).cast("timestamp").alias("time")).where("time IS NOT NULL")
    rows = rows.withColumn("at", F.unix_micros("time")).withWatermark("time", late)
    found = rows.groupBy("key").transformWithStateInPandas(HitLimiter(seconds, most), "key string, id string, at long, limited boolean", "append", "eventTime")
    return found.select("key", "id", F.timestamp_micros("at").alias("time"), "limited")
