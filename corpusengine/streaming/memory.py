"""Conversation memory carried from turn to turn as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MEMORY_OUT = "conversation_id BIGINT, turn BIGINT, sequence_id BIGINT, stm STRING, memory STRING"
_COLUMNS = ["conversation_id", "turn", "sequence_id", "stm", "memory"]
#: Rows of one frame that the processor gives out.
OUT_ROWS = 1000


def _said(query, answer) -> str:
    return f"User: {query}\nAssistant: {None if pd.isna(answer) else answer}"


class ConversationMemory(StatefulProcessor):
    """State per conversation: number of turns, the last `k` turns, the capped memory, turns that wait.

    For each turn it emits the sequence number and the memories as they stand after it.
    Turns are taken in frame by frame and wait in a map of the state store where more than one frame has to be
    put in order, so a hot conversation is never whole in one task's memory, only the numbers of its waiting turns.
    """

    def __init__(self, k: int = 3, cap: int = 1000, timed: bool = False, idle_ms: int | None = None):
        self.k, self.cap, self.timed, self.idle_ms = k, cap, timed, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "n BIGINT")
        self.recent = handle.getListState("recent", "said STRING")
        self.memory = handle.getValueState("memory", "text STRING")
        self.waiting = handle.getMapState("waiting", "first BIGINT, second BIGINT", "turn BIGINT, said STRING")
        self.latest = handle.getValueState("latest", "at BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        if self.timed:
            for frame in rows:
                for at, turn, query, answer in zip(frame["event_ms"], frame["turn"], frame["query"], frame["answer"]):
                    self.waiting.updateValue((int(at), int(turn)), (int(turn), _said(query, answer)))
                self.handle.registerTimer(int(frame["event_ms"].max()))
            return
        frame, following = next(rows), next(rows, None)
        if following is None:
            frame = frame.sort_values("turn", kind="stable")
            said = map(_said, frame["query"], frame["answer"])
            yield from self._advance(key, zip(map(int, frame["turn"]), said))
            return
        n = 0
        while frame is not None:
            for turn, query, answer in zip(frame["turn"], frame["query"], frame["answer"]):
                self.waiting.updateValue((int(turn), n), (int(turn), _said(query, answer)))
                n += 1
            frame, following = following, next(rows, None)
        yield from self._advance(key, self._taken(sorted(self.waiting.keys())))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Give out the turns up to the watermark; drop the state of a conversation that has been idle."""
        now = timerValues.getCurrentWatermarkInMs()
        due = sorted(at for at in self.waiting.keys() if at[0] <= now)
        if due:
            yield from self._advance(key, self._taken(due))
            latest = max(due[-1][0], self.latest.get()[0] if self.latest.exists() else due[-1][0])
            self.latest.update((latest,))
            if self.idle_ms is not None:
                self.handle.registerTimer(latest + self.idle_ms)
        elif self.idle_ms is not None and self.latest.exists() and self.latest.get()[0] + self.idle_ms <= now and not self.waiting.exists():
            for state in (self.count, self.recent, self.memory, self.latest):
                state.clear()

    def _taken(self, places: list[tuple[int, int]]) -> Iterator[tuple[int, str]]:
        for place in places:
            yield self.waiting.getValue(place)
            self.waiting.removeKey(place)

    def _advance(self, key, turns: Iterator[tuple[int, str]]) -> Iterator[pd.DataFrame]:
        n = self.count.get()[0] if self.count.exists() else 0
        recent = [r[0] for r in self.recent.get()] if self.recent.exists() else []
        memory = self.memory.get()[0] if self.memory.exists() else None
        out = []
        for turn, said in turns:
            n += 1
            recent = (recent + [said])[-self.k :]
            memory = (said if memory is None else f"{memory}\n{said}")[-self.cap :]
            out.append((key[0], turn, n, "\n".join(recent), memory))
            if len(out) == OUT_ROWS:
                yield pd.DataFrame(out, columns=_COLUMNS)
                out = []
        self.count.update((n,))
        self.recent.put([(s,) for s in recent])
        self.memory.update((memory,))
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS)

    def close(self) -> None:
        pass


def memory_stream(
    turns: DataFrame, k: int = 3, cap: int = 1000, event_time: str | None = None, delay: str = "10 minutes", idle_ms: int | None = None
) -> DataFrame:
    """Streaming turns (conversation_id, turn, query, answer) with their memories.

    Without `event_time`, a batch's turns come in the order of `turn`, after those of the batches before.  With
    it, a turn waits until the watermark, `delay` behind the latest time seen, has passed it; turns then come in the order
    of `(event_time, turn)` however they arrived, the same turn sent twice counts once, turns without a time are
    left out, and those behind the watermark are dropped by Spark.  A conversation without turns for `idle_ms` of
    event time loses its state and would begin anew.

    Needs the RocksDB state store provider.
    """
    timed = event_time is not None
    if timed:
        # Names of columns that reach the processor must not begin with an underscore.
        turns = turns.where(F.col(event_time).isNotNull()).withWatermark(event_time, delay).select(
            "conversation_id", "turn", "query", "answer", event_time, F.unix_millis(event_time).alias("event_ms")
        )
    return turns.groupBy("conversation_id").transformWithStateInPandas(
        statefulProcessor=ConversationMemory(k, cap, timed, idle_ms),
        outputStructType=MEMORY_OUT,
        outputMode="Append",
        timeMode="EventTime" if timed else "None",
    )
