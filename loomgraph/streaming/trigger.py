"""Promotion by threshold over a stream, by state that is held key by key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

THRESHOLD = 3
#: The state store that the stateful operators need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Meetings(StatefulProcessor):
    """For each app the files and sessions seen: a new one of either meets all of the other kind."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.files, self.sessions = (handle.getMapState(name, "name string", "seen boolean") for name in ("files", "sessions"))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: ANN401, N802, N803
        for batch in rows:
            for own, other, column in ((self.files, self.sessions, "file"), (self.sessions, self.files, "session_id")):
                for name in batch[column].dropna().unique():
                    if own.containsKey((name,)):
                        continue
                    own.updateValue((name,), (True,))
                    names = [k[0] for k in other.keys()]  # noqa: SIM118
                    for at in range(0, len(names), 10_000):
                        part = names[at : at + 10_000]
                        pair = {"file": name, "session_id": part} if column == "file" else {"file": part, "session_id": name}
                        yield pd.DataFrame(pair)[["file", "session_id"]]

    def close(self) -> None:
        pass


class _Threshold(StatefulProcessor):
    """For each project the distinct files by session, counted; the project goes out once, when a session has enough, and its files are forgotten."""

    def __init__(self, threshold: int) -> None:
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "session_id string, file string", "seen boolean")
        self.counts = handle.getMapState("counts", "session_id string", "n int")
        self.done = handle.getValueState("done", "done boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: ANN401, N802, N803
        done = self.done.exists()
        for batch in rows:
            if done:
                continue
            for session, file in batch[["session_id", "file"]].drop_duplicates().itertuples(index=False):
                if self.seen.containsKey((session, file)):
                    continue
                n = (self.counts.getValue((session,))[0] if self.counts.containsKey((session,)) else 0) + 1
                if n >= self.threshold:
                    done = True
                    self.done.update((True,))
                    self.seen.clear()
                    self.counts.clear()
                    yield pd.DataFrame({"project_id": [key[0]], "session_id": [session], "files": [n]})
                    break
                self.seen.updateValue((session, file), (True,))
                self.counts.updateValue((session,), (n,))

    def close(self) -> None:
        pass


def meetings(opened: DataFrame, focused: DataFrame) -> DataFrame:
    """(file, session_id) of each file of an app and each session that the app is active in, as soon as both are seen.

    opened (file, app) and focused (app, session_id) are streams. A pair goes out once for each app that brings it about.
    """
    both = opened.select("app", "file", F.lit(None).cast("string").alias("session_id")).unionByName(focused.where("session_id is not null").select("app", F.lit(None).cast("string").alias("file"), "session_id"))
    return both.groupBy("app").transformWithStateInPandas(_Meetings(), "file string, session_id string", "Append", "None")


def crossed(pairs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(project_id, session_id, files): each project of a stream of (project_id, file, session_id) once, when the first of its sessions has touched so many distinct files."""
    return pairs.select("project_id", "file", "session_id").groupBy("project_id").transformWithStateInPandas(_Threshold(threshold), "project_id string, session_id string, files int", "Append", "None")
