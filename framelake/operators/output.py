"""Indexed output: which writes of a session are taken, before their samples are assembled into a file.

A session writes video frames and the audio under them, each in order from 0, and finishes when both are level. A
refused write leaves the session as it was; an encoder that fails, or gives too many samples at once, ends it. The
fold goes over numbers in order of writing; sessions run in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

from framelake.limits import DEFAULT, Limits


class Session(NamedTuple):
    """Writes taken of each kind, and why the session ended, if it did."""

    video: int = 0
    audio: int = 0
    ended: str | None = None


Answer = tuple[Session, str | None, str | None]


def interval(frame: int, rate: int, num: int, den: int) -> tuple[int, int]:
    """Audio samples under a frame, of num/den frames a second."""
    return frame * rate * den // num, (frame + 1) * rate * den // num


def answer(s: Session, kind: str, index: int | None, span: tuple | None, samples: int | None, expected: tuple, most: int) -> Answer:
    """The session after a write, and the kind and message of its error. ``samples``: what the encoder gave; null if it failed."""
    if s.ended is not None:
        return s, "InvalidState", f"the session has ended: {s.ended}"
    if kind == "finish":
        if s.video != s.audio:
            return s, "InvalidState", f"{s.video} frames but {s.audio} intervals of audio"
        return s._replace(ended="it was finished"), None, None
    due = getattr(s, kind)
    if index != due:
        return s, "InvalidInput", f"{kind} {index} where {due} is due"
    if kind == "audio" and span != expected:
        return s, "InvalidInput", "the audio does not lie under its frame"
    if samples is None:
        return s._replace(ended="the encoder failed"), "Codec", "the encoder failed"
    if samples > most:
        return s._replace(ended="an encoder gave too many samples"), "ResourceLimit", "an encoder gave too many samples"
    return s._replace(**{kind: due + 1}), None, None


ANSWERS = "session_id long, write_no long, kind string, taken boolean, error_kind string, message string"
COLUMNS = ["session_id", "write_no", "kind", "index", "start", "end", "samples"]


def write_sessions(writes: DataFrame, rate: int, num: int, den: int = 1, limits: Limits = DEFAULT) -> DataFrame:
    """Answers to writes (session_id, write_no, kind: video, audio or finish; index; start and end of audio; samples)."""
    names = [c.split()[0] for c in ANSWERS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, Session()
        for batch in batches:
            rows = []
            for session, n, kind, *numbers in batch.itertuples(index=False, name=None):
                index, start, end, samples = (None if pd.isna(v) else int(v) for v in numbers)
                if session != current:
                    current, state = session, Session()
                state, error, why = answer(state, kind, index, (start, end), samples, interval(index or 0, rate, num, den), limits.max_encode_batch)
                rows.append((session, n, kind, error is None, error, why))
            yield pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype=object) for i, n in enumerate(names)})

    return writes.select(*COLUMNS).repartition("session_id").sortWithinPartitions("session_id", "write_no").mapInPandas(run, ANSWERS)


def taken_samples(samples: DataFrame, answers: DataFrame) -> DataFrame:
    """The samples (session_id, write_no, ...) of writes that were taken, of sessions that were finished: what a file is built from."""
    done = answers.where("kind = 'finish' AND taken").select("session_id")
    taken = answers.where("taken").select("session_id", "write_no")
    return samples.join(taken, ["session_id", "write_no"]).join(done, "session_id", "left_semi")
