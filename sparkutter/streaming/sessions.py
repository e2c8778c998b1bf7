"""Utterances from live captions: words arrive one by one and close an utterance when silence follows.

The silence is measured from the end of the word before, so event-time session windows (which measure from its
start) give other results; the state of an open utterance is kept for each file instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "file string, utterance long, n long, start double, end double, text string"
STATE = "utterance long, n long, start double, end double, text string"


def live_utterances(words: DataFrame, most_gap: float = 0.8, patience_ms: int = 60_000) -> DataFrame:
    """Closed utterances of a stream of words (file, start, end, text), each once.

    Words of a file must arrive in order across micro-batches; within one they are sorted. An utterance also
    closes when nothing has come for ``patience_ms``.
    """

    def row(file: str, s: tuple) -> dict:
        return dict(zip(("file", "utterance", "n", "start", "end", "text"), (file, *s), strict=True))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        closed = []
        open_ = state.get if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([row(key[0], open_)])
            return
        batch = pd.concat(list(frames)).sort_values(["start", "end"], kind="stable")
        for start, end, text in zip(batch["start"], batch["end"], batch["text"], strict=True):
            if not str(text).strip() or end < start:
                continue
            if open_ is not None and start - open_[3] > most_gap:
                closed.append(row(key[0], open_))
                open_ = (open_[0] + 1, 0, start, end, "")
            if open_ is None:
                open_ = (0, 0, start, end, "")
            open_ = (open_[0], open_[1] + 1, open_[2], end, f"{open_[4]} {str(text).strip()}".strip())
        if open_ is not None:
            state.update(open_)
            state.setTimeoutDuration(patience_ms)
        yield pd.DataFrame(closed, columns=["file", "utterance", "n", "start", "end", "text"])

    return words.groupBy("file").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
