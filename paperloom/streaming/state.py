"""Keyed state: one running request per notebook, and token streams cut into pieces."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FLUSH_CHARS = 100
OPEN_MARK, CLOSE_MARK = "<think>", "</think>"


def _timeout(seconds: int | None) -> str:
    return GroupStateTimeout.NoTimeout if seconds is None else GroupStateTimeout.ProcessingTimeTimeout


def admit_requests(events: DataFrame, give_up_after: int | None = None) -> DataFrame:
    """Admits one request per task at a time.

    Events: task_id, seq, kind ('request', 'cancel' or 'done'), query_id. A request for
    a busy task waits; a cancel drops the running request; the end of one starts the
    next. Output: task_id, query_id, action ('start', 'wait', 'cancelled', 'done',
    'ignored' or 'expired'), in the order of seq inside a micro-batch. A task without an event
    for ``give_up_after`` seconds loses its running and waiting requests, so no state stays for ever.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        running, waiting = (lambda r, w: (r, json.loads(w)))(*state.get) if state.exists else (None, [])
        if state.hasTimedOut:
            state.remove()
            lost = [q for q in (running, *waiting) if q is not None]
            yield pd.DataFrame({"task_id": key[0], "query_id": lost, "action": "expired"})
            return
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for kind, query_id in zip(rows["kind"], rows["query_id"]):
            if kind == "request":
                if running is None:
                    running = query_id
                    out.append((query_id, "start"))
                else:
                    waiting.append(query_id)
                    out.append((query_id, "wait"))
            elif running is None:
                out.append((query_id, "ignored"))
            else:
                out.append((running, "cancelled" if kind == "cancel" else "done"))
                running = waiting.pop(0) if waiting else None
                if running is not None:
                    out.append((running, "start"))
        if running is None and not waiting:
            state.remove()
        else:
            state.update((running, json.dumps(waiting)))
            if give_up_after is not None:
                state.setTimeoutDuration(give_up_after * 1000)
        if out:
            yield pd.DataFrame({"task_id": key[0], "query_id": [q for q, _ in out], "action": [a for _, a in out]})

    return events.groupBy("task_id").applyInPandasWithState(
        step,
        "task_id string, query_id string, action string",
        "running string, waiting string",
        "append",
        _timeout(give_up_after),
    )


def flush_tokens(tokens: DataFrame, give_up_after: int | None = None) -> DataFrame:
    """Token streams in pieces: visible and hidden text, sent when either passes 100 characters or the stream ends.

    Tokens: stream_id, seq, token; a null token ends the stream, and so do ``give_up_after``
    seconds without a token.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        inside, content, think = state.get if state.exists else (False, "", "")
        if state.hasTimedOut:
            state.remove()
            if content or think:
                yield pd.DataFrame({"stream_id": key[0], "content": [content], "think": [think]})
            return
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        ended = False
        for token in rows["token"]:
            if token is None or token is pd.NA or token != token:
                ended = True
                break
            if OPEN_MARK in token:
                inside = True
                continue
            if CLOSE_MARK in token:
                inside = False
                continue
            if inside:
                think += token
            else:
                content += token
            if len(content) > FLUSH_CHARS or len(think) > FLUSH_CHARS:
                out.append((content, think))
                content, think = "", ""
        if ended:
            if content or think:
                out.append((content, think))
            if state.exists:
                state.remove()
        else:
            state.update((bool(inside), content, think))
            if give_up_after is not None:
                state.setTimeoutDuration(give_up_after * 1000)
        if out:
            yield pd.DataFrame({"stream_id": key[0], "content": [c for c, _ in out], "think": [t for _, t in out]})

    return tokens.groupBy("stream_id").applyInPandasWithState(
        step,
        "stream_id string, content string, think string",
        "inside boolean, content string, think string",
        "append",
        _timeout(give_up_after),
    )
