"""Processors that keep state by key.

Rows of a key may come in any order within the watermark's delay. An InOrder processor lets them wait in a list and takes
them, ordered by event time, when the watermark has passed them: what it says of a row can't be changed by a later one, and
equals what the batch operator says of the whole table. State that says no more than no state at all is removed.

Each call from a processor to its state is a message to another process. A group is therefore not one key but a bucket of
them: its rows wait in one entry a batch, it has one timer, and its keys' state is read in one go.
"""

from __future__ import annotations

import json
from collections.abc import Generator, Iterable, Iterator

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MICROS = 1_000_000


#: From how many keys on a bucket's state is read as a whole.
READ_WHOLE = 8


class InOrder(StatefulProcessor):
    """Input columns: at (event time in microseconds), turn, seq, those of OWN and of FIELDS. Rows of equal times go by turn, then by seq.

    A group may hold many keys, told apart by the columns OWN. The list holds what came within the watermark's delay, never a
    key's history. One timer stands at the earliest row or time that the group waits for.
    """

    OWN: tuple[str, ...] = ("user_id", "filename")
    FIELDS: tuple[str, ...] = ("what",)
    STATE: tuple[str, str] = ("", "")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows string")
        self.alarm = handle.getValueState("alarm", "at long")
        self.state = handle.getMapState(self.STATE[0], "own string", self.STATE[1])

    def take(self, own: list, before: tuple | None, due: list[list], mark: int) -> Generator[Row, None, tuple | None]:
        """Gives the output for a key's rows that are final, in order, and returns its state after them; mark is the watermark in microseconds."""
        raise NotImplementedError

    def until(self, held: tuple) -> int | None:
        """When a key in this state has something to say without a further row, in microseconds."""
        return None

    SELF_TIMED = False

    def wake(self, at: int | None, before: int | None) -> None:
        """One timer, at this time in microseconds; before is where it stands."""
        ms = None if at is None else at // 1000 + 1
        if ms == before:
            return
        if before is not None:
            self.handle.deleteTimer(before)
        if ms is None:
            self.alarm.clear()
        else:
            self.handle.registerTimer(ms)
            self.alarm.update((ms,))

    def held(self, keys: Iterable[str]) -> dict[str, tuple]:
        if self.SELF_TIMED or len(keys) >= READ_WHOLE:
            return {k[0]: tuple(v) for k, v in self.state.iterator()}
        return {k: tuple(self.state.getValue((k,))) for k in keys if self.state.containsKey((k,))}

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [[r["at"], r["turn"], r["seq"], json.dumps([r[n] for n in self.OWN]), *(r[n] for n in self.FIELDS)] for r in rows]
        self.waiting.appendValue((json.dumps(new),))
        first = min(r[0] for r in new)
        stands = self.alarm.get()[0] if self.alarm.exists() else None
        if stands is None or first // 1000 + 1 < stands:
            self.wake(first, stands)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        held = [r for pack in self.waiting.get() for r in json.loads(pack[0])] if self.waiting.exists() else []
        due, later = {}, []
        for r in held:
            if r[0] <= mark:
                due.setdefault(r[3], []).append(r)
            else:
                later.append(r)
        if due and later:
            self.waiting.put([(json.dumps(later),)])
        elif due:
            self.waiting.clear()
        states = self.held(due)
        calm = [] if self.SELF_TIMED else None
        for own in {**due, **states} if self.SELF_TIMED else due:
            before = states.get(own)
            rows = sorted(due.get(own, ()), key=lambda r: r[:3])
            after = yield from self.take(json.loads(own), before, [[*r[:3], *r[4:]] for r in rows], mark)
            if after is None and before is not None:
                self.state.removeKey((own,))
            elif after != before:
                self.state.updateValue((own,), after)
            if calm is not None and after is not None:
                calm.append(self.until(after))
        times = [r[0] for r in later] + (calm or [])
        fired = expiredTimerInfo.getExpiryTimeInMs()
        stands = self.alarm.get()[0] if self.alarm.exists() else None
        self.wake(min(times) if times else None, None if stands == fired and times else stands if stands != fired else None)
        if not times:
            self.alarm.clear()

    def close(self) -> None:
        pass


class Admission(InOrder):
    """State of a file that is there: its status. A file that is not has none, as an upload sets the status anew."""

    STATE = ("file", "status string")

    def take(self, own: list, before: tuple | None, due: list[list], mark: int) -> Generator[Row, None, tuple | None]:
        now = before and before[0]
        for _, _, seq, kind in due:
            if kind == "convert":
                yield Row(event_id=seq, code=404 if now is None else 409 if now == "processing" else 200)
                now = now and "processing"
            elif kind in ("upload", "delete"):
                now = "pending" if kind == "upload" else None
            elif kind in ("done", "failed"):
                now = now and kind
        return now and (now,)


class Transitions(InOrder):
    """State of a file: there only while it is in process."""

    STATE = ("running", "running boolean")

    def take(self, own: list, before: tuple | None, due: list[list], mark: int) -> Generator[Row, None, tuple | None]:
        running = before is not None
        for _, _, seq, now in due:
            if running and now in ("done", "failed"):
                yield Row(user_id=own[0], filename=own[1], seq=seq, status=now)
            running = now == "processing"
        return (True,) if running else None


class Timeouts(InOrder):
    """State of a file in process: since when, and by which row. The group's timer minds where its time runs out."""

    STATE = ("since", "seq long, at long")
    SELF_TIMED = True

    def __init__(self, limit_s: int) -> None:
        self.limit = limit_s * MICROS

    def until(self, held: tuple) -> int | None:
        return held[1] + self.limit

    def take(self, own: list, before: tuple | None, due: list[list], mark: int) -> Generator[Row, None, tuple | None]:
        since = before
        for at, _, seq, now in due:
            if since and at - since[1] > self.limit:  # exactly the limit is still in time
                yield Row(user_id=own[0], filename=own[1], seq=since[0])
            since = (seq, at) if now == "processing" else None
        if since and mark - since[1] > self.limit:
            yield Row(user_id=own[0], filename=own[1], seq=since[0])
            since = None
        return since


class Grants(InOrder):
    """State of a subject: the latest expiry of the grants so far by scope, as JSON. Grants have turn 0, so they hold for uses of their own time."""

    OWN, FIELDS = ("subject",), ("scope", "until")
    STATE = ("until", "until string")

    def take(self, own: list, before: tuple | None, due: list[list], mark: int) -> Generator[Row, None, tuple | None]:
        held = {scope: until for scope, until in json.loads(before[0])} if before else {}
        for at, turn, seq, scope, until in due:
            if turn == 0:
                held[scope] = max(held.get(scope, until), until)
            else:
                outcome = "none" if not held else "wrong_scope" if scope not in held else "valid" if at < held[scope] else "expired"
                yield Row(event_id=seq, outcome=outcome)
        return (json.dumps(list(held.items())),) if held else None


class RateLimit(StatefulProcessor):
    """State of an endpoint and key: requests by window with the time of the last, as JSON, for a time. Each request is answered in the batch that brings it."""

    def __init__(self, keep_s: int) -> None:
        self.keep_ms = keep_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("windows", "own string", "counts string", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now, ruled = timerValues.getCurrentProcessingTimeInMs(), {}
        for r in rows:
            if r["max_requests"] is None:
                yield Row(event_id=r["event_id"], code=200)
            else:
                ruled.setdefault(json.dumps([r["endpoint"], r["key"]]), []).append((r["at"], r["event_id"], r["max_requests"], r["window_s"]))
        if len(ruled) >= READ_WHOLE:
            held = {k[0]: v[0] for k, v in self.state.iterator() if k[0] in ruled}
        else:
            held = {own: self.state.getValue((own,))[0] for own in ruled if self.state.containsKey((own,))}
        for own, batch in ruled.items():
            counts = {slot: (n, last) for slot, n, last in json.loads(held.get(own, "[]")) if now - last < self.keep_ms}
            for at, event_id, most, window_s in sorted(batch):
                slot = at // (window_s * MICROS)
                n = counts.get(slot, (0, 0))[0] + 1
                counts[slot] = (n, now)
                yield Row(event_id=event_id, code=429 if n > most else 200)
            self.state.updateValue((own,), (json.dumps([(slot, n, last) for slot, (n, last) in counts.items()]),))

    def close(self) -> None:
        pass


class Pages(StatefulProcessor):
    """State of a document: its pages as they were converted last. Gives all pages of each document that a batch touches.

    Of several attempts of one batch at a page a failed one counts, else the one with the smallest text; those of a later
    batch replace them.
    """

    def __init__(self, keys: tuple[str, ...], forget_s: int | None) -> None:
        self.keys, self.forget_ms = keys, forget_s and forget_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pages = handle.getMapState("pages", "known boolean, page int", "text string, elapsed_s double, ok boolean, error string", self.forget_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = {}
        for r in rows:
            place, value = (r["page"] is not None, r["page"] or 0), (r["text"], r["elapsed_s"], r["ok"], r["error"])
            rank = (value[2], value[0] or "", value[3] or "")
            if place not in new or rank < new[place][0]:
                new[place] = (rank, value)
        for place, (_, value) in new.items():
            self.pages.updateValue(place, value)
        own = dict(zip(self.keys, key, strict=True))
        for (known, page), (text, elapsed_s, ok, error) in self.pages.iterator():
            yield Row(**own, page=page if known else None, text=text, elapsed_s=elapsed_s, ok=ok, error=error)

    def close(self) -> None:
        pass
