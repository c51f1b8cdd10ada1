"""Requests to chat models: their assembly, repeated calls with deadlines, and stalled streams. Transport is injected."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterable, Iterator

# Least room for a JSON reply, status codes worth another try, and waits in seconds.
JSON_TOKENS = 8192
TRANSIENT = {408, 409, 425, 500, 502, 503, 504}
LIMITED = 429
MOST_ATTEMPTS, DEADLINE_S, SILENCE_S = 4, 120.0, 45.0
BASE_S, LIMITED_BASE_S, MOST_S = 5.0, 30.0, 180.0


class Deadline(TimeoutError):
    pass


class Refused(RuntimeError):
    """A reply with an error status."""

    def __init__(self, status: int):
        super().__init__(f"status {status}")
        self.status = status


def request(messages: list[dict], system: str, tools: list[dict] | None = None, *, json_reply: bool = False, max_tokens: int = 4096, stream: bool = True) -> dict:
    """A chat request; one for JSON is not streamed and has room for its reply."""
    made = {"messages": [{"role": "system", "content": system}, *messages], "max_tokens": max(JSON_TOKENS, max_tokens) if json_reply else max_tokens, "stream": stream and not json_reply}
    if json_reply:
        made["response_format"] = {"type": "json_object"}
    return made | ({"tools": tools} if tools else {})


def wait(attempt: int, base: float = BASE_S, most: float = MOST_S, jitter: float = 0.5, rng: random.Random | None = None) -> float:
    """Seconds before the next attempt: doubling up to ``most``, and a random share of it on top."""
    delay = most if base <= 0 or attempt > 62 else min(base * 2 ** max(0, attempt - 1), most)
    return delay + (rng or random).uniform(0, jitter * delay)


def call(send: Callable[[dict, float], object], made: dict, *, refresh: Callable[[], None] | None = None, attempts: int = MOST_ATTEMPTS, deadline_s: float = DEADLINE_S, clock=time.monotonic, sleep=time.sleep, rng=None):
    """send(request, seconds left) until it answers.

    Transient and limited statuses and broken connections are tried again, a 401 once after refresh; all else is raised. The deadline
    holds for all attempts together.
    """
    end, refreshed = clock() + deadline_s, False
    for attempt in range(1, attempts + 1):
        left = end - clock()
        if left <= 0:
            raise Deadline(f"no answer within {deadline_s} s")
        try:
            return send(made, left)
        except Refused as error:
            if error.status == 401 and refresh and not refreshed:
                refreshed = True
                refresh()
                continue
            if error.status not in TRANSIENT | {LIMITED} or attempt == attempts:
                raise
            pause = wait(attempt, LIMITED_BASE_S if error.status == LIMITED else BASE_S, rng=rng)
        except ConnectionError:
            if attempt == attempts:
                raise
            pause = wait(attempt, rng=rng)
        sleep(max(0.0, min(pause, end - clock())))
    raise Deadline("no attempt left")


def watched(events: Iterable, *, silence_s: float = SILENCE_S, deadline_s: float = DEADLINE_S) -> Iterator:
    """A stream's events; silence between two of them, or the whole stream past its deadline, is an error.

    The stream is read by a thread of its own, so that a read that never returns is noticed too.
    """
    import queue
    import threading

    box: queue.Queue = queue.Queue(maxsize=64)
    over = threading.Event()

    def put(item) -> bool:
        while not over.is_set():
            try:
                box.put(item, timeout=0.05)
                return True
            except queue.Full:
                continue
        return False

    def read() -> None:
        try:
            for event in events:
                if not put((event, None)):
                    return
            put((None, StopIteration()))
        except Exception as error:
            put((None, error))

    threading.Thread(target=read, daemon=True).start()
    end = time.monotonic() + deadline_s
    try:
        while True:
            left = min(silence_s, end - time.monotonic())
            if left <= 0:
                raise Deadline(f"stream longer than {deadline_s} s")
            try:
                event, error = box.get(timeout=left)
            except queue.Empty:
                raise Deadline("the stream is silent or past its deadline") from None
            if isinstance(error, StopIteration):
                return
            if error is not None:
                raise error
            yield event
    finally:
        over.set()


def tools_as_responses(tools: list[dict]) -> list[dict]:
    """Chat tools in the form of a responses request."""
    out = []
    for function in (tool.get("function") or {} for tool in tools):
        made = {"type": "function", "name": function.get("name"), "parameters": function.get("parameters") or {"type": "object", "properties": {}}}
        made |= {"description": function["description"]} if function.get("description") else {}
        out.append(made | ({"strict": bool(function["strict"])} if "strict" in function else {}))
    return out
