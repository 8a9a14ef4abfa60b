"""The meter's state file: key=value lines, replaced whole."""

from __future__ import annotations

import os
import time
import uuid

from symloom.operators.meter import COUNTERS

KEYS = [*COUNTERS, *[f"last_invoked_{c}" for c in COUNTERS], "last_updated_unix", "last_invoked_unix"]
_MOST = (1 << 64) - 1


def parse(text: str) -> dict[str, int]:
    """Known keys with whole numbers; anything else is passed over."""
    state = dict.fromkeys(KEYS, 0)
    for line in text.splitlines():
        key, eq, value = line.strip().partition("=")
        key, value = key.strip(), value.strip().removeprefix("+")
        if eq and not line.strip().startswith("#") and key in state and value.isascii() and value.isdigit() and int(value) <= _MOST:
            state[key] = int(value)
    return state


def read(folder: str) -> dict[str, int]:
    at = os.path.join(folder, "meter.txt")
    return parse(open(at).read()) if os.path.exists(at) else parse("")


def write(folder: str, state: dict[str, int]) -> None:
    os.makedirs(folder, exist_ok=True)
    staged = os.path.join(folder, f".meter.{uuid.uuid4().hex}")
    with open(staged, "w") as f:
        f.writelines(f"{k}={state[k]}\n" for k in KEYS)
    os.replace(staged, os.path.join(folder, "meter.txt"))


def record(state: dict[str, int], given: int, taken: int, now: int | None = None) -> dict[str, int]:
    more = {"input_tokens": given, "output_tokens": taken, "calls": 1}
    return state | {k: min(state[k] + n, _MOST) for k, n in more.items()} | {"last_updated_unix": int(time.time()) if now is None else now}


def snapshot(state: dict[str, int], now: int | None = None) -> dict[str, int]:
    return state | {f"last_invoked_{c}": state[c] for c in COUNTERS} | {"last_invoked_unix": int(time.time()) if now is None else now}


def reset(state: dict[str, int]) -> dict[str, int]:
    return state | dict.fromkeys([*COUNTERS, "last_updated_unix"], 0)


def difference(state: dict[str, int]) -> dict[str, int]:
    return {c: max(state[c] - state[f"last_invoked_{c}"], 0) for c in COUNTERS}


def since(state: dict[str, int], seconds: int, now: int) -> dict[str, int]:
    fresh = state["last_updated_unix"] and state["last_updated_unix"] >= max(now - seconds, 0)
    return {c: state[c] if fresh else 0 for c in COUNTERS}
