"""A model that runs as a program of its own: one long-lived child for each Python worker, spoken to in JSON lines.

The child reads {"id": ..., "text": ...} a line and answers {"id": ..., "result": ...} a line, in any order. An answer that does not come
in time or a child that dies is met with a new child and the same question, so many times; an answer that was not asked
for, or comes twice, fails the job, and so no row is lost or swapped without notice.
"""

from __future__ import annotations

import json
import os
import select
import subprocess
import threading
import time
from collections.abc import Callable

import pandas as pd

from plumeline.operators.models import Model

_CHILDREN: dict[tuple[str, ...], _Child] = {}


class Unanswered(RuntimeError):
    """The child died or did not answer in time."""


class _Child:
    def __init__(self, command: tuple[str, ...]) -> None:
        self.command, self.next_id, self.rest = command, 0, b""
        self.process = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE)

    def close(self) -> None:
        self.process.kill()
        self.process.wait()
        for pipe in (self.process.stdin, self.process.stdout):
            try:
                pipe.close()
            except OSError:
                pass

    def ask(self, texts: list[str], seconds: float) -> list:
        ids = range(self.next_id, self.next_id + len(texts))
        self.next_id = ids.stop

        def send() -> None:  # beside reading, so that neither side waits for the other's full pipe
            try:
                for i, text in zip(ids, texts, strict=True):
                    self.process.stdin.write(json.dumps({"id": i, "text": text}).encode() + b"\n")
                self.process.stdin.flush()
            except (OSError, ValueError):
                pass  # the reader sees that the child is gone

        threading.Thread(target=send, daemon=True).start()
        answers: dict[int, object] = {}
        until, out = time.monotonic() + seconds, self.process.stdout.fileno()
        while len(answers) < len(texts):
            left = until - time.monotonic()
            if left <= 0 or not select.select([out], [], [], left)[0]:
                raise Unanswered(f"no answer within {seconds} s: {len(texts) - len(answers)} texts left")
            data = os.read(out, 1 << 16)
            if not data:
                raise Unanswered("the program ended")
            *lines, self.rest = (self.rest + data).split(b"\n")
            for line in filter(None, lines):
                answer = json.loads(line)
                if answer["id"] not in ids or answer["id"] in answers:
                    raise ValueError(f"answer {answer['id']} was not asked for, or came twice")
                answers[answer["id"]] = answer["result"]
        return [answers[i] for i in ids]


def subprocess_model(command: list[str], batch: int = 64, seconds: float = 60.0, restarts: int = 2) -> Callable[[], Model]:
    """For `apply_model`: texts are sent `batch` at a time; a null text is answered with null and not sent."""
    key = tuple(command)

    def answered(texts: list[str]) -> list:
        for left in range(restarts, -1, -1):
            child = _CHILDREN.get(key)
            if child is None or child.process.poll() is not None:
                child = _CHILDREN[key] = _Child(key)
            try:
                return child.ask(texts, seconds)
            except Unanswered:
                child.close()
                _CHILDREN.pop(key)
                if not left:
                    raise
            except Exception:
                child.close()
                _CHILDREN.pop(key)
                raise
        raise AssertionError

    def load() -> Model:
        def model(texts: pd.Series) -> pd.Series:
            known = texts[texts.notna()]
            found = [r for at in range(0, len(known), batch) for r in answered(known.iloc[at : at + batch].tolist())]
            return pd.Series(found, known.index, object).reindex(texts.index).where(texts.notna(), None)

        return model

    return load
