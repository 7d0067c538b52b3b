"""Stages run in order, with retries, and resumed from a manifest.

A manifest is JSON, at a path or a URI of any file system that Arrow reads: the state, the fingerprint of the main
stages' names and how many are done.
"""

from __future__ import annotations

import hashlib
import inspect
import json
import logging
import os
from collections.abc import Callable
from enum import Enum

from foliarc.shared import file_system, put_file

log = logging.getLogger(__name__)


class Kind(Enum):
    INIT = "init"
    MAIN = "main"
    INTER = "inter"
    RETRY = "retry"


class State(dict):
    """Values by name, as items or attributes."""

    __getattr__ = dict.get

    def __setattr__(self, name, value):
        self[name] = value


class Task:
    """A function, or several run in order; a parameter named state is given the state.  Exceptions and False are failure."""

    def __init__(self, *functions: Callable, name: str | None = None, **options):
        self.functions, self.options = functions, options
        self.name = name or "+".join(f.__name__ for f in functions)

    def run(self, state: State) -> bool:
        for f in self.functions:
            more = {"state": state} if "state" in inspect.signature(f).parameters else {}
            try:
                if f(**self.options, **more) is False:
                    return False
            except Exception:
                log.exception("%s failed", self.name)
                return False
        return True


def _uri(path: str) -> str:
    return path if ":/" in path else os.path.abspath(path)


def _manifest(path: str) -> dict | None:
    """What a manifest says; None where there is none."""
    system, place = file_system(_uri(path))
    if not system.get_file_info(place).is_file:
        return None
    with system.open_input_stream(place) as f:
        return json.loads(f.read())


class Pipeline:
    def __init__(self, max_retries: int = 3):
        self.tasks: dict[Kind, list[Task]] = {k: [] for k in Kind}
        self.max_retries = max_retries

    def add(self, task: Task | Callable | Pipeline | list, kind: Kind = Kind.MAIN, **options) -> Pipeline:
        if isinstance(task, Pipeline):
            for k in Kind:
                self.tasks[k] += task.tasks[k]
        elif isinstance(task, list):
            for t in task:
                self.add(t, kind, **options)
        else:
            self.tasks[kind].append(task if isinstance(task, Task) else Task(task, **options))
        return self

    def fingerprint(self) -> str:
        return hashlib.sha256("\n".join(t.name for t in self.tasks[Kind.MAIN]).encode()).hexdigest()

    def report(self) -> list[tuple[str, int, str]]:
        """(kind, place, name) of every task."""
        return [(k.value, i, t.name) for k in Kind for i, t in enumerate(self.tasks[k])]

    def save(self, path: str, state: State, done: int) -> None:
        text = json.dumps({"fingerprint": self.fingerprint(), "done": done, "state": state})
        put_file(_uri(path), lambda out: out.write(text.encode()))

    def _each(self, kind: Kind, state: State) -> bool:
        return all(any(t.run(state) for _ in range(self.max_retries + 1)) for t in self.tasks[kind])

    def run(self, state: State | None = None, manifest: str | None = None) -> bool:
        """Init tasks, then each main task up to max_retries more times with the retry tasks before each, then inter tasks and the manifest.

        A manifest that exists is resumed; one of other stages raises.
        """
        state, done = State() if state is None else state, 0
        if manifest and (m := _manifest(manifest)):
            if m["fingerprint"] != self.fingerprint():
                raise ValueError("the manifest belongs to a pipeline of other stages")
            state.update(m["state"])
            done = m["done"]
        if not self._each(Kind.INIT, state):
            return False
        for i, t in enumerate(self.tasks[Kind.MAIN][done:], done):
            for attempt in range(self.max_retries + 1):
                if attempt:
                    self._each(Kind.RETRY, state)
                if t.run(state):
                    break
            else:
                return False
            if not self._each(Kind.INTER, state):
                return False
            if manifest:
                self.save(manifest, state, i + 1)
        return True
