"""Connection settings from YAML and the environment, checks of names, and retries."""

from __future__ import annotations

import functools
import logging
import random
import re
import time
from collections.abc import Callable

from ..schema.canonical import substitute

log = logging.getLogger(__name__)
# What each kind of connection needs, and signs of errors that pass.
REQUIRED = {"bigquery": ["project"], "snowflake": ["user", "password", "account"], "postgresql": ["host", "database", "user", "password"], "redshift": ["host", "database", "user", "password"], "sqlserver": ["server", "database"], "jdbc": ["url"]}
TRANSIENT = ["timeout", "timed out", "connection reset", "connection refused", "temporarily unavailable", "ratelimitexceeded", "rate limit", "too many connections", "deadlock", "503", "429"]


class Settings:
    """target: {default: name, name: {type: ..., ...}} from a dict or a YAML file."""

    def __init__(self, raw: dict, env: dict | None = None):
        self.raw = substitute(raw, env)

    @classmethod
    def from_yaml(cls, path: str, env: dict | None = None) -> Settings:
        import yaml

        with open(path, encoding="utf-8") as f:
            return cls(yaml.safe_load(f) or {}, env)

    def targets(self) -> list[str]:
        return sorted(self.raw.get("connections", {}))

    def default(self) -> str | None:
        return self.raw.get("target")

    def get(self, name: str | None = None) -> dict:
        name = name or self.default()
        if name not in self.raw.get("connections", {}):
            raise KeyError(f"no connection {name}; there are {self.targets()}")
        found = self.raw["connections"][name]
        kind = found.get("type", name)
        absent = [k for k in REQUIRED.get(kind, []) if not found.get(k)]
        if absent:
            raise ValueError(f"{name} lacks {', '.join(absent)}")
        return found


def check_table_name(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z_][\w$]*(\.[A-Za-z_][\w$]*){0,2}", name):
        raise ValueError(f"not a table name: {name!r}")
    return name


def hide_secrets(text: str) -> str:
    return re.sub(r"(?i)(password|pwd|token|secret|key)(\s*[=:]\s*)([^;&\s]+)", r"\1\2***", re.sub(r"://([^:/@\s]+):[^@\s]+@", r"://\1:***@", text))


def is_transient(error: BaseException) -> bool:
    text = f"{type(error).__name__} {error}".lower()
    return isinstance(error, ConnectionError | TimeoutError) or any(p in text for p in TRANSIENT)


def backoff(attempt: int, base: float = 1.0, factor: float = 2.0, most: float = 60.0, jitter: bool = True) -> float:
    wait = min(most, base * factor**attempt)
    return wait * random.uniform(0.5, 1.0) if jitter else wait


def retry(attempts: int = 3, base: float = 1.0, test: Callable[[BaseException], bool] = is_transient, sleep: Callable[[float], None] = time.sleep):
    """For calls on the driver; tasks are retried by Spark."""
    def wrap(f):
        @functools.wraps(f)
        def call(*a, **k):
            for n in range(attempts):
                try:
                    return f(*a, **k)
                except Exception as e:
                    if n + 1 == attempts or not test(e):
                        raise
                    log.warning("attempt %d failed: %s", n + 1, hide_secrets(str(e)))
                    sleep(backoff(n, base))

        return call

    return wrap
