"""Settings of a run: defaults, over them a TOML file, over that the session's configuration."""

from __future__ import annotations

import logging
import tomllib
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import SparkSession

from .storage import exists, open_input

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Settings:
    """`review_threshold`: below it attributions are looked at; `narrator`: the narrator's voice by engine; `pauses`: milliseconds by boundary."""

    review_threshold: float = 0.80
    model_retries: int = 2
    model_pause: float = 1.0
    narrator: dict[str, str] = field(default_factory=lambda: {"fake": "narrator"})
    pauses: dict[str, int] = field(default_factory=dict)


def read_settings(path: str | None = None, spark: SparkSession | None = None) -> Settings:
    """The settings in force. A file that is missing or can't be read leaves the defaults, with a warning if it is there; so does a value of the wrong type.

    The file has the names of the fields, those of tables as sections. In the session they
    are `quillspark.<field>`, and `quillspark.<field>.<key>` for entries of tables.
    """
    given: dict[str, object] = {}
    if path is not None and exists(path):
        try:
            with open_input(path) as file:
                given = tomllib.loads(file.read().decode())
        except (OSError, ValueError) as error:
            log.warning("settings in %s can't be read: %s", path, error)
    out = Settings()
    for f in fields(Settings):
        default = getattr(out, f.name)
        if isinstance(default, dict):
            own = given.get(f.name, {})
            prefix = f"quillspark.{f.name}."
            more = {k.removeprefix(prefix): v for k, v in (spark.conf.getAll.items() if spark is not None else ()) if k.startswith(prefix)}
            value: object = default | (own if isinstance(own, dict) else {}) | more
            if f.name == "pauses":
                value = {k: _number(k, v, 0) for k, v in value.items()}
        else:
            value = given.get(f.name, default)
            if spark is not None:
                value = spark.conf.get(f"quillspark.{f.name}", None) or value
            value = _number(f.name, value, default)
        out = replace(out, **{f.name: value})
    return out


def _number(name: str, value: object, default: float) -> float:
    try:
        return type(default)(value)
    except (TypeError, ValueError):
        log.warning("setting %s is no number: %r", name, value)
        return default
