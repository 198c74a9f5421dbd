"""Configuration values: JSON files, environment placeholders, scalars of uncertain type, source roots, JSON inside prose."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def load(path: str) -> dict:
    """A JSON or, where a reader is installed, YAML file; a missing file is an empty configuration, another value than an object an error."""
    p = Path(path)
    if not p.is_file():
        return {}
    text = p.read_text(encoding="utf-8")
    if p.suffix.lower() in (".yaml", ".yml"):
        import yaml  # optional

        value = yaml.safe_load(text) or {}
    else:
        value = json.loads(text)
    if not isinstance(value, dict):
        raise ValueError(f"{path}: no object")
    return value


def table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document of many lines, an array or object, as rows."""
    return spark.read.schema(schema).json(path, multiLine=True)


def expanded(value: str, environment: Mapping[str, str] | None = None) -> str:
    """`env:X` and `${ENV:X}` replaced; an unset variable is an error that names it and no value."""
    env = os.environ if environment is None else environment

    def get(name: str) -> str:
        if name not in env:
            raise KeyError(f"environment variable {name} is not set")
        return env[name]

    whole = re.fullmatch(r"\s*env:([A-Za-z_]\w*)\s*", value)
    return get(whole[1]) if whole else re.sub(r"\$\{ENV:([A-Za-z_]\w*)\}", lambda m: get(m[1]), value)


def boolean(value: object, default: bool = False) -> bool:
    return default if value is None else value if isinstance(value, bool) else str(value).strip().lower() in ("1", "true", "yes", "on")


def integer(value: object, least: int | None = None) -> int | None:
    """None for what is no number, never below ``least``."""
    try:
        n = int(str(value).strip())
    except ValueError:
        return None
    return n if least is None else max(least, n)


def strings(value: object) -> list[str]:
    """None gives no strings, a string itself, another sequence its non-empty members."""
    return [] if value is None else [value] if isinstance(value, str) else [str(x) for x in value if x is not None and str(x) != ""]


def source_roots(pairs: list[str]) -> dict[str, str]:
    """`id=path` pairs; one without either part is an error."""
    out = {}
    for p in pairs:
        name, sign, path = p.partition("=")
        if not sign or not name.strip() or not path.strip():
            raise ValueError(f"no id=path pair: {p}")
        out[name.strip()] = path.strip()
    return out


def source_root(corpus: str, overrides: Mapping[str, str], configured: str | None, fallbacks: list[str], environment: Mapping[str, str] | None = None, prefix: str = "CORPUS_ROOT_") -> str | None:
    """Where a corpus lies: an override, else an environment variable, else the configuration, else the first fallback that exists."""
    env = os.environ if environment is None else environment
    name = prefix + re.sub(r"[^A-Z0-9]+", "_", corpus.upper())
    return overrides.get(corpus) or env.get(name) or configured or next((f for f in fallbacks if Path(f).is_dir()), None)


def selected(known: list[str], wanted: list[str]) -> list[str]:
    """Ids as asked for, whatever their case, in the asked order; an unknown one is an error."""
    by_name = {k.lower(): k for k in known}
    for w in wanted:
        if w.lower() not in by_name:
            raise ValueError(f"unknown id: {w}")
    return [by_name[w.lower()] for w in wanted]


def recovered(text: str) -> dict | list | None:
    """The JSON value of a text, or the first whole object in it (also inside a code fence), else None."""
    decoder = json.JSONDecoder()
    try:
        return json.loads(text)
    except ValueError:
        pass
    at = text.find("{")
    while at >= 0:
        try:
            return decoder.raw_decode(text, at)[0]
        except ValueError:
            at = text.find("{", at + 1)
    return None
