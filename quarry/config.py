"""Settings, and their files in JSON or simple YAML."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields, is_dataclass


@dataclass
class ModelServer:
    endpoint: str = "http://localhost:11434"
    embedding_model: str = "nomic-embed-text"
    chat_model: str = "gemma3:4b"
    vision_model: str = "llama3.2-vision"
    timeout_seconds: int = 30
    vector_size: int = 768


@dataclass
class Chunking:
    max_tokens: int = 256
    overlap: int = 38


@dataclass
class Config:
    path: str = "corpus"
    model: ModelServer = field(default_factory=ModelServer)
    chunking: Chunking = field(default_factory=Chunking)
    image_max_size: int = 1120


def from_dict(kind, values: dict):
    """A settings object with the values given; names it does not have are an error."""
    known = {f.name: f for f in fields(kind)}
    if extra := set(values) - set(known):
        raise ValueError(f"unknown settings: {', '.join(sorted(extra))}")
    default = kind()
    return kind(**{k: from_dict(type(getattr(default, k)), v) if is_dataclass(getattr(default, k)) else type(getattr(default, k))(v) for k, v in values.items()})


def _parse_yaml(text: str) -> dict:
    """Nested maps of plain values, which is all that settings need."""
    root: dict = {}
    stack = [(-1, root)]
    for raw in text.splitlines():
        line = raw.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        depth = len(line) - len(line.lstrip())
        key, colon, value = line.strip().partition(":")
        if not colon:
            raise ValueError(f"not a setting: {raw!r}")
        while stack[-1][0] >= depth:
            stack.pop()
        if value.strip():
            try:
                stack[-1][1][key] = json.loads(value)
            except ValueError:
                stack[-1][1][key] = value.strip().strip("'\"")
        else:
            stack[-1][1][key] = {}
            stack.append((depth, stack[-1][1][key]))
    return root


def _dump_yaml(values: dict, indent: int = 0) -> str:
    out = ""
    for k, v in values.items():
        out += " " * indent + (f"{k}:\n" + _dump_yaml(v, indent + 2) if isinstance(v, dict) else f"{k}: {json.dumps(v)}\n")
    return out


def _format(path: str) -> str:
    kind = os.path.splitext(path)[1].lower()
    if kind not in (".json", ".yaml", ".yml"):
        raise ValueError(f"settings are kept in .json, .yaml or .yml files, not {kind or 'a file without extension'}")
    return kind


def load(path: str) -> Config:
    """Settings from a file; the defaults if there is none."""
    kind = _format(path)
    if not os.path.exists(path):
        return Config()
    with open(path) as f:
        text = f.read()
    return from_dict(Config, json.loads(text) if kind == ".json" else _parse_yaml(text))


def save(config: Config, path: str) -> None:
    kind = _format(path)
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w") as f:
        f.write(json.dumps(asdict(config), indent=2) if kind == ".json" else _dump_yaml(asdict(config)))


def get(config: Config, key: str):
    """A value by its dotted name."""
    out = config
    for part in key.split("."):
        if not hasattr(out, part):
            raise KeyError(key)
        out = getattr(out, part)
    return out


def put(config: Config, key: str, value: str) -> None:
    """Set a value by its dotted name; text becomes what the value was."""
    head, _, last = key.rpartition(".")
    at = get(config, head) if head else config
    old = get(at, last)
    if is_dataclass(old):
        raise KeyError(key)
    setattr(at, last, type(old)(value))
