"""Configuration: reading with overrides, and rules that tell errors (nothing is saved) from warnings."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from ..operators.pairs import EXPORTS
from ..operators.training import METRICS
from .state import backup, merged, read_json, resolved, write_json, write_text

REQUIRED = (("paths", "data_root"), ("paths", "pairs"), ("model", "name"))
BACKENDS = ("auto", "hf", "internvl")
AT_LEAST_ONE = ("first_train_min_pairs", "retrain_every_n_pairs", "epochs", "gradient_accumulation_steps")


@dataclass
class Checked:
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return not self.errors


def _number(value: Any) -> float | None:
    try:
        return None if value is None else float(value)
    except (TypeError, ValueError):
        return float("nan")


def _errors(config: dict) -> Iterator[str]:
    of = lambda section: config.get(section) or {}
    yield from (f"{s}.{k} is missing" for s, k in REQUIRED if not of(s).get(k))
    root = of("paths").get("data_root")
    if root and not os.path.isdir(root):
        yield f"paths.data_root is no folder: {root}"
    if str(of("model").get("backend", "auto")).lower() not in BACKENDS:
        yield f"model.backend is none of {BACKENDS}"
    if of("model").get("load_in_4bit") or of("model").get("load_in_8bit"):
        yield "quantised models are not supported"
    if str(of("model").get("backend", "")).lower() == "internvl" and str(of("model").get("dtype", "bfloat16")).lower() not in ("bfloat16", "bf16"):
        yield "model.dtype has to be bfloat16 for this backend"
    if not str(config.get("language", "ko")):
        yield "language is empty"
    yield from (f"train.{k} has to be at least 1" for k in AT_LEAST_ONE if (x := _number(of("train").get(k))) is not None and not x >= 1)
    if (beta := _number(of("train").get("dpo_beta"))) is not None and not 0 < beta <= 1:
        yield "train.dpo_beta has to be above 0 and at most 1"
    if unknown := [m for m in of("eval").get("metrics") or [] if m not in METRICS]:
        yield f"eval.metrics are not known: {unknown}"
    if str(of("export").get("format", "flat")) not in EXPORTS:
        yield f"export.format is none of {sorted(EXPORTS)}"
    if not isinstance(of("export").get("field_map") or {}, dict):
        yield "export.field_map is no mapping"
    if (limit := _number(of("kg").get("max_papers") or 0)) is not None and not limit >= 0:
        yield "kg.max_papers is below 0"


def _warnings(config: dict) -> Iterator[str]:
    of = lambda section: config.get(section) or {}
    for name in ("pairs", "state", "graph", "eval"):
        path = of("paths").get(name)
        if path and not os.path.isdir(os.path.dirname(path) or "."):
            yield f"paths.{name}: its folder will be made"
    rate = _number(of("train").get("learning_rate"))
    if rate is not None and not 0 < rate < 1e-2:
        yield "train.learning_rate is unusual"
    if ((of("kg").get("overrides") or {}).get("semantic") or {}).get("enabled"):
        yield "kg.overrides.semantic compares all nodes of a paper"


def checked(config: Any) -> Checked:
    if not isinstance(config, dict):
        return Checked(["the configuration is no mapping"])
    return Checked(list(_errors(config)), list(_warnings(config)))


def stored(path: str) -> dict:
    """What a configuration file holds: YAML or JSON, by its name; nothing if it is missing."""
    if not path.endswith((".yaml", ".yml")):
        return read_json(path, {})
    import yaml

    try:
        with open(path, encoding="utf-8") as file:
            return yaml.safe_load(file) or {}
    except FileNotFoundError:
        return {}


def load(path: str, overrides: dict | None = None) -> dict:
    return resolved(merged(stored(path), overrides))


def edited(lines: list[str], changes: dict) -> list[str]:
    """The lines of a YAML file with values SECTION.KEY set; all other lines, comments too, stay as they are."""
    out = list(lines)
    for section, values in changes.items():
        if not isinstance(values, dict):
            out = _set(out, 0, len(out), "", section, values)
            continue
        start = next((i for i, x in enumerate(out) if re.match(rf"{re.escape(section)}\s*:", x)), None)
        if start is None:
            start = len(out)
            out.append(f"{section}:")
        for key, value in values.items():
            if value is None:
                continue
            end = next((i for i in range(start + 1, len(out)) if re.match(r"[^\s#]", out[i])), len(out))
            out = _set(out, start + 1, end, "  ", key, value)
    return out


def _set(lines: list[str], start: int, end: int, indent: str, key: str, value: Any) -> list[str]:
    written = json.dumps(value, ensure_ascii=False)
    for i in range(start, end):
        if found := re.match(rf"(\s*){re.escape(key)}\s*:(?=\s|$)", lines[i]):
            if bool(found[1]) != bool(indent):
                continue
            after = i + 1  # what belongs to the old value
            while after < end and (re.match(rf"{found[1]}(\s|- )", lines[after]) and lines[after].strip() and not lines[after].lstrip().startswith("#")):
                after += 1
            comment = re.search(r"\s#[^\"']*$", lines[i])
            return [*lines[:i], f"{found[1]}{key}: {written}{comment[0] if comment else ''}", *lines[after:]]
    while end > start and not lines[end - 1].strip():
        end -= 1
    return [*lines[:end], f"{indent}{key}: {written}", *lines[end:]]


def save(path: str, changes: dict, check: Callable[[Any], Checked] = checked) -> Checked:
    """Lays changes over the stored configuration; only a configuration without errors is written, after a backup."""
    new = merged(stored(path), changes)
    result = check(new)
    if result.ok:
        backup(path)
        if path.endswith((".yaml", ".yml")):
            before = Path(path).read_text(encoding="utf-8").splitlines() if os.path.exists(path) else []
            write_text(path, "\n".join(edited(before, changes)) + "\n")
        else:
            write_json(path, new)
    return result


def model_family(config: dict | None, name: str) -> str:
    """The backend of a model: by its own configuration's architectures, else by its name."""
    architectures = " ".join((config or {}).get("architectures") or ()).lower()
    folded = name.lower()
    custom = "internvlchat" in architectures or (not architectures and "internvl" in folded and not folded.endswith("-hf"))
    if custom:
        return "internvl"
    if architectures or folded.endswith("-hf") or any(x in folded for x in ("qwen", "llava", "gemma", "phi", "mllama")):
        return "hf"
    raise ValueError(f"the family of {name!r} is not known; set model.backend")
