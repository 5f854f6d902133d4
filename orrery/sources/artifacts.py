"""Model artifacts: a folder with a manifest (version, SHA-256 of every file), a JSON object and its arrays.

Loading executes nothing from the folder: only registered classes are made, and arrays are read as plain data. The folder is on
the driver's file system; a model that refers to a DataFrame (nearest neighbours) is not saved.
"""

from __future__ import annotations

import hashlib
import importlib
import io
import json
from collections.abc import Callable
from dataclasses import fields, is_dataclass
from pathlib import Path
from typing import Any

import numpy as np
from pyspark.sql import DataFrame

from orrery.core import Fitted
from orrery.errors import PersistenceVersionError, UnsupportedDataError

VERSION = 2
_MODULES = ("orrery.core", "orrery.selection", "orrery.pipeline", *[f"orrery.operators.{m}" for m in ("preprocess", "linear", "probabilistic", "unsupervised", "trees", "kernel_neural", "meta", "neighbors")])


def migrate_1_to_2(manifest: dict) -> dict:
    """Version 1 kept the checksums under ``checksums``."""
    return {**manifest, "version": 2, "files": manifest.get("checksums", {}), "history": [*manifest.get("history", []), "1 to 2"]}


_MIGRATIONS: dict[int, Callable[[dict], dict]] = {1: migrate_1_to_2}


def _encode(x: Any, arrays: list[np.ndarray]) -> Any:
    if isinstance(x, np.ndarray):
        if x.dtype == object:
            return {"list": [_encode(v, arrays) for v in x.tolist()]}
        arrays.append(x)
        return {"array": len(arrays) - 1}
    if isinstance(x, np.generic):
        return x.item()
    if x is None or isinstance(x, (bool, int, str)):
        return x
    if isinstance(x, float):
        return x if np.isfinite(x) else {"float": repr(x)}
    if isinstance(x, tuple):
        return {"tuple": [_encode(v, arrays) for v in x]}
    if isinstance(x, list):
        return {"list": [_encode(v, arrays) for v in x]}
    if isinstance(x, dict):
        return {"dict": [[_encode(k, arrays), _encode(v, arrays)] for k, v in x.items()]}
    if is_dataclass(x) and type(x).__module__ in _MODULES:
        return {"class": f"{type(x).__module__}:{type(x).__name__}", "fields": {f.name: _encode(getattr(x, f.name), arrays) for f in fields(x)}}
    if isinstance(x, DataFrame):
        raise UnsupportedDataError("a model that refers to a DataFrame cannot be saved; save its table instead")
    raise UnsupportedDataError(f"cannot save a value of type {type(x).__name__}")


def _decode(x: Any, arrays: list[np.ndarray]) -> Any:
    if isinstance(x, list):
        return [_decode(v, arrays) for v in x]
    if not isinstance(x, dict):
        return x
    if "array" in x:
        return arrays[x["array"]]
    if "float" in x:
        return float(x["float"])
    if "tuple" in x:
        return tuple(_decode(v, arrays) for v in x["tuple"])
    if "list" in x:
        return [_decode(v, arrays) for v in x["list"]]
    if "dict" in x:
        return {_decode(k, arrays): _decode(v, arrays) for k, v in x["dict"]}
    module, name = x["class"].split(":")
    if module not in _MODULES:
        raise PersistenceVersionError(f"unknown class {x['class']}")
    cls = getattr(importlib.import_module(module), name)
    if not is_dataclass(cls):
        raise PersistenceVersionError(f"unknown class {x['class']}")
    made = object.__new__(cls)
    for key, value in x["fields"].items():
        object.__setattr__(made, key, _decode(value, arrays))
    return made


def save_model(fitted: Fitted, folder: str) -> None:
    path, arrays = Path(folder), []
    body = _encode(fitted, arrays)
    path.mkdir(parents=True, exist_ok=True)
    files = {"object.json": json.dumps(body).encode()}
    for i, a in enumerate(arrays):
        out = io.BytesIO()
        np.save(out, a, allow_pickle=False)
        files[f"array{i}.npy"] = out.getvalue()
    for name, data in files.items():
        (path / name).write_bytes(data)
    manifest = {"version": VERSION, "files": {n: hashlib.sha256(d).hexdigest() for n, d in files.items()}, "arrays": len(arrays), "history": []}
    (path / "manifest.json").write_text(json.dumps(manifest))


def load_model(folder: str) -> Fitted:
    path = Path(folder)
    manifest = json.loads((path / "manifest.json").read_text())
    while manifest["version"] in _MIGRATIONS:
        manifest = _MIGRATIONS[manifest["version"]](manifest)
    if manifest["version"] != VERSION:
        raise PersistenceVersionError(f"version {manifest['version']} is not known")
    data = {}
    for name, want in manifest["files"].items():
        data[name] = (path / name).read_bytes()
        if hashlib.sha256(data[name]).hexdigest() != want:
            raise PersistenceVersionError(f"{name} was changed or damaged")
    arrays = [np.load(io.BytesIO(data[f"array{i}.npy"]), allow_pickle=False) for i in range(manifest["arrays"])]
    return _decode(json.loads(data["object.json"]), arrays)
