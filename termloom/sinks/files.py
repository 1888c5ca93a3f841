"""Rendered files to disk: written under another name and moved, so that readers see whole files; unchanged runs write nothing."""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import DataFrame


def digest(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def write_all(files: DataFrame, folder: str, keep: tuple[str, ...] = ()) -> dict[str, list[str]]:
    """Write (file, text) rows, one at a time; files of the folder that aren't produced or kept are deleted.

    Returns the names that were added, rewritten, unchanged and removed. Output files are one per scheme, each of which a task has
    rendered already, so the driver holds one at a time."""
    done: dict[str, list[str]] = {"added": [], "rewritten": [], "unchanged": [], "removed": []}
    os.makedirs(folder, exist_ok=True)
    produced, recorded = set(), {}
    for r in files.select("file", "text").orderBy("file").toLocalIterator():
        name, data = r["file"], r["text"].encode()
        if os.path.basename(name) != name or name.startswith("."):
            raise ValueError(f"not a flat file name: {name!r}")
        produced.add(name)
        recorded[name] = digest(data)
        path = os.path.join(folder, name)
        old = open(path, "rb").read() if os.path.exists(path) else None
        if old == data:
            done["unchanged"].append(name)
            continue
        with open(path + ".part", "wb") as f:
            f.write(data)
        os.replace(path + ".part", path)
        done["rewritten" if old is not None else "added"].append(name)
    for name in sorted(os.listdir(folder)):
        if name.endswith(".ttl") and name not in produced and name not in keep:
            os.remove(os.path.join(folder, name))
            done["removed"].append(name)
    with open(os.path.join(folder, ".manifest.json"), "w") as f:
        f.write(json.dumps({"files": recorded}, indent=2, sort_keys=True) + "\n")
    return done


def verify(folder: str) -> list[tuple[str, str]]:
    """(file, finding) of files that differ from the manifest: changed, missing or unrecorded."""
    with open(os.path.join(folder, ".manifest.json")) as f:
        recorded = json.load(f)["files"]
    present = {n for n in os.listdir(folder) if n.endswith(".ttl")}
    out = [(n, "missing") for n in recorded if n not in present] + [(n, "unrecorded") for n in present if n not in recorded]
    for n in sorted(present & set(recorded)):
        with open(os.path.join(folder, n), "rb") as f:
            if digest(f.read()) != recorded[n]:
                out.append((n, "changed"))
    return sorted(out)
