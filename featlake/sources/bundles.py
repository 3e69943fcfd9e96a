"""Bundles of result files: sealed with a manifest, verified, archived so that equal contents give equal bytes, unpacked.

Folders and archives lie on a path that this process can open; found() and verify_bundle() of `files` check larger
trees with Spark, wherever they are.
"""

from __future__ import annotations

import contextlib
import gzip
import hashlib
import io
import json
import os
import shutil
import tarfile
import uuid
from pathlib import Path

#: Fixed values of the format.
MANIFEST, SCHEMA = "manifest.json", 1


def fault(name: str) -> str | None:
    """What is wrong with a member's name; None if it stays inside the bundle."""
    steps = name.split("/")
    bad = not name or "\\" in name or name.startswith("/") or any(s in ("", ".", "..") for s in steps)
    return "unsafe" if bad else None


def contents(root: Path) -> dict[str, dict]:
    """Size and digest of each file under root by name; a link or another kind of file is an error."""
    out = {}
    for folder, _, names in os.walk(root):
        for n in names:
            p = Path(folder, n)
            name = p.relative_to(root).as_posix()
            if p.is_symlink() or not p.is_file():
                raise ValueError(f"{name} is not a regular file")
            if name != MANIFEST:
                with p.open("rb") as f:
                    out[name] = {"bytes": p.stat().st_size, "sha256": hashlib.file_digest(f, "sha256").hexdigest()}
    return dict(sorted(out.items()))


def seal(root: Path, kind: str, metadata: dict | None = None) -> dict:
    """Write the manifest of a folder."""
    files = [{"path": n, **facts} for n, facts in contents(root).items()]
    manifest = {"schema_version": SCHEMA, "kind": kind, "metadata": metadata or {}, "files": files}
    (root / MANIFEST).write_text(json.dumps(manifest, indent=2, sort_keys=True) + "\n")
    return manifest


def problems(root: Path) -> list[tuple[str, str]]:
    """(name, problem) of members that are unsafe, listed twice, missing, changed or not listed."""
    manifest = json.loads((root / MANIFEST).read_text())
    if manifest.get("schema_version") != SCHEMA:
        return [(MANIFEST, "of another version")]
    here, seen, out = contents(root), set(), []
    for f in manifest["files"]:
        name = f["path"]
        if why := fault(name):
            out.append((name, why))
        elif name in seen or name == MANIFEST:
            out.append((name, "listed twice" if name in seen else "reserved"))
        elif name not in here:
            out.append((name, "missing"))
        elif here[name] != {k: f[k] for k in ("bytes", "sha256")}:
            out.append((name, "changed"))
        seen.add(name)
    return out + [(n, "unlisted") for n in here if n not in seen]


def verify(root: Path) -> dict:
    if found := problems(root):
        raise ValueError(f"{root}: {found}")
    return json.loads((root / MANIFEST).read_text())


def archive(root: Path, output: Path) -> str:
    """Pack a verified folder, compressed if output ends in .gz; gives its digest. Names, sizes and bytes alone count."""
    names = [MANIFEST, *(f["path"] for f in verify(root)["files"])]
    if output.exists():
        raise FileExistsError(output)
    part = output.with_name(f".{output.name}.{uuid.uuid4().hex}")
    with contextlib.ExitStack() as stack:
        stack.callback(lambda: part.unlink(missing_ok=True))
        with part.open("wb") as raw, gzip.GzipFile("", "wb", 9, raw, 0) if output.suffix == ".gz" else contextlib.nullcontext(raw) as to, tarfile.open(fileobj=to, mode="w", format=tarfile.PAX_FORMAT) as tar:
            for n in sorted(names):
                body = (root / n).read_bytes()
                member = tarfile.TarInfo(n)
                member.size, member.mode, member.mtime = len(body), 0o644, 0
                tar.addfile(member, io.BytesIO(body))
        os.replace(part, output)
    return hashlib.sha256(output.read_bytes()).hexdigest()


def unpack(source: Path, output: Path) -> dict:
    """Unpack regular files with safe names, each once; the folder shows only once it is verified."""
    if output.exists():
        raise FileExistsError(output)
    hidden = output.with_name(f".{output.name}.{uuid.uuid4().hex}")
    try:
        with tarfile.open(source) as tar:
            seen = set()
            for m in tar:
                if not m.isreg() or m.name in seen or fault(m.name):
                    raise ValueError(f"{m.name}: not a regular file with a safe name of its own")
                seen.add(m.name)
                (hidden / m.name).parent.mkdir(parents=True, exist_ok=True)
                with (hidden / m.name).open("xb") as f:
                    shutil.copyfileobj(tar.extractfile(m), f)
        manifest = verify(hidden)
        hidden.rename(output)
        return manifest
    finally:
        shutil.rmtree(hidden, ignore_errors=True)
