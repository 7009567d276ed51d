"""What to scan: targets by their spelling, checkouts on the driver, settings from the environment."""

from __future__ import annotations

import contextlib
import os
import re
import shutil
import subprocess
import tempfile
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, fields

_HUB = re.compile(r"^(?:https?://)?(?:www\.)?github\.com/([\w.-]+)/([\w.-]+?)(?:\.git)?(?:/tree/([\w./-]+))?/?$")
_GIT = re.compile(r"^(?:git@[\w.-]+:|ssh://|git://|https?://).+")


@dataclass(frozen=True)
class Target:
    """kind is DIRECTORY, FILE, GIT_URL or GITHUB."""

    kind: str
    place: str
    ref: str | None = None


def resolve(text: str) -> Target:
    """A target by its spelling; folders and files must exist."""
    text = text.strip()
    if m := _HUB.match(text):
        return Target("GITHUB", f"https://github.com/{m[1]}/{m[2]}.git", m[3])
    if _GIT.match(text):
        return Target("GIT_URL", text)
    path = os.path.realpath(os.path.expanduser(text))
    if os.path.isdir(path):
        return Target("DIRECTORY", path)
    if os.path.isfile(path):
        return Target("FILE", path)
    raise ValueError(f"no such target: {text}")


@contextlib.contextmanager
def acquired(target: Target, top: str | None = None, timeout: int = 120) -> Iterator[str]:
    """The folder or file to read; a repository is cloned without history and removed afterwards.

    ``top`` is a folder that the executors see, where the scan runs on a cluster.
    """
    if target.kind in ("DIRECTORY", "FILE"):
        yield target.place
        return
    with isolated(top) as folder:
        ref = ["--branch", target.ref] if target.ref else []
        subprocess.run(["git", "clone", "--quiet", "--depth", "1", *ref, "--", target.place, folder], check=True, capture_output=True, timeout=timeout, env=os.environ | {"GIT_TERMINAL_PROMPT": "0"})
        yield folder


@contextlib.contextmanager
def isolated(top: str | None = None) -> Iterator[str]:
    """An empty folder of its own, removed whatever happens."""
    folder = tempfile.mkdtemp(prefix="scan-", dir=top)
    try:
        yield folder
    finally:
        shutil.rmtree(folder, ignore_errors=True)


@dataclass
class Settings:
    max_file_bytes: int = 10_000_000
    scan_timeout: int = 300
    fail_on: str = "HIGH"
    offline: bool = True
    log_level: str = "INFO"

    @classmethod
    def from_env(cls, env: Mapping[str, str], prefix: str = "LAKEWARDEN_") -> Settings:
        """Values of the environment, in the type of the default; what can't be read raises."""
        out = cls()
        for f in fields(cls):
            raw = env.get(prefix + f.name.upper())
            if raw is not None:
                old = getattr(out, f.name)
                setattr(out, f.name, raw.strip().lower() in ("1", "true", "yes", "on") if isinstance(old, bool) else int(raw) if isinstance(old, int) else raw)
        return out
