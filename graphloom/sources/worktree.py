"""Is the index of another worktree of the same repository in use? Asked of git in the driver, remembered for a while."""

from __future__ import annotations

import os
import subprocess
from functools import lru_cache

REMEMBERED = 1024


def _git(folder: str, *ask: str) -> str:
    try:
        out = subprocess.run(["git", "-C", folder, "rev-parse", *ask], capture_output=True, text=True, timeout=10)
    except (OSError, subprocess.TimeoutExpired):
        return ""
    return os.path.realpath(os.path.join(folder, out.stdout.strip())) if out.returncode == 0 and out.stdout.strip() else ""


@lru_cache(maxsize=REMEMBERED)
def mismatch(start: str, index_root: str) -> tuple[str, str] | None:
    """(worktree, index root) if both are tops of different worktrees that share one repository, else None."""
    here, there = _git(start, "--show-toplevel"), os.path.realpath(index_root)
    if not here or here == there or _git(there, "--show-toplevel") != there:
        return None
    ours, theirs = _git(here, "--git-common-dir"), _git(there, "--git-common-dir")
    return (here, there) if ours and ours == theirs else None
