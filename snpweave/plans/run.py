"""Run control: names of files and folders, timing, and parallelism."""

from __future__ import annotations

import os
import re
import time
from contextlib import contextmanager
from datetime import datetime


def stamp(now: datetime | None = None) -> str:
    return (now or datetime.now()).strftime("%Y%m%d@%H%M")


def file_name(short: str, extension: str, folder: str | None = None, date: bool = True, now: datetime | None = None) -> str:
    """``folder/short_date.extension``."""
    name = f"{short}_{stamp(now)}" if date else short
    return os.path.join(folder or os.getcwd(), f"{name}.{extension.lstrip('.')}")


def folder_prefix(parent: str) -> int:
    """The next number for a numbered folder under ``parent``."""
    taken = [int(m[1]) for x in (os.listdir(parent) if os.path.isdir(parent) else []) if (m := re.match(r"(\d+)_", x))]
    return max(taken, default=0) + 1


def make_folder(name: str, parent: str | None = None, date: bool = True, prefix: bool = True, now: datetime | None = None) -> str:
    parent = parent or os.getcwd()
    base = f"{name}_{stamp(now)}" if date else name
    path = os.path.join(parent, f"{folder_prefix(parent):02d}_{base}" if prefix else base)
    os.makedirs(path, exist_ok=True)
    return path


def step_folders(steps: list[str], first: int = 1) -> list[str]:
    """Numbered folder names of a cascade's steps."""
    return [f"{first + i:02d}_{s.replace('.', '_')}" for i, s in enumerate(steps)]


@contextmanager
def timed(name: str, say=print):
    """Say how long a step took."""
    began = time.perf_counter()
    try:
        yield
    finally:
        say(f"{name}: {time.perf_counter() - began:.1f} s")


def cores(wanted: int | None = None, most: int | None = None) -> int:
    """An even number of cores, two left free."""
    n = min(wanted or 10**6, max((os.cpu_count() or 1) - 2, 1), most or 10**6)
    return n if n == 1 else n - n % 2


def show(value) -> str:
    """An argument as text for the log of a run."""
    if value is None:
        return "NULL"
    if isinstance(value, list | tuple | set):
        return ", ".join(map(str, value))
    return str(value)
