"""Files that tasks open themselves and read by ranges of bytes, for formats that Spark's readers would bring whole into one row.

The driver lists names and sizes only. The paths have to mean the same on the driver and on all executors, as those of a shared or mounted folder do.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit


def local(path: str) -> str:
    """A path without the scheme of local files; ValueError for other schemes, which only Spark's own readers open."""
    parts = urlsplit(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{path}: only files of a mounted folder can be read by ranges")
    return unquote(parts.path) if parts.scheme else path


def listed(path: str) -> Iterator[tuple[str, int]]:
    """The files that a path or pattern names, and those below a folder, with their sizes, in order; FileNotFoundError if there are none."""
    plain = local(path)
    found = [plain] if os.path.exists(plain) else glob.glob(plain, recursive=True)
    names = [os.path.join(folder, f) for p in found for folder, _, files in os.walk(p) for f in files] + [p for p in found if os.path.isfile(p)]
    if not names:
        raise FileNotFoundError(path)
    for name in sorted(names):
        yield name, os.path.getsize(name)
