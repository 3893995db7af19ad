"""Discovery of recordings on disk: the oldest unseen file first, each once by its identity."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

EXTENSION = ".mcap"
#: Bytes at a file's beginning that tell it from another one with its identity.
HEAD = 4096


@dataclass(frozen=True, order=True)
class Found:
    """A recording on disk; they sort by age."""

    mtime_ns: int
    path: str
    device: int
    inode: int
    size: int = field(default=0, compare=False)
    ctime_ns: int = field(default=0, compare=False)

    @property
    def identity(self) -> tuple[int, int]:
        return self.device, self.inode


def listed(folder: str) -> list[Found]:
    """The recordings of a folder (or the file itself) by age. Files that vanish meanwhile are left out."""
    out = []
    paths = [folder] if os.path.isfile(folder) else [e.path for e in os.scandir(folder) if e.name.endswith(EXTENSION)] if os.path.isdir(folder) else []
    for path in paths:
        try:
            s = os.stat(path)
        except FileNotFoundError:
            continue
        if os.path.isfile(path):
            out.append(Found(s.st_mtime_ns, path, s.st_dev, s.st_ino, s.st_size, s.st_ctime_ns))
    return sorted(out)


def newest(folder: str) -> Found | None:
    return max(listed(folder), default=None)


class Discovery:
    """Yields the oldest recording that hasn't been seen. Identities that are gone from disk are forgotten.

    from_start: whether files that are there already count as unseen.
    """

    def __init__(self, folder: str, from_start: bool = True):
        self.folder = folder
        self.seen = set() if from_start else {f.identity for f in listed(folder)}

    def next(self) -> Found | None:
        now = listed(self.folder)
        self.seen &= {f.identity for f in now}
        for f in now:
            if f.identity not in self.seen:
                self.seen.add(f.identity)
                return f
        return None

    def drain(self) -> Iterator[Found]:
        while (f := self.next()) is not None:
            yield f


def changed(path: str, identity: tuple[int, int]) -> bool:
    """Whether another file stands at the path now, or none."""
    try:
        s = os.stat(path)
    except FileNotFoundError:
        return True
    return (s.st_dev, s.st_ino) != identity


def head(path: str, size: int = HEAD) -> list[int]:
    """How many bytes were read of a file's beginning, at most `size`, and their checksum."""
    with open(path, "rb") as f:
        data = f.read(size)
    return [len(data), zlib.crc32(data)]
