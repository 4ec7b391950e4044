"""Files that tasks read and write in a store that the driver and all executors see."""

from __future__ import annotations

import os
from urllib.parse import unquote, urlparse

import pyarrow.fs as pafs


def _local(url: str) -> str | None:
    part = urlparse(url)
    if part.scheme in ("", "file"):
        return unquote(part.path) if part.scheme else url
    return None


def store(url: str) -> tuple[pafs.FileSystem, str]:
    local = _local(url)
    return (pafs.LocalFileSystem(), local) if local is not None else pafs.FileSystem.from_uri(url)


class Output:
    """A file that appears under its name only when it is whole, so that a lost or repeated task leaves no half of one.

    As a context manager it is closed at the end, and deleted if that comes by an error.
    """

    def __init__(self, url: str):
        self.fs, self.path = store(url)
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.file = self.fs.open_output_stream(self.path + ".part")
        self.size = 0

    def __enter__(self) -> Output:
        return self

    def __exit__(self, kind: object, *_: object) -> None:
        if kind is None:
            self.close()
        else:
            self.discard()

    def write(self, raw: bytes) -> int:
        """Append; gives the offset at which the bytes begin."""
        at = self.size
        self.file.write(raw)
        self.size += len(raw)
        return at

    def close(self) -> None:
        self.file.close()
        self.fs.move(self.path + ".part", self.path)

    def discard(self) -> None:
        self.file.close()
        self.fs.delete_file(self.path + ".part")


class Appending:
    """An Output as zipfile wants it: it can't be sought, and `write` gives the number of bytes."""

    def __init__(self, out: Output):
        self.out = out

    def write(self, raw: bytes) -> int:
        self.out.write(bytes(raw))
        return len(raw)

    def flush(self) -> None:
        pass


def open_input(url: str):
    fs, path = store(url)
    return fs.open_input_file(path)


def listing(url: str, suffix: str = "") -> list[tuple[str, int]]:
    """Names (as URLs) and sizes of the files below a directory, or of the one file, in the order of names."""
    fs, path = store(url)
    prefix = url[: len(url) - len(path)] if url.endswith(path) else ("file://" if _local(url) is not None else "")
    one = fs.get_file_info(path)
    found = [one] if one.is_file else fs.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True))
    return sorted((prefix + f.path, f.size) for f in found if f.is_file and f.path.endswith(suffix))


def exists(url: str) -> bool:
    fs, path = store(url)
    return fs.get_file_info(path).type != pafs.FileType.NotFound


def remove(url: str) -> None:
    """Delete a file or a folder with all that is in it; one that isn't there is no error."""
    fs, path = store(url)
    kind = fs.get_file_info(path).type
    if kind == pafs.FileType.Directory:
        fs.delete_dir(path)
    elif kind == pafs.FileType.File:
        fs.delete_file(path)
