"""Files in the shared folder, by URI: whole writes and range reads from any process."""

from __future__ import annotations

import uuid

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class Writer:
    """A file that appears under its final name only when it is closed without an error.

    Its name has a random part, so that a repeated or speculative task never overwrites
    what another wrote; a file counts only if the task's own result names it.
    """

    def __init__(self, folder: str, name: str) -> None:
        stem, dot, kind = name.partition(".")
        self.uri = f"{folder}/{stem}-{uuid.uuid4().hex[:12]}{dot}{kind}"
        self.fs, self.path = opened(self.uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(f"{self.path}.part")
        self.size = 0

    def write(self, data: bytes) -> int:
        """Where the data begin."""
        at = self.size
        self.out.write(data)
        self.size += len(data)
        return at

    def __enter__(self) -> Writer:
        return self

    def __exit__(self, kind, *_) -> None:
        self.out.close()
        if kind is None:
            self.fs.move(f"{self.path}.part", self.path)
        else:
            self.fs.delete_file(f"{self.path}.part")


class Reader:
    def __init__(self, uri: str) -> None:
        system, path = opened(uri)
        self.file = system.open_input_file(path)
        self.size = self.file.size()

    def read(self, at: int, n: int) -> bytes:
        data = self.file.read_at(n, at)
        if len(data) != n:
            raise OSError("the file ends early")
        return data

    def close(self) -> None:
        self.file.close()
