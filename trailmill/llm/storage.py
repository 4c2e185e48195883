"""Files in the shared folder, from executors: local paths, file:// and what pyarrow's file systems open."""

from __future__ import annotations

import os
import uuid


def _local(uri: str) -> str | None:
    if "://" not in uri:
        return uri.removeprefix("file:")
    return uri[len("file://") :] if uri.startswith("file://") else None


def write_file(uri: str, data: bytes) -> None:
    """Write under a name of its own, then rename: a task that runs again replaces the file with equal content."""
    own = f"{uri}.{uuid.uuid4().hex}.tmp"
    if (path := _local(uri)) is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(_local(own), "wb") as f:
            f.write(data)
        os.replace(_local(own), path)
        return
    from pyarrow import fs

    there, path = fs.FileSystem.from_uri(uri)
    there.create_dir(os.path.dirname(path), recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    with there.open_output_stream(own) as f:
        f.write(data)
    there.move(own, path)


def read_file(uri: str, start: int = 0, size: int | None = None) -> bytes:
    if (path := _local(uri)) is not None:
        with open(path, "rb") as f:
            f.seek(start)
            return f.read(-1 if size is None else size)
    from pyarrow import fs

    there, path = fs.FileSystem.from_uri(uri)
    with there.open_input_file(path) as f:
        f.seek(start)
        return f.read() if size is None else f.read(size)


def delete_file(uri: str) -> None:
    """Delete it if it is there."""
    try:
        if (path := _local(uri)) is not None:
            os.remove(path)
            return
        from pyarrow import fs

        there, path = fs.FileSystem.from_uri(uri)
        there.delete_file(path)
    except FileNotFoundError:
        pass
