"""Single files on any file system that driver and executors share, by plain path or URI."""

from __future__ import annotations

import os
import re
import uuid


def store_of(path: str):
    """The file system and its own path; Hadoop's names of S3 are known."""
    from pyarrow import fs

    uri = re.sub(r"\As3[an]://", "s3://", path)
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def is_file(path: str) -> bool:
    store, p = store_of(path)
    return store.get_file_info(p).type.name == "File"


def read_bytes(path: str, most: int = -1) -> bytes:
    store, p = store_of(path)
    with store.open_input_stream(p, compression=None) as f:
        return f.read() if most < 0 else f.read(most)


def chunks(path: str, size: int = 1 << 20):
    store, p = store_of(path)
    with store.open_input_stream(p, compression=None) as f:
        while part := f.read(size):
            yield part


def put_bytes(path: str, data: bytes) -> None:
    """Writes under a temporary name in the same folder and renames, so that no reader sees half a file."""
    store, p = store_of(path)
    folder, _, name = p.rpartition("/")
    store.create_dir(folder, recursive=True)
    temp = f"{folder}/.{name}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(temp, compression=None) as f:
        f.write(data)
    store.move(temp, p)


def move(src: str, dst: str) -> None:
    store, a = store_of(src)
    b = store_of(dst)[1]
    store.create_dir(b.rpartition("/")[0], recursive=True)
    store.move(a, b)


def delete(path: str) -> None:
    store, p = store_of(path)
    if store.get_file_info(p).type.name == "File":
        store.delete_file(p)


def normalized_path(value: str, base: str | None = None) -> str:
    """An absolute path without dots: quotes dropped, variables and ~ expanded, relative to base or the working folder. URIs stay as they are."""
    text = os.path.expandvars(os.path.expanduser(str(value).strip().strip('"')))
    if not text:
        raise ValueError("Path cannot be empty")
    if "://" in text:
        return text.rstrip("/")
    return os.path.normpath(text if os.path.isabs(text) else os.path.join(base or os.getcwd(), text))


def is_within(path: str, parent: str) -> bool:
    child, top = normalized_path(path), normalized_path(parent)
    return child == top or child.startswith(top.rstrip("/") + "/")
