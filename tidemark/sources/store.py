"""Files of any store that Python workers read by ranges and write whole."""

from __future__ import annotations

import uuid

from pyarrow import NativeFile, fs


def at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def opened(uri: str) -> NativeFile:
    """The file, of which only what is asked for is read."""
    store, path = at(uri)
    return store.open_input_file(path)


def listed(uri: str, endings: tuple[str, ...]) -> list[str]:
    """URIs of the files at or below a path that end in one of the endings, in order of name."""
    store, path = at(uri)
    head = uri[: len(uri) - len(path.rstrip("/"))] if uri.rstrip("/").endswith(path.rstrip("/")) else "file://"
    info = store.get_file_info(path)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted(f"{head}{x.path}" for x in found if x.type == fs.FileType.File and x.path.lower().endswith(endings))


def put(uri: str, content: bytes) -> None:
    """Writes a file whole or not at all, so that tasks that run again or twice leave one."""
    store, path = at(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    trial = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(trial) as out:
        out.write(content)
    store.move(trial, path)
