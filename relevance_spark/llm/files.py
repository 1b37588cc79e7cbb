"""Array files in the shared folder, written by executors and memory-mapped by workers.

A file is written under a name of its own and then renamed, so a task that runs again, or twice, leaves the same
result. Where the shared folder is a mounted file system, workers map the files as they lie there; from another store
each worker process fetches a file once.
"""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np

_mapped: dict[tuple[str, str], np.ndarray] = {}


def _place(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_array(uri: str, name: str, values: np.ndarray) -> None:
    """Put one array under uri/name."""
    store, root = _place(uri)
    store.create_dir(root, recursive=True)
    own = f"{root}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        out.write(np.ascontiguousarray(values).tobytes())
    store.move(own, f"{root}/{name}")


def map_array(uri: str, name: str, dtype) -> np.ndarray:
    """The array under uri/name, mapped, not read; kept by the worker process. A missing file raises."""
    key = (uri, name)
    if key not in _mapped:
        if len(_mapped) > 4096:
            _mapped.clear()
        store, root = _place(uri)
        info = store.get_file_info(f"{root}/{name}")
        if not info.is_file:
            raise FileNotFoundError(f"{uri}/{name}")
        if not info.size:
            return np.empty(0, dtype)
        path = f"{root}/{name}"
        if store.type_name != "local":
            local = tempfile.NamedTemporaryFile(delete=False)
            with store.open_input_stream(path) as src, local:
                while data := src.read(1 << 22):
                    local.write(data)
            path = local.name
        _mapped[key] = np.memmap(path, dtype, mode="r")
        if store.type_name != "local":
            os.unlink(path)
    return _mapped[key]
