"""Copies of single files, as tasks make them."""

from __future__ import annotations

import uuid
from urllib.parse import quote

from pyarrow import fs as pa_fs


def place_of(path: str) -> tuple[pa_fs.FileSystem, str]:
    """File system and path of an absolute path or of a URI as Spark shows it, with blanks and
    signs as they are."""
    scheme, colon, rest = path.partition(":")
    return pa_fs.FileSystem.from_uri(f"{scheme}:{quote(rest, safe='/:@')}" if colon and "/" not in scheme else path)


def copy_one(source: str, target: str) -> int | None:
    """Copy a file between any two file systems; its bytes, None if it is not there. The copy
    appears under its name when it is whole."""
    from_fs, from_path = place_of(source)
    to_fs, to_path = place_of(target)
    if from_fs.get_file_info(from_path).type != pa_fs.FileType.File:
        return None
    to_fs.create_dir(to_path.rpartition("/")[0], recursive=True)
    hidden, n = f"{to_path}.{uuid.uuid4().hex}", 0
    with from_fs.open_input_stream(from_path) as read, to_fs.open_output_stream(hidden) as write:
        while part := read.read(1 << 20):
            write.write(part)
            n += len(part)
    to_fs.move(hidden, to_path)
    return n
