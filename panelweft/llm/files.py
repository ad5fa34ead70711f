"""Binary files in the folder that driver and executors share, whatever file system holds it."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI (local, HDFS, S3, GCS) and the path in it."""
    return fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")


@contextmanager
def written(uri: str):
    """A stream to a file that appears under its name only when it is whole: a lost task leaves none."""
    system, path = opened(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with system.open_output_stream(part, compression=None) as f:
            yield f
    except BaseException:
        system.delete_file(part)
        raise
    system.move(part, path)
