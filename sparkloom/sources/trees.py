"""Project trees: files written all together or not at all."""

from __future__ import annotations

import os
import shutil
import uuid
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame


def write_tree(files: DataFrame, folder: str) -> list[str]:
    """Writes rows (`path`, `content`) as files below `folder`, in the order of their paths; returns the paths.

    The tree is made beside its place and moved there as a whole. If anything goes wrong, what was there before stays as
    it was and nothing new is left. Rows stream to the driver partition by partition, as one process writes the tree; use
    a DataFrame writer for data. Paths must be relative, without steps upward, and unique.
    """
    target = Path(folder)
    made, old = target.with_name(f".{target.name}-{uuid.uuid4().hex}"), target.with_name(f".{target.name}-{uuid.uuid4().hex}-old")
    written: list[str] = []
    try:
        made.mkdir(parents=True)
        for row in files.select("path", "content").orderBy("path").toLocalIterator():
            own = PurePosixPath(row[0] or "")
            if not row[0] or own.is_absolute() or ".." in own.parts:
                raise ValueError(f"not a path inside the tree: {row[0]!r}")
            place = made / own
            place.parent.mkdir(parents=True, exist_ok=True)
            with open(place, "xb") as out:
                out.write(row[1] or b"")
            written.append(str(own))
        if target.exists():
            os.replace(target, old)
        try:
            os.replace(made, target)
        except OSError:
            if old.exists():
                os.replace(old, target)
            raise
    finally:
        shutil.rmtree(made, ignore_errors=True)
        shutil.rmtree(old, ignore_errors=True)
    return written
