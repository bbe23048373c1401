"""Small files and folders of a shared file system, whichever Hadoop can reach: claims, manifests, moves.

Nothing here touches table data; that is read and written by Spark.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """Hadoop's file system of a path, and the path for it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def delete(spark: SparkSession, path: str) -> None:
    files, place = file_system(spark, path)
    files.delete(place, True)


def claim(spark: SparkSession, path: str) -> bool:
    """Makes an empty file that can be made once; false if it is there."""
    files, place = file_system(spark, path)
    try:
        files.create(place, False).close()
    except Py4JJavaError:
        return False
    return True


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none where there is no folder."""
    files, place = file_system(spark, path)
    if not files.exists(place):
        return []
    return sorted(status.getPath().getName() for status in files.listStatus(place))


def write_json(spark: SparkSession, path: str, value: Any) -> bool:
    """A small file that is there as a whole or not at all; false if another one has come first."""
    files, place = file_system(spark, path)
    _, draft = file_system(spark, f"{path.rsplit('/', 1)[0]}/.draft-{uuid.uuid4().hex}")
    out = files.create(draft, False)
    out.write(bytearray(json.dumps(value), "utf-8"))
    out.close()
    if not files.exists(place) and files.rename(draft, place):
        return True
    files.delete(draft, False)
    return False


def read_json(spark: SparkSession, path: str) -> Any:
    """What write_json wrote; None where it has not."""
    files, place = file_system(spark, path)
    if not files.exists(place):
        return None
    stream = files.open(place)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def move_files(spark: SparkSession, source: str, target: str) -> int:
    """Moves the data files under one folder to the same places under another; how many there were.

    Files that an earlier try has moved are no longer in the source, so a rerun moves the others.
    """
    files, root = file_system(spark, source)
    if not files.exists(root):
        return 0
    _, goal = file_system(spark, target)
    base = files.makeQualified(root).toUri().getPath().rstrip("/")
    found, moved = files.listFiles(root, True), 0
    paths = []
    while found.hasNext():
        paths.append(found.next().getPath())
    for own in paths:
        relative = own.toUri().getPath()[len(base) + 1:]
        if any(step.startswith(("_", ".")) for step in relative.split("/")):
            continue
        _, place = file_system(spark, f"{target.rstrip('/')}/{relative}")
        files.mkdirs(place.getParent())
        if not files.rename(own, place):
            raise OSError(f"{own} cannot be moved to {goal}")
        moved += 1
    return moved
