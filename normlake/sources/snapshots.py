"""Versioned folders with an atomic switch: what is written is never changed, and one small file says which version is current.

A version is a folder of its own below ``versions``. The current one is named by the pointer with the greatest number below ``pointers``; pointers are only ever added.
Activating is a compare-and-set: whoever has seen number n creates number n + 1, and a file that is there already refuses it. A crash before that
leaves a folder that nobody reads; a pointer that was never filled doesn't count. Readers are pinned to the folder that they have opened.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession


class Superseded(ValueError):
    """Another activation came first."""


@dataclass(frozen=True)
class Snapshot:
    number: int
    path: str
    about: dict[str, str]


def _fs(spark: SparkSession, path: str) -> tuple[Any, Any]:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place


def _pointers(spark: SparkSession, path: str) -> list[int]:
    fs, place = _fs(spark, f"{path}/pointers")
    names = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
    return sorted(int(n) for n in names if n.isdigit())


def _read(spark: SparkSession, path: str, number: int) -> dict[str, str] | None:
    fs, place = _fs(spark, f"{path}/pointers/{number:012d}")
    stream = fs.open(place)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    try:
        found = json.loads(text)
    except ValueError:
        return None  # its writer died
    return found if isinstance(found, dict) and "version" in found else None


def current(spark: SparkSession, path: str) -> Snapshot | None:
    """The version in force; None before the first activation."""
    for number in reversed(_pointers(spark, path)):
        about = _read(spark, path, number)
        if about is not None:
            return Snapshot(number, f"{path}/versions/{about['version']}", about)
    return None


def new_version(path: str) -> str:
    """A folder that nobody else writes to or reads."""
    return f"{path}/versions/{uuid.uuid4().hex}"


def switch(spark: SparkSession, path: str, version: str, seen: Snapshot | None, about: dict[str, str]) -> Snapshot:
    """Make ``version`` (of :func:`new_version`) current if ``seen`` still is; else :class:`Superseded`."""
    now = current(spark, path)
    if (now and now.number) != (seen and seen.number):
        raise Superseded(f"number {now.number if now else None} is current, not {seen.number if seen else None}")
    number = max(_pointers(spark, path), default=0) + 1
    fs, place = _fs(spark, f"{path}/pointers/{number:012d}")
    fs.mkdirs(place.getParent())
    if not fs.createNewFile(place):
        raise Superseded(f"number {number} exists")
    said = about | {"version": version.rsplit("/", 1)[-1]}
    out = fs.create(place, True)
    try:
        out.write(bytearray(json.dumps(said, sort_keys=True).encode()))
    finally:
        out.close()
    return Snapshot(number, version, said)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete all versions but those of the last ``keep`` pointers; returns the names of those that went. Not while an activation runs."""
    named = [about["version"] for n in reversed(_pointers(spark, path)) if (about := _read(spark, path, n))]
    kept = list(dict.fromkeys(named))[: max(1, keep)]
    fs, place = _fs(spark, f"{path}/versions")
    gone = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
    gone = [n for n in gone if n not in kept]
    for n in gone:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(place, n), True)
    return sorted(gone)
