"""Zip members as splittable text."""

from __future__ import annotations

import os
import shutil
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

SUFFIXES = (".txt", ".jsonl", ".ndjson", ".json")
PIECE = 64 << 20  # bytes of one text file
STAMP = "_unpacked"  # says of which zip the pieces are; Spark skips names with an underscore


def unpack(path: str, folder: str) -> str:
    """The largest text member of a zip in pieces of whole lines under folder; a folder that is there whole is used again, unless the zip's path, size or time has changed.

    One stream over the member, whatever its size; Spark reads the pieces in
    parallel. The folder is one that driver and executors share.
    """
    stat = os.stat(path)
    stamp = f"{os.path.abspath(path)} {stat.st_size} {stat.st_mtime_ns}"
    said = os.path.join(folder, STAMP)
    if os.path.isdir(folder):
        if os.path.exists(said) and open(said).read() == stamp:
            return folder
        shutil.rmtree(folder)
    with zipfile.ZipFile(path) as z:
        members = [m for m in z.infolist() if m.filename.lower().endswith(SUFFIXES) and not m.is_dir()]
        if not members:
            raise ValueError(f"no text in {path}")
        building = f"{folder.rstrip('/')}.building-{uuid.uuid4().hex}"
        os.makedirs(building)
        with z.open(max(members, key=lambda m: m.file_size)) as f:
            n = 0
            while lines := f.readlines(PIECE):
                with open(os.path.join(building, f"part-{n:05d}.txt"), "wb") as out:
                    out.writelines(lines)
                n += 1
            if n == 0:
                open(os.path.join(building, "part-00000.txt"), "wb").close()
        with open(os.path.join(building, STAMP), "w") as f:
            f.write(stamp)
    os.rename(building, folder)
    return folder


def read_lines(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """(value) lines of a .zip, by way of folder, or of gzip and plain text directly; other suffixes raise."""
    low = path.lower()
    if low.endswith(".zip"):
        return spark.read.text(unpack(path, folder))
    if not low.removesuffix(".gz").endswith(SUFFIXES):
        raise ValueError(f"can't read {path}")
    return spark.read.text(path)
