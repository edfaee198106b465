"""Settings, on the driver only: the environment's, else the session's (`spark.loomline.<name>`), else those of a .env file."""

from __future__ import annotations

import os
import re
from functools import reduce
from pathlib import Path

from pyspark.sql import SparkSession

#: A line of the file: a name, and a value that is quoted or ends at a comment.
_LINE = re.compile(r"""^[ \t]*(?:export[ \t]+)?(?P<name>[^\s#=]+)[ \t]*=[ \t]*(?:"(?P<double>.*)"|'(?P<single>.*)'|(?P<bare>.*?))[ \t]*(?:[ \t]#.*)?$""", re.M)


def parse(text: str) -> dict[str, str]:
    return {m["name"]: next((m[k] for k in ("double", "single") if m[k] is not None), m["bare"] or "") for m in _LINE.finditer(text)}


def find_env(start: Path | str | None = None) -> Path | None:
    """The file of the folder or else of the nearest one above: from the root down, each folder's file takes the place of those above."""
    parts = Path(start or os.curdir).absolute().parts
    folders = (Path(*parts[: n + 1]) for n in range(len(parts)))
    return reduce(lambda known, folder: folder / ".env" if os.path.isfile(folder / ".env") else known, folders, None)


def load_env(path: Path | str | None = None, override: bool = False) -> Path | None:
    """Names of the file into the environment; those that are set stay unless override. Returns the file, or None."""
    file = find_env() if path is None else Path(path)
    if file is None or not os.path.isfile(file):
        return None
    own = parse(file.read_text(encoding="utf-8"))
    os.environ.update(own if override else {k: v for k, v in own.items() if k not in os.environ})
    return file


def setting(name: str, default: str | None = None) -> str | None:
    """Unset and empty both give the default."""
    spark = SparkSession.getActiveSession()
    of_session = spark.conf.get(f"spark.loomline.{name}", None) if spark else None
    if name not in os.environ and not of_session:
        load_env()
    return os.environ.get(name) or of_session or default
