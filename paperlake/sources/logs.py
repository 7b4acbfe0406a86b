"""What went wrong, for people: a logger with colours on a terminal and a file if wanted, and a report of an error table by stage and reason."""

from __future__ import annotations

import logging
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Terminal colour of each level.
COLORS = {"DEBUG": 36, "INFO": 32, "WARNING": 33, "ERROR": 31, "CRITICAL": 35}


class Colored(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        return f"\033[{COLORS.get(record.levelname, 0)}m{super().format(record)}\033[0m"


def logger(name: str = "paperlake", level: int | str = logging.INFO, file: str | None = None) -> logging.Logger:
    """The logger of a name; handlers are put on it once, however often it is asked for."""
    made, form = logging.getLogger(name), "%(asctime)s %(name)s %(levelname)s %(message)s"
    made.setLevel(level)
    if not any(h.get_name() == "screen" for h in made.handlers):
        screen = logging.StreamHandler()
        screen.set_name("screen")
        screen.setFormatter(Colored(form) if sys.stderr.isatty() else logging.Formatter(form))
        made.addHandler(screen)
    if file and not any(h.get_name() == file for h in made.handlers):
        written = logging.FileHandler(file, encoding="utf-8")
        written.set_name(file)
        written.setFormatter(logging.Formatter(form))
        made.addHandler(written)
    return made


def report(errors: DataFrame, to: logging.Logger, most: int = 100, strict: bool = False) -> int:
    """Log the commonest reasons of an error table (stage, message) with their counts, and how many rows it has. strict: any error raises."""
    by = errors.groupBy("stage", "message").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "stage", "message")
    total = errors.count()
    for r in by.limit(most).collect():
        to.warning("%s: %s (%d times)", r.stage, r.message, r.n)
    if strict and total:
        raise ValueError(f"{total} errors")
    return total
