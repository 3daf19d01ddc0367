"""The driver's own log, declared for ``logging.config``: the console always, a rotating file where a path is given.

Lines have the layout of ``functions.logs.log_line``, by which executors' records are rendered as columns.
"""

import logging
from logging.config import dictConfig
import sys

from tidemill.functions.logs import GREY, LEVEL_COLOURS, LEVEL_NAMES, RESET, level_number

#: What goes before the line, before the message and behind it on a terminal, by level; unknown levels have no colour.
_DECORATION = {number: (colour, GREY * (number == logging.DEBUG), RESET * (number == logging.DEBUG)) for number, colour in LEVEL_COLOURS.items()}
_PARTS = ["%(asctime)s", "%(shown)s", "%(place)-25s"]


class Described(logging.Filter):
    """Lets every record pass, once it has the attributes that the layouts name."""

    def filter(self, record: logging.LogRecord) -> bool:
        described = {"shown": LEVEL_NAMES.get(record.levelno) or record.levelname.ljust(8), "place": ":".join((record.filename, str(record.lineno)))}
        described |= zip(("before", "open", "close"), _DECORATION.get(record.levelno, ("", "", "")), strict=True)
        vars(record).update(described)
        return True


class Closed(logging.Formatter):
    """Puts a record's closing code behind all else, an exception's lines too."""

    def format(self, record: logging.LogRecord) -> str:
        return super().format(record) + vars(record)["close"]


def settings(level: str, log_file: str | None = None, most_bytes: int = 5 << 20, backups: int = 3, coloured: bool = False) -> dict:
    """The declaration: sinks, layouts and the root's level. An unknown level counts as DEBUG."""
    common = {"filters": ["described"]}
    sinks = {"console": common | {"class": "logging.StreamHandler", "stream": "ext://sys.stdout", "formatter": "coloured" if coloured else "plain"}}
    if log_file:
        sinks["file"] = common | {"class": "logging.handlers.RotatingFileHandler", "filename": log_file, "maxBytes": most_bytes, "backupCount": backups, "encoding": "utf-8", "formatter": "plain"}
    time = {"datefmt": "%Y-%m-%d %H:%M:%S"}
    return {
        "version": 1,
        "disable_existing_loggers": False,
        "filters": {"described": {"()": Described}},
        "formatters": {
            "plain": time | {"format": " | ".join([*_PARTS, "%(message)s"])},
            "coloured": {"()": Closed, "fmt": "%(before)s" + " | ".join(_PARTS) + f" |{RESET} %(open)s%(message)s"} | time,
        },
        "handlers": sinks,
        "root": {"level": level_number(level, logging.DEBUG), "handlers": [*sinks]},
    }


def configure(level: str, log_file: str | None = None, most_bytes: int = 5 << 20, backups: int = 3, overrides: dict[str, str] | None = None) -> None:
    """Declares the root logger anew: what it had before is closed. An override by an unknown name counts as WARNING,
    one by NOTSET gives the logger back to its parent; loggers without an override stay as they are."""
    dictConfig(settings(level, log_file, most_bytes, backups, sys.stdout.isatty()))
    own = {name: {"level": level_number(wanted, logging.WARNING)} for name, wanted in (overrides or {}).items()}
    dictConfig({"version": 1, "incremental": True, "loggers": own})
