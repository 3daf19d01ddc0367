"""Log lines: level names, colours, and the fixed line layout."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Level numbers, their names as shown (8 wide), their ANSI colours, and the other codes.
LEVELS = {"DEBUG": 10, "INFO": 20, "WARNING": 30, "ERROR": 40, "CRITICAL": 50}
LEVEL_NAMES = {10: "Debug   ", 20: "Info    ", 30: "Warning ", 40: "Error   ", 50: "Critical"}
LEVEL_COLOURS = {10: "\x1b[36m", 20: "\x1b[94m", 30: "\x1b[33m", 40: "\x1b[31m", 50: "\x1b[91m"}
RESET, GREY = "\x1b[0m", "\x1b[90m"

#: Other names the level lookup accepts.
ALIASES = {"NOTSET": 0, "WARN": 30, "FATAL": 50}


def level_number(name: str, default: int) -> int:
    """Number of a level given by name in any case; ``default`` for an unknown name."""
    return (LEVELS | ALIASES).get(name.upper(), default)


def _lookup(key: Column, values: dict[int, str]) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out


def shown_level(levelno: Column, levelname: Column) -> Column:
    """Fixed name of a known level, else the record's own name padded to 8 and never cut."""
    return F.coalesce(_lookup(levelno, LEVEL_NAMES), F.format_string("%-8s", F.coalesce(levelname, F.lit(""))))


def log_line(ts: Column, levelno: Column, levelname: Column, filename: Column, lineno: Column, msg: Column, exc: Column | None = None, colour: bool = False) -> Column:
    """``time | level | file:line | message``, file:line at least 25 wide, an exception on its own lines.

    With ``colour`` the part before the message takes the level's colour (none for an unknown level, the
    reset code still follows) and the message of a debug record is grey. Time is shown in the session's
    zone; a null message shows as empty.
    """
    time = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    place = F.format_string("%-25s", F.concat_ws(":", filename, lineno.cast("string")))
    text = F.coalesce(msg, F.lit(""))
    if exc is not None:
        text = F.concat(text, F.coalesce(F.concat(F.lit("\n"), exc), F.lit("")))
    left = F.concat_ws(" | ", time, shown_level(levelno, levelname), place)
    if not colour:
        return F.concat_ws(" | ", left, text)
    left = F.concat(F.coalesce(_lookup(levelno, LEVEL_COLOURS), F.lit("")), left, F.lit(" |" + RESET))
    return F.concat(left, F.lit(" "), F.when(levelno == 10, F.concat(F.lit(GREY), text, F.lit(RESET))).otherwise(text))
