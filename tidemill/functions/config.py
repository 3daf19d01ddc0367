"""Configuration values kept as a map column, where a missing key differs from an empty value."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Defaults of keys that may be missing.
SMTP_PORT = "587"
PUSH_SERVER = "https://ntfy.sh"


def setting(config: Column, key: str, default: Column) -> Column:
    """Value of a key, even if it is empty or null; ``default`` only where the key is missing."""
    return F.when(F.map_contains_key(config, F.lit(key)), config[key]).otherwise(default)


def sender(config: Column) -> Column:
    """Sender of an email: the SMTP user if that key is there, though it be empty, else the recipient."""
    return setting(config, "smtp_user", config["notify_email"])


def smtp_port(config: Column) -> Column:
    return setting(config, "smtp_port", F.lit(SMTP_PORT))


def push_url(config: Column) -> Column:
    """Server, a slash and the topic, with no clean-up of a doubled slash."""
    return F.concat(setting(config, "ntfy_server", F.lit(PUSH_SERVER)), F.lit("/"), config["ntfy_topic"])


def filled(value: Column) -> Column:
    """True where the value is neither null nor empty."""
    return F.coalesce(value != "", F.lit(False))
