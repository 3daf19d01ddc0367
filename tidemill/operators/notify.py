"""Notifications: the enabled channels of a configuration as rows, and delivery by a given function."""

from collections.abc import Callable
import logging

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tidemill.functions.config import filled, push_url, sender, smtp_port


def plan(notes: DataFrame, config: str = "config") -> DataFrame:
    """A row for each enabled channel of each notification, email before push (position 0, 1).

    Email needs a host and a recipient, push a topic; null counts as empty. ``target`` is the recipient
    or the push address, ``login`` whether email also has user and password.
    """
    c = F.col(config)
    email, push = filled(c["smtp_host"]) & filled(c["notify_email"]), filled(c["ntfy_topic"])

    def channel(name: str, on: Column, target: Column, source: Column, port: Column, login: Column) -> Column:
        return F.struct(F.lit(name).alias("channel"), on.alias("on"), target.alias("target"), source.alias("sender"), port.alias("port"), login.alias("login"))

    rows = F.array(
        channel("email", email, c["notify_email"], sender(c), smtp_port(c), filled(c["smtp_user"]) & filled(c["smtp_password"])),
        channel("push", push, push_url(c), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(False)),
    )
    on = F.filter(rows, lambda r: r["on"])
    return notes.select("*", F.posexplode(on).alias("position", "_c")).select(*notes.columns, "position", *(F.col(f"_c.{k}").alias(k) for k in ("channel", "target", "sender", "port", "login")))


def deliver(planned: DataFrame, send: Callable[[Row], None], most: int = 1000) -> int:
    """Sends the planned rows from the driver, in order; a failure is logged and doesn't stop the others.

    Notifications are few by nature: over ``most`` rows is an error, not a quiet cut. Returns how many
    were sent.
    """
    rows = planned.take(most + 1)
    if len(rows) > most:
        raise ValueError(f"over {most} notifications to deliver")
    sent = 0
    for row in rows:
        try:
            send(row)
            sent += 1
        except Exception as e:  # one channel's failure must not stop the next
            logging.getLogger(__name__).warning("Failed to send %s notification: %s", row["channel"], e)
    return sent
