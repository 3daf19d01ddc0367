"""Status objects, and the view state that follows from them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The status domain.
IDLE, WORKING = "idle", "working"


def status_of(version: Column) -> Column:
    """The status object: version, then status, which is always idle."""
    return F.struct(version.alias("version"), F.lit(IDLE).alias("status"))


#: What a browser's parser refuses and Spark's would take.
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def parsed(body: Column) -> Column:
    """The response object of a raw body. What isn't JSON, or no object with a status, gives null, as a failed request does.

    Spark reads the first value of a text and passes over what follows. So the body is read as a member of an object whose last
    member must be found, and counted as the only element of an array: no text but a single value is good for both.
    """
    held = F.from_json(F.concat(F.lit('{"body":'), body, F.lit(',"end":1}')), "body struct<version string, status string>, end int", _STRICT)
    alone = (held["end"] == 1) & (F.json_array_length(F.concat(F.lit("["), body, F.lit("]"))) == 1)
    return F.when(alone & held["body"]["status"].isNotNull(), held["body"])


def view_state(responses: DataFrame, response: str = "response") -> DataFrame:
    """Adds dot_class, label, working and badge for a response object with version and status.

    A null response (request or parsing failed), or one without a status, shows as unreachable. A null
    badge means that the one shown before stays.
    """
    status, version = F.col(f"{response}.status"), F.col(f"{response}.version")
    return responses.withColumns({
        "dot_class": F.concat_ws(" ", F.lit("status-dot"), status),
        "label": F.coalesce(status, F.lit("unreachable")),
        "working": F.coalesce(status == WORKING, F.lit(False)),
        "badge": F.when(status.isNotNull() & (version != ""), F.concat(F.lit("v"), version)),
    })
