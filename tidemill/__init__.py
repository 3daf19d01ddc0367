"""tidemill: data behaviours as composable PySpark DataFrame transformations."""
