"""evenkeel: keep tables in line with a declared state, on Spark.

Every operator is a function from DataFrames to DataFrames; the caller names the key,
value, reference and order columns. See README.md for the list.
"""

from evenkeel.session import build_session, shared_dir, ship_package, stored

__all__ = ["build_session", "shared_dir", "ship_package", "stored"]
