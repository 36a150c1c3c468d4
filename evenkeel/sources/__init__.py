from evenkeel.sources.tables import (
    append_status,
    batch_folder,
    in_namespace,
    lookup,
    lookup_many,
    read_changes,
    read_snapshot,
    with_labels,
)
from evenkeel.sources.versions import RowVersions

__all__ = [
    "RowVersions",
    "append_status",
    "batch_folder",
    "in_namespace",
    "lookup",
    "lookup_many",
    "read_changes",
    "read_snapshot",
    "with_labels",
]
