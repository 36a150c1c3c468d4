from evenkeel.functions.arrays import (
    append_args,
    append_list,
    array_dedup,
    array_minus,
    has_missing,
    join_items,
)
from evenkeel.functions.checks import collect_errors, typed_error, typed_value
from evenkeel.functions.maps import content_changed, maps_equal, value_changed
from evenkeel.functions.names import blank_to_null, derive_names, derived_name, name_or_override
from evenkeel.functions.owners import controller_owner, owned_or
from evenkeel.functions.render import line, render_config

__all__ = [
    "append_args",
    "append_list",
    "array_dedup",
    "array_minus",
    "blank_to_null",
    "collect_errors",
    "content_changed",
    "controller_owner",
    "derive_names",
    "derived_name",
    "has_missing",
    "join_items",
    "line",
    "maps_equal",
    "name_or_override",
    "owned_or",
    "render_config",
    "typed_error",
    "typed_value",
    "value_changed",
]
