from .ordering import number_rows, prefix_sum, top_rows
from .semantics import (
    Tally,
    ieee_div,
    if_known,
    is_number,
    label,
    null_safe_join,
    sql_div,
    text_flag,
    union_all,
)
from .storage import (
    PLAYS_CODEC,
    attach,
    clear_settled,
    compiled_methods,
    join_side,
    scratch_tables,
    settle,
    settle_parts,
    shared_folder,
    spread,
)

__all__ = [
    "PLAYS_CODEC", "Tally", "attach", "clear_settled", "compiled_methods", "ieee_div", "if_known", "is_number", "join_side",
    "label", "null_safe_join", "number_rows", "prefix_sum", "scratch_tables", "settle", "settle_parts",
    "shared_folder", "spread", "sql_div", "text_flag", "top_rows", "union_all",
]
