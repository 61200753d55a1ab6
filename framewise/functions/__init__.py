"""Column-expression helpers shared by the operators."""

from framewise.functions.expr import (  # noqa: F401
    clip,
    conditional_list,
    right_closed_band,
    round_half_even,
    safe_div,
    sig_round,
    title_case,
    week_monday,
)
