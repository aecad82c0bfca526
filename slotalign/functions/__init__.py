from .columns import (
    count_swaps,
    file_number,
    fill_missing_indices,
    mv_normal_log_density,
    sort_by_number,
    uni_normal_log_density,
)

__all__ = [
    "count_swaps",
    "file_number",
    "fill_missing_indices",
    "mv_normal_log_density",
    "sort_by_number",
    "uni_normal_log_density",
]
