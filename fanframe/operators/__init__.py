"""The operators: lazy DataFrame in, lazy DataFrame out."""

from fanframe.operators.elementwise import apply_values, map_values
from fanframe.operators.grouped import group_apply
from fanframe.operators.rowwise import apply, apply_cells, apply_columns, apply_rows
from fanframe.operators.windowed import expanding, rolling

__all__ = ["apply", "apply_cells", "apply_columns", "apply_rows", "apply_values", "expanding", "group_apply", "map_values", "rolling"]
