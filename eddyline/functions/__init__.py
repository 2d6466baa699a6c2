"""Column functions shared by the operators."""

from eddyline.functions.columns import floor_to, norm_id, tables

__all__ = ["floor_to", "norm_id", "tables"]
