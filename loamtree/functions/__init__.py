"""Column functions."""
from .scalar import log_sum_exp, nearest_time, rank_quantile, time_grid  # noqa: F401
