"""Column-level building blocks: report windows, fixed-point rounding and bucket families."""
