"""An analytics engine for leakage-resistant calibration benchmarks, on Spark."""
