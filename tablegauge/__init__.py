"""Data profiling and data-quality assessment as Spark jobs."""

from tablegauge.plans.assess import Assessment, assess

__all__ = ["Assessment", "assess"]
