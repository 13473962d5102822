"""catalign: product-catalogue harmonization as Spark DataFrame jobs."""

from catalign.runtime import build_session, stage

__all__ = ["build_session", "stage"]
