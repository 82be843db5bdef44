"""Point-in-time forecasting operators on Spark DataFrames."""

from cutline.session import build_session, checkpoint_dir, ensure_session

__all__ = ["build_session", "checkpoint_dir", "ensure_session"]
