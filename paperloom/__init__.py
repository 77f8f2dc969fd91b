"""Literature analytics on Spark: catalogue, text, vectors, search, notebooks, metrics."""

from paperloom.session import build_session

__all__ = ["build_session"]
