"""Message analytics as PySpark DataFrame transformations."""

from mailloom.config import EngineConfig

__all__ = ["EngineConfig"]
