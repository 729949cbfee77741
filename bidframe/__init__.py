"""Procurement quote analytics as Spark DataFrame jobs over many requests at once."""
from bidframe.config import EngineConfig, SkewPolicy

__all__ = ["EngineConfig", "SkewPolicy"]
