"""A SQL, key-value and data-processing engine on PySpark."""

from tidemark.operators.kv import KV
from tidemark.plans.engine import Engine
from tidemark.session import build_session, local_session

__all__ = ["KV", "Engine", "build_session", "local_session"]
