"""Event-time analytics on Spark: SQL pipelines with HOP windows, and operators for message data."""

from eddyline.plans.pipeline import Pipeline
from eddyline.runtime import Runtime
from eddyline.schema import Bool, Float, Int, List, Long, Schema, String, Struct, Timestamp
from eddyline.session import local_session
from eddyline.time_notion import EventTimeNotion, ProcessingTimeNotion

__version__ = "0.1.0"
__all__ = ["Bool", "EventTimeNotion", "Float", "Int", "List", "Long", "Pipeline", "ProcessingTimeNotion", "Runtime", "Schema", "String", "Struct", "Timestamp", "local_session"]
