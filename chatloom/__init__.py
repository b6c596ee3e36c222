"""Chat-corpus preparation, evaluation and audit as Spark DataFrame operators."""

from chatloom.options import DataOptions
from chatloom.operators.formats import convert, register_format
from chatloom.session import configure

__all__ = ["DataOptions", "configure", "convert", "register_format"]
