"""orbisframe: tile worlds as Spark tables, and the operators that shape them."""

__version__ = "0.2.0"
