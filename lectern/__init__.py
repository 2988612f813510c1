"""lectern: grounded document question answering as Spark DataFrame plans."""

__version__ = "0.1.0"
