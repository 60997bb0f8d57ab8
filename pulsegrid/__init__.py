"""Signal-event analytics on PySpark: recordings and keyed series in, labelled events out."""

__version__ = "0.1.0"
