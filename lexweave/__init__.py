"""lexweave: evidence-grounded document matching and large-table hygiene on PySpark."""

__version__ = "0.1.0"
