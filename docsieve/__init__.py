"""docsieve: document-extraction, de-identification and review operators on PySpark DataFrames."""

__version__ = "0.1.0"
