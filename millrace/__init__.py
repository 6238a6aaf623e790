"""millrace: governed data movement and enrichment, expressed as Spark plans."""

__version__ = "0.1.0"
