"""plumbline: governed business analytics as Spark plans."""
