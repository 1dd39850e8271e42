"""headwater: lineage analytics as DataFrame plans on Spark."""

__version__ = "0.1.0"
