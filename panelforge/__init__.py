"""panelforge: point-in-time panel analytics and data-quality operators on Spark."""

__version__ = "0.1.0"
