"""editlift: article quality and edit ranking over Spark DataFrames."""

__version__ = "0.1.0"
