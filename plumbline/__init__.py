"""Plumbline: governed analytics on Spark DataFrames.

Every public function takes DataFrames (or a SparkSession and a location) and
returns a lazy DataFrame. Nothing is collected to the driver except the
handful of rows that decide a gate: a scan estimate, a check report.
"""

__version__ = "0.1.0"
