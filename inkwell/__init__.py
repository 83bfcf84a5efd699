"""inkwell: document-intelligence jobs on Spark DataFrames.

Every operator takes and returns DataFrames, runs no action of its own and is
built from Spark SQL expressions, joins and windows.
"""

__version__ = "0.1.0"
