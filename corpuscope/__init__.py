"""Code-corpus and change analytics as plain PySpark DataFrame operators.

Every public operator is a function from DataFrames to DataFrames; nothing is
collected on the data path.  ``functions`` holds column expressions,
``operators`` single operators, ``plans`` compositions of them, ``sources``
readers and writers, ``streaming`` the Structured Streaming variants.
"""

__version__ = "0.1.0"
