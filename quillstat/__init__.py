"""quillstat: comment analytics for many posts at once, on Spark DataFrames.

Every operator is a ``DataFrame -> DataFrame`` function keyed by ``post_id``.
"""

__version__ = "0.1.0"
