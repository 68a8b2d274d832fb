"""News-stream analytics as composable Spark operators.

Landed feed bodies become a clean, de-duplicated article table; articles are
grouped into stories and answer search, saved-search and listing queries.
Operators are ``DataFrame -> DataFrame``, scalar functions ``Column -> Column``.
"""

__version__ = "0.1.0"
