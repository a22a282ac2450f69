"""webloom: extraction, cleaning, quality, change and retrieval jobs over captured web pages.

Every public function maps DataFrames to DataFrames or Columns to Columns, so whole flows stay
lazy and Catalyst sees one plan.  The only Python that runs on executors is the HTML tree
flattener (`functions.html`) and the block scorer of batch retrieval (`operators.retrieval`).
"""

__version__ = "0.1.0"
