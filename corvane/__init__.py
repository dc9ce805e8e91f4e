"""corvane: structural analytics on Spark DataFrames.

``sources`` turns files and tables into relations, ``functions`` holds column
expressions, ``operators`` the relational, graph and array operators, ``plans``
the helpers that decide how a plan runs (lineage cuts, skew, size checks) and
``streaming`` the stateful jobs.  ``llm`` is optional; nothing here imports it.
"""
