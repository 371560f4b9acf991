"""Document-grounded retrieval and statute extraction on Spark DataFrames.

Every operator takes DataFrames (or Columns) and returns a lazy DataFrame (or
Column). Sub-packages: ``functions`` (Column -> Column), ``operators``
(DataFrame -> DataFrame), ``sources`` (files, pages, sinks), ``streaming``
(Structured Streaming jobs) and ``plans`` (the queries registered in
``__spark_entry__``).
"""
