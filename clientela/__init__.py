"""Customer and campaign analytics as Spark jobs.

``functions``  column expressions with explicit missing-value rules
``sources``    delimited text scans and sinks, star-schema adapters
``operators``  DataFrame -> DataFrame building blocks
``plans``      whole reports and the query catalogue
"""
