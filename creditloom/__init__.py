"""creditloom: a credit-risk lakehouse written as Spark DataFrame operators.

Every operator is a function from DataFrames to DataFrames.  Sub-packages:

``sources``    landing files, audit trail, schema history, document and id files
``functions``  column expressions (bands, ratios, text helpers)
``operators``  staging, features, quality, metrics, scoring, decisions, retrieval
``plans``      the table-by-table build order and the registered queries
``streaming``  incremental landing of newly arrived files
"""

__version__ = "0.1.0"
