"""tessera: versioned table snapshots, schema drift and test-data jobs on Spark.

Sub-packages:
  sources    readers and writers (snapshot store, schema documents, usage events, JDBC)
  functions  column-expression builders (coercion, rendering, markers, parsing, hashing)
  operators  DataFrame -> DataFrame operators (catalog, drift, integrity, revisions, ...)
  plans      composed flows (export, restore, refresh)
  streaming  Structured Streaming variants of the usage, history and restore jobs
  workloads  inputs derived from the driver tables and the registered queries
"""

__version__ = "0.1.0"
