"""quirelake: document analytics on Spark.

Documents of many formats become one node table; everything after parsing is
planned by Catalyst.  The training-data operators live in ``quirelake.llm``,
which nothing else here imports.
"""

__version__ = "0.1.0"
