"""mixloom: a Spark-first engine for post-training data.

Core operators live in ``operators`` (DataFrame -> DataFrame), scalar column builders in
``functions``, readers and writers in ``sources``, multi-step plans in ``plans`` and
Structured Streaming operators in ``streaming``.  ``llm`` is an optional subpackage on top
of the core; nothing in the core imports it.
"""

__version__ = "0.1.0"
