"""petrel: text-corpus preparation, classification and daily bars as Spark jobs.

Every operator is ``DataFrame -> DataFrame`` (``petrel.operators``) or
``Column -> Column`` (``petrel.functions``); readers and writers live in
``petrel.sources``, composed jobs in ``petrel.plans`` and the Structured
Streaming forms in ``petrel.streaming``.
"""

__version__ = "0.1.0"
