"""docloom: the data side of document question answering, on Spark.

Column functions live in ``docloom.functions`` (``text``, ``spans``);
DataFrame operators in ``docloom.operators`` (``qa``, ``corpus``,
``features``, ``splits``, ``decode``, ``collect``, ``trials``, ``ranks``,
``joins``); readers, sinks and Arrow hooks in ``docloom.sources``; streams in
``docloom.streaming``; the registered driver queries in ``docloom.plans``.
"""

__version__ = "0.1.0"
