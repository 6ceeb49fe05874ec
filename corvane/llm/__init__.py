"""Training-data operators: archives, quality, sharding, deduplication, token counts and packing.

Nothing else in the library imports this subpackage; ``queries`` and ``oracles`` in
:mod:`corvane.llm.entry` are added to the driver's entry file when it can be imported.
"""
