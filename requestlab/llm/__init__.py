"""Training-data operators over ``documents``, ``embeddings`` and ``benchmark``.

Nothing else in the library imports this subpackage.  ``queries`` holds the registered
queries, the other modules hold one operator each.
"""
