"""Training-data operators: tokenising, auditing, filtering, deduplicating and mixing documents.

Nothing else in the library imports this subpackage, and it imports nothing from the rest of the
library, so the folder can be removed without touching the telemetry engine.
"""
