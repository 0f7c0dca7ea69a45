"""The live form of the operators, as Structured Streaming jobs.

Each has a batch operator as its counterpart.  Sinks are written per batch id,
so a batch that is replayed after a failure replaces its own output.
"""
