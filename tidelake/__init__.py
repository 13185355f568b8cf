"""tidelake: an event-lake toolkit written as Spark DataFrame / SQL jobs.

Landing JSON -> raw events (VARIANT) -> typed events, with retention trims,
missed-file refresh, metadata back-fill, transform-lag monitoring and
reduced-column views, plus warehouse-dialect column functions registered as
Spark SQL functions so they run unchanged in batch and in streams.
"""

__version__ = "0.1.0"
