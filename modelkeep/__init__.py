"""modelkeep: the data side of a model lifecycle as Spark jobs.

Profiling, quality scans, feature preparation, Spark ML training and
evaluation, registry tables, batch/stream scoring, feedback accuracy and
drift tests, all expressed with DataFrame / SQL / Spark ML / Structured
Streaming so that Catalyst plans the work and it scales with the cluster.
"""

__version__ = "0.1.0"
