"""vectorloom: text-embedding data work as Spark DataFrame jobs.

Every public operator is a plain function ``DataFrame -> DataFrame`` (or
``(SparkSession, sf_dir) -> DataFrame`` for the registered queries in
``vectorloom.plans.catalog``). Catalyst plans the work; Python runs only
inside Arrow-batched tasks where numpy is the natural tool (encoders,
training epochs over a partition, head scoring).
"""

__version__ = "0.1.0"
