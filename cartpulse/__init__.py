"""cartpulse: product, operations and marketing metrics of a delivery service on Spark.

Each metric is a function from :class:`cartpulse.sources.DeliveryTables`
(user actions, courier actions, orders with product arrays, products) to a
lazy DataFrame built from built-in Spark expressions.
"""

__version__ = "0.1.0"
