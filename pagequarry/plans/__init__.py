"""SQL views and functions, synthetic files, and the queries of the driver."""
