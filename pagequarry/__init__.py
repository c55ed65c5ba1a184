"""pagequarry: page-level analysis of Extensible Storage Engine files, and corpus operators, on Spark."""
