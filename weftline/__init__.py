"""weftline: declarative data pipelines compiled to lazy PySpark plans."""
