"""Log and table analytics on PySpark."""
