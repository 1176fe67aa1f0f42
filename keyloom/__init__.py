"""keyloom: key-value snapshot analytics and corpus preparation on PySpark."""
