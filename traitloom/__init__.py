"""Entity-trait analytics and text-corpus operations on PySpark."""
