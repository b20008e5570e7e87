"""Event-derivation analytics and corpus operators on PySpark."""
