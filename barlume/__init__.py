"""barlume: bar, trade and replay analytics as plain DataFrame functions on PySpark."""
