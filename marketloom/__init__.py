"""marketloom: analytics over repeatedly observed classified adverts, on PySpark."""
