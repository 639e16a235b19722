"""flowloom: case-flow analytics and text-corpus operators as lazy Spark DataFrame functions."""
