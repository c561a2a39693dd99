"""brindle: an analytics engine made of PySpark DataFrame operators."""
