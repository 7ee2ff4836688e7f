"""brinework: waterflood voidage accounting and data-processing operators on PySpark."""
