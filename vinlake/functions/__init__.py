"""Column expressions: normalisation of identifiers, mileage, money, geography, labels, dates, addresses and JSON metadata. None is a Python UDF."""
