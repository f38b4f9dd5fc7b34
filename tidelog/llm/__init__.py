"""Training-data operators: ten independent modules and the queries that apply them."""
